"""Sources and sinks of a corpus."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "id string, docId string, index int, text string, locator string, ordinalStart int, ordinalEnd int, heading string, charCount int"
MANIFEST = (
    "generatedFrom string, documents array<struct<docId:string,title:string,sourceLabel:string,sourceType:string,origin:string,module:string,format:string,words:int,chunkCount:int,sha256:string>>, "
    "skipped array<struct<path:string,reason:string>>, nearDupes array<struct<kept:string,dropped:string,similarity:double>>, cohorts struct<distinct:array<string>,conflict:boolean>, cohortMentions array<struct<cohort:string,source:string,excerpt:string>>"
)


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*map(snake, df.columns))


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return snake_columns(spark.read.schema(CORPUS).json(path)).withColumnRenamed("index", "chunk_index")


def write_corpus_jsonl(chunks: DataFrame, path: str) -> None:
    names = {"doc_id": "docId", "chunk_index": "index", "ordinal_start": "ordinalStart", "ordinal_end": "ordinalEnd", "char_count": "charCount"}
    chunks.select(*[F.col(c).alias(names.get(c, c)) for c in chunks.columns]).write.json(path)


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents, skipped, near_dupes, cohort_mentions of one multi-line JSON object."""
    whole = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    part = lambda c: snake_columns(whole.select(F.inline(c)))
    return {"documents": part("documents"), "skipped": part("skipped"), "near_dupes": part("nearDupes"), "cohort_mentions": part("cohortMentions")}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("multiLine", True).json(path)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content, size_bytes, modified of files below a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return found.select("path", "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def _fs(spark: SparkSession, path: str):
    """(file system, path) of a folder or file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, content) of the commits below ``root``, in order. A file whose writer has not finished, or never will, is none."""
    fs, place = _fs(spark, f"{root}/_commits")
    if not fs.exists(place):
        return []
    rows = spark.read.text(f"{root}/_commits", wholetext=True).select("value", F.input_file_name().alias("name")).collect()
    return sorted((int(r.name.rsplit("/", 1)[1]), r.value[:-1]) for r in rows if r.value.endswith("\n"))


def _create(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file that must not exist; of several writers at once one succeeds. Hadoop's local file system looks first and creates then, so there the system's own exclusive creation is used."""
    fs, place = _fs(spark, path)
    if fs.getScheme() == "file":
        local = place.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "xb") as out:
            out.write(data)
        return
    try:
        out = fs.create(place, False)
    except Py4JJavaError as e:
        if "AlreadyExists" not in str(e.java_exception):
            raise
        raise FileExistsError(path) from e
    out.write(bytearray(data))
    out.close()


def commit(spark: SparkSession, root: str, content: Callable[[str | None], str], attempts: int = 50, patience: float = 60.0) -> int:
    """Make ``content(of the last commit)`` the next one and return its number.

    The next number's file is created exclusively. If another writer has it, what it committed is read and ``content`` is asked again.
    A file that stays unfinished for ``patience`` seconds is a dead writer's, and its number is passed over.
    """
    fs, folder = _fs(spark, f"{root}/_commits")
    for attempt in range(attempts):
        known = commits(spark, root)
        last = known[-1][0] if known else 0
        text = content(known[-1][1] if known else None)
        later = {int(s.getPath().getName()): s.getModificationTime() for s in fs.listStatus(folder) if s.getPath().getName().isdigit()} if fs.exists(folder) else {}
        dead = [n for n, at in later.items() if n > last and time.time() - at / 1000 > patience]
        try:
            _create(spark, f"{root}/_commits/{max(dead, default=last) + 1:012d}", f"{text}\n".encode())
        except FileExistsError:
            time.sleep(0.02 * (attempt + 1))  # another writer was first
            continue
        return max(dead, default=last) + 1
    raise RuntimeError(f"no commit in {attempts} attempts")


def write_index(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Write all tables into a folder of their own, then commit it: readers see the old version or the new one, never a mix."""
    spark = next(iter(tables.values())).sparkSession
    name = f"{version}-{uuid.uuid4().hex[:8]}"
    for table, df in tables.items():
        df.write.parquet(f"{root}/{name}/{table}")
    commit(spark, root, lambda _: name)
    return f"{root}/{name}"


def read_index(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    version = commits(spark, root)[-1][1]
    return {n: spark.read.parquet(f"{root}/{version}/{n}") for n in names}


def expire_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove all versions but the last ``keep``, which running readers may still use; the removed ones. Commits are removed first, so no reader starts on a version that goes."""
    old = commits(spark, root)[:-keep]
    for number, _ in old:
        fs, place = _fs(spark, f"{root}/_commits/{number:012d}")
        fs.delete(place, False)
    for _, version in old:
        fs, place = _fs(spark, f"{root}/{version}")
        fs.delete(place, True)
    return [version for _, version in old]


def replace_slice(new: DataFrame, path: str, by: str = "source_type") -> None:
    """Overwrite only the partitions that ``new`` has rows of."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header, in the order that they have. Nulls are empty cells."""
    rows.select(*[F.col(c).cast("string") for c in rows.columns]).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``write_sheet``'s rows; an empty cell is null."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
