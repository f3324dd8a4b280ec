"""Shared helpers of the training-data operators.

Texts travel to Python as UTF-8 bytes (``cast('binary')``), batch by batch; a
batch is cut again into pieces of a few MB, so that the working memory of a task
does not depend on how many rows an Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.sources.staging import drop_staged, shared_folder, spread, staged  # noqa: F401  (this subpackage's modules take them from here)

#: ASCII white space, as in ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def row_of(df: DataFrame) -> Column:
    """The given row as one column ``given``, beside which helper columns can't clash with its own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("given")


def columns_of(df: DataFrame, **replaced: Column) -> list[Column]:
    """The given row's columns out of ``given``, some of them replaced."""
    return [replaced[c].alias(c) if c in replaced else F.col(f"given.`{c}`").alias(c) for c in df.columns]


def unused(name: str, taken: list[str]) -> str:
    """``name``, with bars in front of it until no column, whatever its case, is called so."""
    lower = {c.lower() for c in taken}
    while name in lower:
        name = f"_{name}"
    return name


def with_class(rows: DataFrame, classes: DataFrame, key: list[str], count: str, share: int = 1000) -> DataFrame:
    """``rows`` joined to ``classes``, which has one row of each ``key`` and how many rows it has in ``count``.

    Keys of more than one in ``share`` of the rows, of which there are fewer than ``share``,
    are broadcast; the rows of all others are shuffled. Keys are not null.
    """
    total = classes.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    heavy = F.broadcast(staged(classes.where(F.col(count) * share > total)))
    light = classes.where(F.col(count) * share <= total)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(*key), key, "left_anti").join(light, key))


def id_remainder(col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as remainder 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0).cast("long"))


def uniform(*cols: Column | str) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def bounded_sample(rows: DataFrame, by: str, n: int, key: list[str]) -> DataFrame:
    """At most ``n`` rows of distinct ``key`` for each value of ``by``, with their place ``n``, in an order that hashes of the key fix.

    The approximate number of distinct keys of each value first sets how small a hash must be for
    about four times as many rows to pass; these are made distinct where they lie, so hardly
    more rows than are wanted are ever ranked, however often a row is repeated.
    """
    rows = rows.select(by, *key, uniform(*key).alias("u"))
    counts = rows.groupBy(F.col(by).alias("value")).agg(F.approx_count_distinct("u").alias("count"))
    few = rows.join(F.broadcast(counts) if counts.limit(100_001).count() <= 100_000 else counts, F.col(by) == F.col("value")).where(F.col("u") * F.col("count") < 4 * n)
    few = few.groupBy(by, *key).agg(F.first("u").alias("u"))
    return few.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("u", *key))).where(F.col("n") <= n).drop("u")


def texts_of(docs: DataFrame, chosen: DataFrame, by: str) -> DataFrame:
    """``chosen(by, doc_id, text_hash, n)``, a bounded sample, with the whole texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.join(F.broadcast(chosen), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
    # of equal rows one; each task first keeps one of its own
    return met.groupBy(by, "doc_id", "text_hash", "n").agg(F.first("text").alias("text"))


def utf8(col: str = "text") -> Column:
    """Bytes of a text; null is empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches where the bytes of ``column`` pass ``limit``; no row is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size.astype(np.int64)) // limit
        cut = np.flatnonzero(np.diff(group)) + 1
        ends = [*cut.tolist(), batch.num_rows]
        start = 0
        for end in ends:
            yield batch.slice(start, end - start)
            start = end


def cut_by_bytes(texts: list[bytes], limit: int = 4 << 20) -> Iterator[list[bytes]]:
    """The texts in groups that end where their bytes pass ``limit``."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i + 1 == len(texts):
            yield texts[start : i + 1]
            start, size = i + 1, 0


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] values, then from starts[1], ..."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def runs_of(n: int, seed: int, most: int, run: int) -> list[tuple[int, int]]:
    """At most ``most`` of n places as (first, behind the last) of disjoint runs of about ``run``: all, if there are no more, else at places that ``seed`` draws."""
    if n <= most:
        return [(0, n)]
    count = max(1, most // run)
    size = most // count
    free = n - count * size
    dice = np.random.default_rng(seed & (1 << 63) - 1)
    gaps = np.sort(dice.integers(0, free + 1, count))
    return [(int(g) + i * size, int(g) + (i + 1) * size) for i, g in enumerate(gaps)]


def batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(v, type=t) if not isinstance(v, pa.Array) else v for v, t in columns.values()], names=list(columns)
    )
