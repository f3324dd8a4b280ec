"""A term index of immutable segments, so that an edit writes the rows of its documents only.

A segment holds the counted terms of some chunks, and how document frequencies and
corpus statistics change with it: its own terms count up, those of the chunks that it
replaces down. Replaced chunks are tombstones, which hide rows of the segments before theirs. Readers merge: rows
without those that are hidden, and sums of the changes. Segments of like size are compacted into one.
A list of segments is one commit, so writers at the same time both get theirs in, and readers see whole lists.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.analysis import tokenize
from lectern.operators.index import Analyzer, _places, _postings, term_counts
from lectern.sources.files import commit, commits

COUNTED = "terms array<struct<word:string,tf:int>>, gaps array<array<int>>, token_count int"


def segments(spark: SparkSession, root: str) -> list[dict]:
    """name, order and rows of each segment, in order."""
    known = commits(spark, root)
    return json.loads(known[-1][1]) if known else []


def _counted(spark: SparkSession, root: str, among: list[dict], at: DataFrame | None = None) -> DataFrame | None:
    """The counted chunks of ``among`` that no later segment hides; with ``at(doc_id)``, of these documents."""
    if not among:
        return None
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{root}/{s['name']}/counted").withColumn("_order", F.lit(s["order"])) for s in among])
    if at is not None:
        rows = rows.join(at.select("doc_id").distinct(), "doc_id", "left_semi")
    hidden = [spark.read.parquet(f"{root}/{s['name']}/replaced").withColumn("_by", F.lit(s["order"])) for s in among if s["replaced"]]
    if not hidden:
        return rows.drop("_order")
    latest = reduce(DataFrame.unionByName, hidden).groupBy(F.col("doc_id").alias("_doc")).agg(F.max("_by").alias("_by"))
    return rows.join(latest, (F.col("doc_id") == F.col("_doc")) & (F.col("_order") < F.col("_by")), "left_anti").drop("_order")


def _words(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(F.explode("terms.word").alias("word")).groupBy("word").agg((F.count("*") * sign).alias("ndoc"))


def write_segment(chunks: DataFrame, root: str, analyzer: Analyzer = tokenize, replace: bool = True) -> str:
    """Index ``chunks(id, doc_id, text)``, and hide what earlier segments hold of their documents. Only these documents' rows are read and written.

    Another writer's segment may be committed in between; the changes are then made against the list that it left.
    """
    spark = chunks.sparkSession
    name = f"segment-{uuid.uuid4().hex}"
    counted = term_counts(chunks, analyzer).join(chunks.select(F.col("id").alias("chunk_id"), "doc_id"), "chunk_id")
    counted.write.parquet(f"{root}/{name}/counted")
    own = spark.read.parquet(f"{root}/{name}/counted")
    size = own.count()

    def listed(last: str | None) -> str:
        before = json.loads(last) if last else []
        old = _counted(spark, root, before, own) if replace else None
        words, stats = _words(own, 1), own.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
        if old is not None:
            words = words.unionByName(_words(old, -1)).groupBy("word").agg(F.sum("ndoc").alias("ndoc")).where("ndoc <> 0")
            stats = stats.unionByName(old.agg((-F.count("*")).alias("chunks"), F.coalesce(-F.sum("token_count"), F.lit(0)).alias("tokens"))).agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens"))
        words.write.mode("overwrite").parquet(f"{root}/{name}/words")
        stats.write.mode("overwrite").parquet(f"{root}/{name}/stats")
        own.select("doc_id").distinct().write.mode("overwrite").parquet(f"{root}/{name}/replaced")
        return json.dumps([*before, {"name": name, "order": max((s["order"] for s in before), default=0) + 1, "rows": size, "replaced": replace}])

    commit(spark, root, listed)
    return name


def read_segments(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """terms, places, lexemes, stats, as ``index.build_index`` has them."""
    known = segments(spark, root)
    counted = _counted(spark, root, known)
    union = lambda part: reduce(DataFrame.unionByName, [spark.read.parquet(f"{root}/{s['name']}/{part}") for s in known])
    lexemes = union("words").groupBy("word").agg(F.sum("ndoc").alias("ndoc")).where("ndoc > 0")
    total = union("stats").agg(F.sum("chunks").alias("n"), F.sum("tokens").alias("t"))
    stats = total.select(F.col("n").alias("chunk_count"), F.when(F.col("n") > 0, F.col("t") / F.col("n")).otherwise(0.0).alias("avg_len"))
    return {"terms": _postings(counted), "places": _places(counted), "lexemes": lexemes, "stats": stats}


def compact(spark: SparkSession, root: str, tier: int = 4) -> int:
    """Merge the newest segments while ``tier`` of them, or more, are of one size class (powers of ``tier``); how many were merged.

    Only neighbours in the list are merged, so what hides what stays as it is; rows that the merged ones hide of each other are dropped,
    and their tombstones stay for the segments before.
    """
    known = segments(spark, root)
    level = lambda s: max(0, int(s["rows"]).bit_length() - 1) // max(1, tier.bit_length() - 1)
    run: list[dict] = []
    for s in reversed(known):
        if run and level(s) > max(map(level, run)) and len(run) >= tier:
            break
        if run and level(s) > max(map(level, run)) + 1:
            break
        run.insert(0, s)
    if len(run) < tier:
        return 0
    name = f"segment-{uuid.uuid4().hex}"
    _counted(spark, root, run).write.parquet(f"{root}/{name}/counted")
    union = lambda part: reduce(DataFrame.unionByName, [spark.read.parquet(f"{root}/{s['name']}/{part}") for s in run])
    union("words").groupBy("word").agg(F.sum("ndoc").alias("ndoc")).where("ndoc <> 0").write.parquet(f"{root}/{name}/words")
    union("stats").agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens")).write.parquet(f"{root}/{name}/stats")
    union("replaced").distinct().write.parquet(f"{root}/{name}/replaced")
    rows = spark.read.parquet(f"{root}/{name}/counted").count()
    merged = {s["name"] for s in run}

    def listed(last: str | None) -> str:
        now = json.loads(last or "[]")
        if not merged <= {s["name"] for s in now}:
            raise RuntimeError("another compaction has merged these segments")
        at = next(i for i, s in enumerate(now) if s["name"] in merged)
        one = {"name": name, "order": run[-1]["order"], "rows": rows, "replaced": any(s["replaced"] for s in run)}
        return json.dumps([*now[:at], one, *[s for s in now[at:] if s["name"] not in merged]])

    commit(spark, root, listed)
    return len(run)
