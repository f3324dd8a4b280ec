"""Bounded samples and pieces of batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.llm import common


def test_pieces_cut_between_rows():
    rows = [b"a" * n for n in (3, 0, 5, 100, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(range(7))], names=["text", "i"])
    cut = [p.column("i").to_pylist() for p in common.pieces([batch, batch.slice(0, 0)], "text", 8)]
    assert sum(cut, []) == list(range(7)) and len(cut) > 2


def test_bounded_sample(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("k"))
    a = common.bounded_sample(rows.repartition(3), "k", 50, ["doc_id"]).collect()
    b = common.bounded_sample(rows.repartition(7), "k", 50, ["doc_id"]).collect()
    assert sorted(a) == sorted(b) and {k: sum(r.k == k for r in a) for k in ("rare", "often")} == {"rare": 50, "often": 50}
    few = common.bounded_sample(rows.where("doc_id < 30"), "k", 50, ["doc_id"])
    assert few.count() == 30
    # repeated rows and null ids: distinct texts are ranked
    docs = spark.createDataFrame([(None, f"text {i}", "a") for i in range(300)] + [(5, "same", "a")] * 900 + [(None, "none", "b"), (6, None, "b")], "doc_id long, text string, k string")
    ids = docs.select("k", "doc_id", F.xxhash64("text").alias("text_hash"))
    got = common.texts_of(docs, common.bounded_sample(ids, "k", 100, ["doc_id", "text_hash"]), "k").collect()
    assert sum(r.k == "a" for r in got) == 100 and len({r.text for r in got}) == len(got) == 102 and {r.text for r in got if r.k == "b"} == {"none", ""}


def test_runs_of_places():
    for n in (0, 1, 59, 60, 61, 200, 10_000):
        for seed in (0, -5, 1 << 62):
            runs = common.runs_of(n, seed, 60, 12)
            assert sum(b - a for a, b in runs) == min(n, 60) and all(a <= b <= n for a, b in runs) and all(x[1] <= y[0] for x, y in zip(runs, runs[1:], strict=False))
    assert max(a for seed in range(50) for a, _ in common.runs_of(10_000, seed, 60, 12)) > 9000


def test_free_names(spark):
    assert common.unused("h", ["a", "H", "_h"]) == "__h"
    rows = spark.createDataFrame([(k % 3 if k < 6 else 9, k) for k in range(3000)], "k int, v int")
    classes = rows.groupBy("k").count().withColumn("name", F.col("k") * 10)
    got = common.with_class(rows, classes, ["k"], "count").collect()
    assert sorted((r.v, r.name) for r in got) == [(k, 10 * (k % 3 if k < 6 else 9)) for k in range(3000)]
