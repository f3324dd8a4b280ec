"""Benchmark decontamination by a broadcast hash set of test n-grams.

The benchmark's items are cut into windows of ``n`` words (an item of fewer is
one window). Their hashes are broadcast; each document's words are numbered
among the benchmark's words, windows are hashed in vectors, and every hash that
meets the set is compared word by word. No shuffle.

The set is broadcast in blocks of items whose texts sum to ``block_bytes`` at
most, whatever the benchmark's size; of a benchmark with more than one block the
documents are scanned once a block and the hits of a document united by key.

Cases: null and empty texts have no words and no hits; an item without words
never occurs; equal items all count; repeated rows are each reported; an empty
benchmark or table gives no hits; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import LOWER, batch, columns_of, cut_by_bytes, pieces, row_of, utf8

#: Lower-cases A-Z; what is no word character becomes a space.
WORDS = bytes(b if 48 <= b <= 57 or b >= 128 else l if 97 <= (l := LOWER[b]) <= 122 else 32 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("items", T.ArrayType(T.StringType())),
])


def hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash, modulo 2^64, of each run of n numbers."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        out = out * BASE + ids[k : k + len(out)].astype(np.uint64)
    return out


class Windows:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in text.translate(WORDS).split()]
            for i in range(max(1, len(ids) - n + 1) if ids else 0):
                owners[tuple(ids[i : i + n])].add(item)
        self.owners = {k: sorted(v) for k, v in owners.items()}
        self.hashes = {m: np.unique(np.array([hashes(np.array(k), m)[0] for k in self.owners if len(k) == m], np.uint64)) for m in sorted({*map(len, self.owners)})}

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(first, length, window) of each occurrence; ids hold 0 for words of no item."""
        outside = np.concatenate(([0], np.cumsum(ids == 0)))
        for m, known in self.hashes.items():
            at = np.flatnonzero(outside[m:] == outside[:-m]) if len(ids) >= m else []
            if len(at):
                sums = np.zeros(len(at), np.uint64)
                for k in range(m):
                    sums = sums * BASE + ids[at + k].astype(np.uint64)
                place = np.minimum(np.searchsorted(known, sums), len(known) - 1)
                for i in at[known[place] == sums].tolist():
                    window = tuple(ids[i : i + m].tolist())
                    if window in self.owners:
                        yield i, m, window


def occurrences(windows: Windows, texts: list[bytes]) -> tuple[np.ndarray, Iterator[tuple[int, int, int, tuple[int, ...]]]]:
    """(words of each text; (text, first word, length, window) of each occurrence)."""
    get = windows.number.get
    split = [t.translate(WORDS).split() for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((get(w, 0) for w in chain.from_iterable(split)), np.int64, int(lengths.sum()))
    # a 0 behind each text keeps windows within it
    spaced = np.zeros(len(ids) + len(split), np.int64)
    spaced[np.arange(len(ids)) + np.repeat(np.arange(len(split)), lengths)] = ids
    first = np.cumsum(lengths) - lengths + np.arange(len(split))

    def found() -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
        for at, m, window in windows.find(spaced):
            d = int(np.searchsorted(first, at, side="right")) - 1
            yield d, at - int(first[d]), m, window

    return lengths, found()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded bytes (an item is never cut)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8().alias("text")).where(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = -(-total // (block_bytes // 2)) or 1
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else items
        block, size = [], 0
        for row in part.toLocalIterator():
            if block and size + len(row.text) > block_bytes:
                yield block
                block, size = [], 0
            block.append((row.item_id or "", bytes(row.text)))
            size += len(row.text)
        yield block


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """A row per document: doc_id, text_hash, n_words, spans (disjoint word ranges
    that are hit), items (sorted ids of the items with an occurring window)."""
    spark = docs.sparkSession

    def scan(block: list[tuple[str, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Windows(block, n))

        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for piece in pieces(batches, "text"):
                lengths, found = occurrences(windows, piece.column("text").to_pylist())
                spans, items = defaultdict(list), defaultdict(set)
                for d, at, m, window in found:
                    spans[d].append((at, at + m))
                    items[d].update(windows.owners[window])
                yield batch({
                    "doc_id": (piece.column("doc_id"), None), "text_hash": (piece.column("text_hash"), None), "n_words": (lengths, pa.int64()),
                    "spans": ([[{"start": a, "end": b} for a, b in merged(spans[d])] if d in spans else [] for d in range(len(lengths))], SPANS),
                    "items": ([sorted(items[d]) if d in items else [] for d in range(len(lengths))], pa.list_(pa.string())),
                })

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), utf8().alias("text")).mapInArrow(search, FOUND)

    scans = [scan(block) for block in _blocks(benchmark, block_bytes)]
    if len(scans) == 1:
        return scans[0]
    # repeated rows of a document are counted in the first block and restored at the end
    tagged = [s.withColumn("rows", F.lit(int(not i))) for i, s in enumerate(scans)]
    united = tagged[0]
    for s in tagged[1:]:
        united = united.unionByName(s.where(F.size("items") > 0))
    together = united.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.sum("rows").alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    unite = F.aggregate(
        "spans", F.lit([]).cast(FOUND["spans"].dataType),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    return together.withColumn("spans", unite).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(*FOUND.names)


def hit_digests(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]).cast("long"))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` without the documents that hold an item's window; all columns and
    repeated rows stay, and no row moves: each block of items is a filter."""

    def clean(shared):
        @F.pandas_udf("boolean")
        def keep(texts):
            out, at = np.ones(len(texts), bool), 0
            for some in cut_by_bytes([bytes(t) for t in texts]):
                out[[at + d for d, *_ in occurrences(shared.value, some)[1]]] = False
                at += len(some)
            return type(texts)(out)

        return keep

    for block in _blocks(benchmark, block_bytes):
        docs = docs.where(clean(docs.sparkSession.sparkContext.broadcast(Windows(block, n)))(utf8()))
    return docs


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with the hit words cut out of their texts (what stands between words of a span goes, too)."""
    hits = find_hits(docs, benchmark, n, block_bytes).where(F.size("items") > 0).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "spans").dropDuplicates(["hit_id", "hit_hash"])

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for text, ranges in zip(texts, spans, strict=True):
            if ranges is not None and len(ranges):
                raw = text.encode()
                flags = np.frombuffer(raw.translate(WORDS), np.uint8) != 32
                starts = np.flatnonzero(flags & ~np.concatenate(([False], flags[:-1])))
                ends = np.flatnonzero(flags & ~np.concatenate((flags[1:], [False]))) + 1
                at, kept = 0, []
                for r in ranges:
                    kept.append(raw[at : starts[r["start"]]])
                    at = ends[r["end"] - 1]
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        return type(texts)(out)

    given = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    joined = given.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("hash") == F.col("hit_hash")), "left").select("given", cut("given.text", "spans").alias("remaining"))
    return joined.select(*columns_of(docs, text=F.col("remaining")))
