"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits are cut into two segments: of two that differ in at most
``distance`` = 2 bits, one segment differs by at most one bit. Every distinct
fingerprint is indexed under its two whole segments, and looked up under them and under
their variants with one bit left out, the wildcard; what is found is verified on all 64
bits. A variant that leaves out a bit that is 0 is the segment itself and is not put
down twice, so look-ups are made for the bits that are 1, and of a pair the
fingerprint that has the bit finds the other.

Buckets. An index entry of up to ``small`` fingerprints is one row that holds them, and
a look-up meets at most ``small`` of them. Fingerprints in a larger entry, and those
whose look-ups lead there, go by the exact way instead, of which no bucket can hold more
than 65 fingerprints: each is put down under itself and its 64 one-bit neighbours, and
those that meet under a value are within two bits; two within two bits always meet.
Only a star of links to the smallest is kept, so components come out whole.

Copies share a fingerprint and never meet as pairs. A fingerprint that over a
thousandth of all rows share is joined to them by broadcast (there are fewer than a
thousand of these), the others by shuffle.

Cases: a null or empty text, or one of white space, has the fingerprint zero,
which links like any other; of fewer than ``width`` words the whole sequence is
the one shingle; repeated rows are all returned; a null id stands last among the
ids of a component; an empty table gives an empty table; other columns are ignored
by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, batch, columns_of, drop_staged, pieces, row_of, staged, utf8, with_class
from lectern.llm.components import connected

HALF = 0xFFFFFFFF


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The hash of each shingle of a text, in order."""
    words = text.translate(LOWER).split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, 42)] if words else [], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], "<u8")


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        counts += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    return majority(shingle_hashes(text, width))


def several(text: bytes, width: int, tables: int) -> list[int]:
    """The fingerprint, and those of the same shingles under ``tables`` - 1 other hash functions."""
    h = shingle_hashes(text, width)
    out = [majority(h)]
    for k in range(1, tables):
        mixed = h * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(majority(mixed ^ mixed >> np.uint64(29)))
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            values = np.array([fingerprint(t, width) for t in piece.column("text").to_pylist()], np.uint64)
            yield batch({"doc_id": (piece.column("doc_id"), None), "fp": (values.view(np.int64), pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(compute, "doc_id long, fp long")


def fingerprint_tables(docs: DataFrame, width: int, tables: int) -> DataFrame:
    """doc_id, text_hash, f0, f1, ...: ``tables`` fingerprints of every row."""
    names = [f"f{k}" for k in range(tables)]

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            values = np.array([several(t, width, tables) for t in piece.column("text").to_pylist()], np.uint64).reshape(-1, tables).view(np.int64)
            yield batch({c: (piece.column(c), None) for c in ("doc_id", "text_hash")} | {c: (np.ascontiguousarray(values[:, k]), pa.int64()) for k, c in enumerate(names)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), utf8().alias("text"))
    return rows.mapInArrow(compute, ", ".join(f"{c} long" for c in ["doc_id", "text_hash", *names]))


def links(distinct: DataFrame, small: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """Links (a, b), a < b, between the distinct fingerprints ``fp`` within two bits, of each ``by``: all pairs
    that meet in small entries, stars in the others."""
    fp = F.col("fp")
    part = lambda segment: F.shiftrightunsigned(fp, 32 * segment).bitwiseAND(HALF)
    entry = lambda segment, value: F.struct(F.lit(segment).alias("segment"), value.alias("value"))
    index = distinct.select(*by, "fp", F.inline(F.array(*[entry(i, part(i)) for i in (0, 1)])))
    key = [*by, "segment", "value"]
    size = index.groupBy(*key).agg(F.count("*").alias("n"))
    held = index.join(size.where(F.col("n") <= small), key).groupBy(*key).agg(F.sort_array(F.collect_list("fp")).alias("held"))
    large = size.where(F.col("n") > small).select(*key)
    bits = F.array(*[F.when(F.getbit(fp, F.lit(32 * i + j)) == 1, entry(i, part(i).bitwiseAND(F.lit(HALF & ~(1 << j))))) for i in (0, 1) for j in range(32)])
    lookups = distinct.select(*by, "fp", F.inline(F.array_compact(bits)))
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= 2
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # by shuffle: Spark takes a table's look-ups to be as small as the table, and would broadcast them
    found = lookups.join(held.hint("merge"), key).select(*by, F.inline(F.transform(F.filter("held", lambda y: near(fp, y)), lambda y: pair(fp, y))))
    same = held.where(F.size("held") > 1).select(*by, F.inline(F.flatten(F.transform("held", lambda x: F.transform(F.filter("held", lambda y: (x < y) & near(x, y)), lambda y: pair(x, y))))))
    # the exact way for what meets in large entries
    crowd = index.join(large, key).select(*by, "fp").unionByName(lookups.join(large.hint("merge"), key).select(*by, "fp")).distinct()
    centre = crowd.select(*by, "fp", F.explode(F.array(fp, *[fp.bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), j)) for j in range(64)])).alias("centre"))
    stars = centre.groupBy(*by, "centre").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1).select(*by, "a", F.explode("all").alias("b")).where("a < b")
    return found.unionByName(same).unionByName(stars).distinct()


def _rooted(classes: DataFrame, small: int) -> DataFrame:
    """``classes`` (one row of each fp) with the root of its component."""
    # 32 look-ups for each fingerprint: dealt out first, however few bytes the fingerprints are
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = connected(links(classes.select("fp").repartition(parts, "fp"), small))  # fp, root: of linked fingerprints only
    return classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, width: int = 3, small: int = 64) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    marked = staged(fingerprints(docs, width))
    # one representative of each fingerprint: its smallest id
    classes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    rooted = staged(_rooted(classes, small))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows"))
    named = rooted.join(least, "root").select("fp", "component_id", "n")
    return with_class(marked, named, ["fp"], "n").select("doc_id", "fp", "component_id")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rooted_tables(classes: DataFrame, tables: int, small: int) -> DataFrame:
    """node, root of the rows of ``classes(node, f0, f1, ...)`` that are linked to others, within two bits in one table at least."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = classes.select("node", F.posexplode(F.array(*[F.col(f"f{k}") for k in range(tables)])).alias("table", "fp"))
    first = staged(own.groupBy("table", "fp").agg(F.min("node").alias("first")))
    same = own.join(first, ["table", "fp"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    side = lambda c: first.select("table", F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    near = links(first.select("table", "fp").repartition(parts, "table", "fp"), small, ("table",))
    across = near.join(side("a"), ["table", "a"]).join(side("b"), ["table", "b"]).where("a_first <> b_first")
    edges = staged(same.unionByName(across.select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))).distinct())
    drop_staged(first)
    out = staged(connected(edges))
    drop_staged(edges)
    return out


def drop_near_duplicates(docs: DataFrame, width: int = 2, tables: int = 8, small: int = 64) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id (null last), then the smallest text hash; of rows equal in both, one.

    Links are within two bits of 64 in one of ``tables`` fingerprints under as many hash functions: a near copy that one function sets apart is met by another.

    Rows are kept by a join on id and text hash. Only of ids and texts that occur several
    times one row has to be chosen, by an aggregation that each task begins with its own rows.
    """
    marked = staged(fingerprint_tables(docs, width, tables))
    names = [f"f{k}" for k in range(tables)]
    grouped = marked.groupBy(*names).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least"))
    # numbers of partition and row: fixed, as the table is written
    classes = staged(grouped.withColumn("node", F.monotonically_increasing_id()))
    rooted = classes.join(_rooted_tables(classes, tables, small), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("k_id"), F.col("least.text_hash").alias("k_hash"))
    often = marked.groupBy(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash")).agg(F.count("*").alias("rows")).where("rows > 1")
    counted = staged(kept.join(often, F.col("k_id").eqNullSafe(F.col("r_id")) & (F.col("k_hash") == F.col("r_hash")), "left").select("k_id", "k_hash", F.col("rows").isNotNull().alias("again")))
    given = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    match = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash"))
    once = given.join(counted.where("not again"), match, "left_semi")
    order = F.xxhash64(*[F.col(f"given.`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    one = given.join(counted.where("again"), match, "left_semi").groupBy("id", "hash").agg(F.min_by("given", order).alias("given"))
    return once.select("given").unionByName(one.select("given")).select(*columns_of(docs))
