"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct shingles; its sketch retains
the ``k`` smallest. Documents of equal sets are one class and never meet as pairs.

Inverted lists. Of two sets that reach the threshold, the sketches share so many values
(``_needed``) that, under one global order, each shares a value within a short prefix of the
other. Prefixes are taken with the values of few documents first, so passages that many documents
hold hardly make lists. What meets in a list is kept only if the sizes and the places in both prefixes leave room
for the overlap that is needed, and if bits of both sketches and the parities of both full sets do: of many long texts that are alike but
not linked, few pairs are left by these. Of pairs, the union's sketch (the k smallest values
of both) estimates the similarity, and what passes is verified on the full sets, which the sketches are for sets of up to k.

Groups. First every list's members meet its hub only, the class whose prefix reaches the value
first, which of near copies has least of its own; verified links make components. Then pairs of different components meet, many told at once
by a helper, in two-sided blocks where a list is long. So a group of n near copies costs n pairs, and no link between
components is lost. Copies and members of a component are never expanded into pairs.

Linked sets share o shingles or more, as sketches do that are the sets. Else the union's sketch holds k values, of
which no more than na + nb - 2 * o are in one set only; for large sets that says little, and ``share`` of k is taken: by the tail of
the binomial distribution, a pair at the threshold shares less in one case of 10^14 (k = 256, 0.65). All else is exact.

Cases: a null or empty text, or one of white space, has no shingles, links with nothing
and is kept; of fewer than ``width`` words the whole sequence is the one shingle; repeated rows are all returned, and rows
of one id with unlike texts are each looked at for themselves; a null id stands last among the ids of a component;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.analysis import pairs_up_to, starts_of, whole_groups
from lectern.llm.common import LOWER, batch, drop_staged, pieces, staged, utf8, with_class
from lectern.llm.components import connected
from lectern.operators.dedup import tiles

K, SHARE = 256, 0.65
PARITY = 1024  # bits
PIECE = 1 << 20
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word: the polynomial of its bytes, from differences of one running sum, then mixed."""
    raw = np.frombuffer(data, np.uint8)
    n = 1 << max(20, len(raw)).bit_length() if len(raw) > 1 << 20 else (1 << 20) + 1
    up, down = _powers(n)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _IS_WORD[raw], [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    return _mixed((total[end] - total[start]) * down[start]), start


def _parts(text: bytes, limit: int = PIECE) -> Iterator[bytes]:
    """A text in parts that end at white space behind ``limit`` bytes."""
    at = 0
    while at < len(text):
        cut = _WHITE.search(text, at + limit) if at + limit < len(text) else None
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    texts = [t.translate(LOWER) for t in texts]
    if sum(map(len, texts)) > PIECE:
        found = [[_words(p)[0] for p in _parts(t)] for t in texts]
        words = [np.concatenate(f) if f else np.zeros(0, np.uint64) for f in found]
    else:
        hashes, start = _words(b"\n".join(texts))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        words = np.split(hashes, np.searchsorted(start, ends)[:-1])
    out = []
    for w in words:
        n = min(width, len(w))
        h = np.full(max(0, len(w) - width + 1) if len(w) >= width else min(1, len(w)), n, np.uint64)
        for k in range(n):
            h = _mixed(h + w[k : k + len(h)])
        out.append(np.unique(h.view(np.int64)))
    return out


def _parity(s: np.ndarray) -> bytes:
    """For each of ``PARITY`` remainders, a bit: whether the set has an odd number of hashes of it."""
    return np.packbits((np.bincount(s & (PARITY - 1), minlength=PARITY) & 1).astype(np.uint8), bitorder="little").tobytes()


def signs(docs: DataFrame, width: int = 3, sketched: int | None = None) -> DataFrame:
    """doc_id, text_hash, sign (of the whole set), n (its size) of every row; ``sketched``: also sketch, so many of its smallest hashes, in order, and the set's parity."""
    schema = "doc_id long, text_hash long, sign binary, n int" + (", sketch array<bigint>, parity binary" if sketched else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            sets = shingle_sets(piece.column("text").to_pylist(), width)
            made = {"doc_id": (piece.column("doc_id"), None), "text_hash": (piece.column("text_hash"), None), "sign": ([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), "n": ([len(s) for s in sets], pa.int32())}
            yield batch(made | ({"sketch": (_lists([s[:sketched] for s in sets]), None), "parity": (list(map(_parity, sets)), pa.binary())} if sketched else {}))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), utf8().alias("text"))
    return rows.mapInArrow(run, schema)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


@lru_cache(maxsize=4)
def _least_needed(percent: int, k: int, floor: int) -> np.ndarray:
    """For a set of n shingles, n up to where nothing changes any more, the least that is needed with a set of any size that it can be linked to."""
    top = 8 * k
    out = np.zeros(top + 1, np.int64)
    for n in range(1, top + 1):
        m = np.arange(-(-percent * n // 100), 100 * n // percent + 1)
        o = -(-percent * (n + m) // (100 + percent))
        out[n] = np.where((n <= k) & (m <= k), o, np.maximum(k - (n + m - 2 * o), floor)).min()
    return np.minimum(out, np.minimum(np.arange(top + 1), k))


def _needed(na: Column, nb: Column, percent: int, k: int, floor: int) -> Column:
    na, nb = na.cast("long"), nb.cast("long")
    o = F.floor((percent * (na + nb) + 99 + percent) / (100 + percent))
    return F.when((na <= k) & (nb <= k), o).otherwise(F.greatest(F.lit(k) - (na + nb - 2 * o), F.lit(floor)))


def _frequent(classes: DataFrame, longest: int, least: int, per_bucket: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(values, classes) of the values that over ``least`` classes and more than one in ``longest`` of all are; sorted.

    Each task counts the values that it reads. What it counted moves in buckets of the value's first bits, as sorted differences, which
    are a few bytes each, and a bucket is counted up in one task; their number follows that of all values. Values are told apart by 40 bits:
    two that share these have one count, and so one place in the order.
    """
    total = classes.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0))).first()[0]
    bits = min(20, max(3, (total // per_bucket).bit_length()))
    low = 40 - bits

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.concatenate((np.searchsorted(value, np.arange(1 << bits) << low), [len(value)]))
            step = np.diff(value, prepend=value[:1])
            first = cut[:-1][np.diff(cut) > 0]
            step[first] = value[first]
            parts = [(k, step[a:b].tobytes(), n[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist(), strict=False)) if b > a]
            return batch({c: (list(v), t) for c, v, t in zip(("bucket", "step", "n"), zip(*parts, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)})

        for b in batches:
            values = b.column("sketch").flatten().to_numpy(zero_copy_only=False)
            if len(values):
                held.append((values.view(np.uint64) >> np.uint64(24)).astype(np.int64))
            if sum(map(len, held)) > per_bucket:
                yield close()
                held = []
        if held:
            yield close()

    schema = "bucket int, value long, df long"

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, n = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def close() -> pa.RecordBatch:
            often = n > max(least, total // longest)
            return batch({"bucket": (np.full(often.sum(), at), pa.int32()), "value": (value[often], pa.int64()), "df": (n[often], pa.int64())})

        for b in batches:
            for bucket, step, counts in zip(*(b.column(c).to_pylist() for c in ("bucket", "step", "n")), strict=True):
                if bucket != at:
                    if at is not None:
                        yield close()
                    at, value, n = bucket, np.zeros(0, np.int64), np.zeros(0, np.int64)
                value, place = np.unique(np.concatenate((value, np.cumsum(np.frombuffer(step, np.int64)))), return_inverse=True)
                n = np.bincount(place, weights=np.concatenate((n, np.frombuffer(counts, np.int64)))).astype(np.int64)
        if at is not None:
            yield close()

    counted = classes.select("sketch").mapInArrow(count, "bucket int, step binary, n binary")
    often = counted.repartition(1 << bits, "bucket").sortWithinPartitions("bucket").mapInArrow(add, schema).toArrow()
    values, df = often.column("value").to_numpy(), often.column("df").to_numpy()
    order = np.argsort(values)
    return values[order], df[order]


def _entries(classes: DataFrame, percent: int, k: int, floor: int, longest: int = 1_000_000, least: int = 32) -> DataFrame:
    """value, cls, n, place: the prefix of each class's sketch under the global order.

    Frequent are values of over ``least`` classes and more than one in ``longest`` of all values; the tasks get them, ``longest`` at most, by broadcast.
    """
    shared = classes.sparkSession.sparkContext.broadcast(_frequent(classes, longest, least))
    table = _least_needed(percent, k, floor)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, df = shared.value
        for b in batches:
            sizes = b.column("sketch").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = b.column("sketch").flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            short = (flat.view(np.uint64) >> np.uint64(24)).astype(np.int64)
            at = np.minimum(np.searchsorted(values, short), max(0, len(values) - 1))
            rank = np.where(values[at] == short, df[at], 0) if len(values) else np.zeros(len(flat), np.int64)
            flat = flat[np.lexsort((flat, rank, owner))]
            n = b.column("n").to_numpy()
            prefix = sizes - table[np.minimum(n, len(table) - 1)] + 1
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = place < prefix[owner]
            yield batch({"value": (flat[keep], None), "cls": (b.column("cls").take(pa.array(owner[keep])), None), "n": (n[owner[keep]], pa.int32()), "place": (place[keep], pa.int32())})

    return classes.select("cls", "n", "sketch").mapInArrow(run, "value long, cls long, n int, place int")


MARKS, ODD = [f"m{i}" for i in range(8)], [f"o{i}" for i in range(PARITY // 64)]  # words of 64 bits


def _marks(classes: DataFrame) -> DataFrame:
    """cls, n, held (values of the sketch), m0 to m7: a bit for each value of the sketch, by its last bits; o0 to o15: the whole set's parity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("sketch").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = b.column("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.zeros((len(sizes), len(MARKS) * 64), np.uint8)
            bits[np.repeat(np.arange(len(sizes)), sizes), (flat % np.uint64(len(MARKS) * 64)).astype(np.int64)] = 1
            odd = np.frombuffer(b"".join(b.column("parity").to_pylist()), "<i8").reshape(-1, len(ODD))
            words = np.concatenate((np.packbits(bits, axis=1, bitorder="little").view("<i8"), odd), axis=1)
            yield batch({"cls": (b.column("cls"), None), "n": (b.column("n"), None), "held": (sizes, pa.int32())} | {m: (np.ascontiguousarray(words[:, i]), None) for i, m in enumerate(MARKS + ODD)})

    return classes.select("cls", "n", "sketch", "parity").mapInArrow(run, "cls long, n int, held int, " + ", ".join(f"{m} long" for m in MARKS + ODD))


class Sets:
    """The classes of a table: ``classes(cls, sign, n, sketch, parity, rep)``, and the full sets of some of them."""

    def __init__(self, docs: DataFrame, width: int, k: int, percent: int, share: float):
        self.docs, self.width, self.k, self.percent, self.floor = docs, width, k, percent, int(np.ceil(share * k))
        rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("rep")
        grouped = signs(docs, width, k).groupBy("sign").agg(rep, F.count("*").alias("rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"))
        # numbers of partition and row: fixed, as the table is written
        self.classes = staged(grouped.withColumn("cls", F.monotonically_increasing_id()))
        self.marks = staged(_marks(self.classes))

    def near(self, a: str, b: str) -> Column:
        """Whether sizes and places leave room for the overlap that is needed."""
        n, p = F.col(f"n{a}").cast("long"), F.col(f"n{b}").cast("long")
        sketch = lambda c: F.least(c, F.lit(self.k))
        room = F.least(sketch(n) - F.col(f"place{a}"), sketch(p) - F.col(f"place{b}"))
        return (F.least(n, p) * 100 >= F.greatest(n, p) * self.percent) & (room >= _needed(n, p, self.percent, self.k, self.floor))

    def tight(self, a: str, b: str) -> Column:
        """Whether the sketches' bits leave room for it: a value whose bit the other sketch lacks is not in it, so bits bound the overlap from above.

        And whether the sets' parities do: each bit that differs takes a shingle of its own that only one of the sets has, so they bound the overlap of
        the whole sets, whatever their sizes.
        """
        alone = lambda x, y: reduce(add, [F.bit_count(F.col(f"{m}{x}").bitwiseAND(F.bitwise_not(f"{m}{y}"))) for m in MARKS])
        room = F.least(F.col(f"held{a}") - alone(a, b), F.col(f"held{b}") - alone(b, a))
        differ = reduce(add, [F.bit_count(F.col(f"{o}{a}").bitwiseXOR(F.col(f"{o}{b}"))) for o in ODD])
        sizes = F.col(f"n{a}").cast("long") + F.col(f"n{b}")
        return (room >= _needed(F.col(f"n{a}"), F.col(f"n{b}"), self.percent, self.k, self.floor)) & ((sizes - differ) * (100 + self.percent) >= sizes * 2 * self.percent)

    def tightly(self, pairs: DataFrame) -> DataFrame:
        """a, b of ``pairs(a, b)`` that are ``tight``."""
        mark = lambda c: self.marks.select(F.col("cls").alias(c), *[F.col(x).alias(f"{x}{c}") for x in ("n", "held", *MARKS, *ODD)])
        return pairs.join(mark("a"), "a").join(mark("b"), "b").where(self.tight("a", "b")).select("a", "b")

    def meeting(self, entries: DataFrame, block: int) -> DataFrame:
        """a, b (a < b) of ``entries(value, cls, n, place, root)``: pairs of unlike roots that meet under a value and are ``near`` and ``tight``, once or more.

        A task has its lists' members in the order of their sizes, so that each meets those only that are no larger than may be, and
        tells many pairs at once.
        """
        k, percent, floor, spread = self.k, self.percent, self.floor, 1 << 32
        dealt = tiles(entries, ["value"], block).join(self.marks.drop("n"), "cls")
        rows = dealt.repartition("value", "_i", "_j").sortWithinPartitions("value", "_i", "_j", "n")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in whole_groups(batches, ["value", "_i", "_j"]):
                of = lambda c: b.column(c).to_numpy()  # noqa: B023, E731
                cls, n, place, root, slot, held = of("cls"), of("n").astype(np.int64), of("place").astype(np.int64), of("root"), of("_slot"), of("held").astype(np.int64)
                within = of("_i") == of("_j")
                start = np.zeros(len(cls), np.int64)
                start[starts_of(of("value"), of("_i"), of("_j"))] = 1
                group = np.cumsum(start) * spread
                ends = np.searchsorted(group + n, group + n * 100 // percent, "right")
                bits, odd = (np.column_stack([of(c) for c in words]).view(np.uint64) for words in (MARKS, ODD))
                sketch = np.minimum(n, k)
                for x, y in pairs_up_to(ends):
                    meet = (root[x] != root[y]) & (within[x] | (slot[x] != slot[y]))
                    x, y = x[meet], y[meet]
                    sizes = n[x] + n[y]
                    shared = -(-percent * sizes // (100 + percent))
                    needed = np.where((n[x] <= k) & (n[y] <= k), shared, np.maximum(k - (sizes - 2 * shared), floor))
                    near = np.minimum(sketch[x] - place[x], sketch[y] - place[y]) >= needed
                    x, y, sizes, needed = x[near], y[near], sizes[near], needed[near]
                    alone = lambda p, q: np.bitwise_count(bits[p] & ~bits[q]).sum(1, dtype=np.int64)  # noqa: B023, E731
                    tight = np.minimum(held[x] - alone(x, y), held[y] - alone(y, x)) >= needed
                    x, y, sizes = x[tight], y[tight], sizes[tight]
                    differ = np.bitwise_count(odd[x] ^ odd[y]).sum(1, dtype=np.int64)
                    tight = (sizes - differ) * (100 + percent) >= sizes * 2 * percent
                    x, y = cls[x[tight]], cls[y[tight]]
                    if len(x):
                        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
                        yield batch({"a": (pairs[0], pa.int64()), "b": (pairs[1], pa.int64())})

        return rows.mapInArrow(run, "a long, b long")

    def full(self, wanted: DataFrame) -> DataFrame:
        """cls, full: the whole sets of the classes ``wanted(cls)``, from their representatives' texts."""
        of = self.classes.join(wanted, "cls", "left_semi").select("cls", F.col("rep.doc_id").alias("r_id"), F.col("rep.text_hash").alias("r_hash"))
        texts = self.docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), utf8().alias("text"))
        found = texts.join(of, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("hash") == F.col("r_hash"))).select("cls", "text")
        width = self.width

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "text", PIECE):
                yield batch({"cls": (piece.column("cls"), None), "full": (_lists(shingle_sets(piece.column("text").to_pylist(), width)), None)})

        # of repeated rows one
        return found.mapInArrow(run, "cls long, full array<bigint>").groupBy("cls").agg(F.first("full").alias("full"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """a, b of the written ``pairs(a, b)``, which are ``tight``, whose full sets reach the threshold."""
        members = staged(pairs.select(F.col("a").alias("cls")).distinct().unionByName(pairs.select(F.col("b").alias("cls")).distinct()).distinct())
        own = staged(self.classes.join(members, "cls", "left_semi").select("cls", "n", "sketch"))
        side = lambda c: own.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        shared = F.array_intersect("sa", "sb")
        whole = (F.col("na") <= self.k) & (F.col("nb") <= self.k)
        union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, self.k)
        estimate = F.size(F.array_intersect(shared, union))
        linked = lambda n: n.cast("long") * (100 + self.percent) >= (F.col("na").cast("long") + F.col("nb")) * self.percent
        kept = F.when(whole, linked(F.size(shared))).otherwise(estimate >= _needed(F.col("na"), F.col("nb"), self.percent, self.k, self.floor))
        passed = staged(both.where(kept).select("a", "b", "na", "nb", whole.alias("whole")))
        rest = passed.where("not whole")
        full = staged(self.full(rest.select(F.col("a").alias("cls")).distinct().unionByName(rest.select(F.col("b").alias("cls")).distinct()).distinct()))
        sets = lambda c: full.select(F.col("cls").alias(c), F.col("full").alias(f"f{c}"))
        exact = rest.join(sets("a"), "a").join(sets("b"), "b").where(linked(F.size(F.array_intersect("fa", "fb"))))
        out = staged(passed.where("whole").select("a", "b").unionByName(exact.select("a", "b")))
        drop_staged(members, own, passed, full)
        return out


def links(sets: Sets, block: int = 4096) -> DataFrame:
    """cls, root: the component of every class that is linked to another, by links through hubs and between what these leave apart."""
    entries = staged(_entries(sets.classes, sets.percent, sets.k, sets.floor))
    again = entries.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value")
    lists = staged(entries.join(again, "value"))
    drop_staged(entries)
    hubs = lists.groupBy("value").agg(F.min(F.struct("place", "cls", "n")).alias("hub")).select("value", *[F.col(f"hub.{c}").alias(f"{c}_h") for c in ("cls", "n", "place")])
    named = lists.select("value", *[F.col(c).alias(f"{c}_m") for c in ("cls", "n", "place")])
    met = named.join(hubs, "value").where((F.col("cls_m") != F.col("cls_h")) & sets.near("_m", "_h"))
    first = staged(sets.tightly(met.select(F.least("cls_m", "cls_h").alias("a"), F.greatest("cls_m", "cls_h").alias("b")).distinct()))
    found = sets.verified(first)
    roots = staged(connected(found))
    # lists whose members are not yet all in one component
    rooted = lists.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("value", "cls", "n", "place", F.coalesce("root", "cls").alias("root"))
    apart = rooted.groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("value")
    rest = staged(rooted.join(apart, "value"))
    second = staged(sets.meeting(rest, block).distinct().join(first, ["a", "b"], "left_anti"))
    more = sets.verified(second)
    for table in (lists, first, second, roots, rest):
        drop_staged(table)
    return connected(found.unionByName(more)).select(F.col("node").alias("cls"), "root")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, k: int = K, share: float = SHARE, block: int = 4096) -> DataFrame:
    """doc_id, n (size of the set), component_id of every row: 100 * intersection >= percent * union links two documents."""
    sets = Sets(docs, width, k, percent, share)
    rooted = sets.classes.select("cls", "sign", "rep", "rows").join(links(sets, block), "cls", "left").select("sign", F.coalesce("root", "cls").alias("root"), "rep", "rows")
    rooted = staged(rooted)
    drop_staged(sets.marks, sets.classes)
    least = rooted.groupBy("root").agg(F.min("rep").alias("least")).select("root", F.col("least.doc_id").alias("component_id"))
    named = staged(rooted.join(least, "root").select("sign", "component_id", "rows"))
    drop_staged(rooted)
    # signs are made again, which costs less than keeping every row's sketch
    marked = staged(signs(docs, width).select("doc_id", "n", "sign"))
    met = with_class(marked, named, ["sign"], "rows")
    return met.select("doc_id", F.col("n").cast("long").alias("n"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
