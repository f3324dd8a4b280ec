"""Alignment of two tokenizers' tokens by interval coalescing.

Tokens A and B of a text are byte ranges over the same bytes. All ranges of a piece of
the table are sorted by start in one lexsort; over the running maximum of their ends, a
group breaks where a start reaches that maximum, which is where tokens of both end.
Inside a group every A token is linked to every B token. The pairs of ids that a
document links are kept once, with how many links each has, and their counts over all
documents come from one combining aggregation.

The counts that are looked up for every link are shared with the tasks in blocks of at
most ``block`` pairs, one pass over the written alignment for each block. Pairs of one
document are in no block: what a block lacks counts one. How often an id of A is linked
at its best is one number an id, bounded by the vocabulary.

Cases: a null or empty text, and one whose tokens of A or of B do not spell a space and
the text (white space or characters that a tokenizer changes), has no tokens: zeros and
an empty digest; special tokens' strings are plain text; a group of very many tokens is
expanded by its distinct ids, with how often each occurs; repeated rows are each aligned
and each count as a document; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batch, drop_staged, pieces, ranges, staged, utf8

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at once, unless one text has more.
PIECE = 1 << 20
#: A space between two characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Parts of texts that a worker remembers at most; of their ids eight times as many.
REMEMBERED = 400_000
#: Links of a group beyond which it is expanded by its distinct ids.
WIDE = 1 << 16
FOUND = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<int>"


class Sides:
    """Both tokenizers, with the bytes of every entry and the texts of every id."""

    def __init__(self, name_a: str, name_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        place = lambda name: name if os.path.isabs(name) else public_tokenizers.path(name)
        self.a = Tokenizer.from_file(place(name_a))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=place(name_b))
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        as_byte = byte_characters()
        entry = lambda token: bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_a = _objects([entry(self.a.id_to_token(i) or "") for i in range(self.size_a)])
        self.bytes_b = _objects([piece(i) for i in range(self.size_b)])
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # every id's text, followed by each of the three marks
        self.said = _objects([f"{i}{mark}" for i in range(max(self.size_a, self.size_b)) for mark in ",|;"])
        # whether no token of B spans a space behind another character, and no character is changed before encoding
        probe = "ﬁ１Ǻ"
        local = all("▁" not in self.b.id_to_piece(i).lstrip("▁") for i in range(self.size_b)) and b"".join(self.bytes_b[self.b.encode(probe)]) == f" {probe}".encode()
        self.cut = CUT.split if local else lambda text: [text]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.count = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.right = np.zeros(0, bool)

    def plainly(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both tokenizers' ids of each text behind a space."""
        return [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)

    def learn(self, parts: list[str]) -> None:
        """Encode parts that were not met before, and see whether their tokens spell them."""
        right = np.ones(len(parts), bool)
        for k, (lists, table) in enumerate(zip(self.plainly(parts), (self.bytes_a, self.bytes_b), strict=True)):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.int64, n.sum())
            entries, at = table[ids].tolist(), np.concatenate(([0], np.cumsum(n))).tolist()
            right &= np.fromiter((b"".join(entries[at[i] : at[i + 1]]) == b" " + p.encode() for i, p in enumerate(parts)), bool, len(parts))
            self.flat[k], self.count[k] = np.concatenate((self.flat[k], ids)), np.concatenate((self.count[k], n))
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.right = np.concatenate((self.right, right))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(whether both spell a text, for A and B all ids and how many each text has); a text that is not spelled has none.

        No token spans a space between two other characters, so what stands between such spaces is encoded once, while a worker remembers it.
        """
        if len(self.known) > REMEMBERED or len(self.flat[0]) > 8 * REMEMBERED:
            self.forget()
        parts = [self.cut(t) if (t := _decoded(text)) else [] for text in texts]
        new = set(chain.from_iterable(parts)).difference(self.known)
        if new:
            self.learn(sorted(new))
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        place = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, n.sum())
        doc = np.repeat(np.arange(len(texts)), n)
        spelled = (n > 0) & (np.bincount(doc, weights=~self.right[place], minlength=len(texts)) == 0)
        place, doc = place[spelled[doc]], doc[spelled[doc]]
        out = []
        for flat, count in zip(self.flat, self.count, strict=True):
            first = np.cumsum(count) - count
            out.append((flat[ranges(first[place], count[place])], np.bincount(doc, weights=count[place], minlength=len(texts)).astype(np.int64)))
        return spelled, out


def _decoded(text: bytes) -> str | None:
    try:
        return text.decode()
    except UnicodeDecodeError:  # no tokens spell it
        return None


def byte_characters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: visible Latin-1 characters stand for themselves, the other bytes, in order, for those from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


@lru_cache(maxsize=2)
def sides(name_a: str = TOKENIZER_A, name_b: str = TOKENIZER_B) -> Sides:
    return Sides(name_a, name_b)


def coalesced(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the order of the intervals by start, and in this order each one's group, from 0."""
    order = np.lexsort((ends, starts))
    if not len(order):
        return order, order
    reached = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), np.int64)
    breaks[0] = 0
    breaks[1:] = starts[order][1:] >= reached[:-1]
    return order, np.cumsum(breaks)


class Aligned:
    """The tokens of some texts in groups: ``ids``, ``side`` (0 or 1), ``start``, ``end`` in their texts, ``group`` and ``doc``, ordered by group, side and start."""

    def __init__(self, texts: list[bytes], both: Sides):
        self.both, self.n_docs = both, len(texts)
        spelled, found = both.encode(texts)
        size = np.where(spelled, np.fromiter(map(len, texts), np.int64, len(texts)) + 1, 0)
        base = np.cumsum(size) - size
        made = []
        for side, ((ids, n), lengths) in enumerate(zip(found, (both.length_a, both.length_b), strict=True)):
            doc = np.repeat(np.arange(self.n_docs), n)
            ends = np.cumsum(lengths[ids])  # the texts stand one behind the other
            made.append((ids, doc, ends - lengths[ids], ends, np.full(len(ids), side, np.int8)))
        ids, doc, starts, ends, side = (np.concatenate(x) for x in zip(*made, strict=True))
        order, group = coalesced(starts, ends)
        back = np.argsort((group << 1) + side[order], kind="stable")
        order, self.group = order[back], group[back]
        self.ids, self.doc, self.side = ids[order], doc[order], side[order]
        self.start, self.end = starts[order] - base[self.doc], ends[order] - base[self.doc]
        self.n_groups = int(self.group[-1]) + 1 if len(self.group) else 0
        self.n_a = np.bincount(self.group[self.side == 0], minlength=self.n_groups)
        self.n_b = np.bincount(self.group[self.side == 1], minlength=self.n_groups)
        self.first = np.cumsum(self.n_a + self.n_b) - self.n_a - self.n_b
        self.doc_of_group = self.doc[self.first] if self.n_groups else np.zeros(0, np.int64)

    def of_documents(self, per_group: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc_of_group, weights=per_group, minlength=self.n_docs).astype(np.int64)

    def digests(self) -> list[str]:
        """For each text, sha256 of its groups as ``a1,a2|b1;a3|b2,b3``."""
        n = len(self.ids)
        if not n:
            return [""] * self.n_docs
        last_of_group, turn = np.ones(n, bool), np.zeros(n, bool)
        last_of_group[:-1] = self.group[1:] != self.group[:-1]
        turn[:-1] = ~last_of_group[:-1] & (self.side[1:] != self.side[:-1])
        said = self.both.said[self.ids * 3 + np.where(last_of_group, 2, turn)].tolist()
        at = np.searchsorted(self.doc, np.arange(self.n_docs + 1)).tolist()
        return [hashlib.sha256("".join(said[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(at, at[1:], strict=False)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, pair, links) of every pair of ids that a text links, ordered by text and pair; a pair is a * size_b + b."""
        width = self.both.size_a * self.both.size_b
        wide = self.n_a * self.n_b > WIDE
        inside = ~wide[self.group] & (self.side == 0)
        groups = self.group[inside]
        counts = self.n_b[groups]
        b = self.ids[ranges(self.first[groups] + self.n_a[groups], counts)]
        keys = [np.repeat(self.doc[inside] * width + self.ids[inside] * self.both.size_b, counts) + b]
        times = [np.ones(len(b), np.int64)]
        for g in np.flatnonzero(wide).tolist():
            x = self.first[g]
            ids_a, n_a = np.unique(self.ids[x : x + self.n_a[g]], return_counts=True)
            ids_b, n_b = np.unique(self.ids[x + self.n_a[g] : x + self.n_a[g] + self.n_b[g]], return_counts=True)
            keys.append((self.doc_of_group[g] * width + (ids_a * self.both.size_b)[:, None] + ids_b).reshape(-1))
            times.append((n_a[:, None] * n_b).reshape(-1))
        if len(keys) == 1:
            key, n = np.unique(keys[0], return_counts=True)
        else:
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate(times)).astype(np.int64)
        return key // width, key % width, n


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))


def groups(docs: DataFrame, name_a: str = TOKENIZER_A, name_b: str = TOKENIZER_B) -> DataFrame:
    """doc_id, group, start, end (bytes, counted from the space in front of the text), a, b (ids, in order): a row for each group of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            found = Aligned(piece.column("text").to_pylist(), sides(name_a, name_b))
            if not found.n_groups:
                continue
            a = found.side == 0
            lists = lambda n, inside: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(found.ids[inside], pa.int32()))  # noqa: B023, E731
            place = np.arange(found.n_groups) - np.searchsorted(found.doc_of_group, found.doc_of_group)
            start, end = found.start[found.first], np.maximum.reduceat(found.end, found.first)
            yield batch({"doc_id": (piece.column("doc_id").take(pa.array(found.doc_of_group)), None), "group": (place, pa.int32()), "start": (start, pa.int64()), "end": (end, pa.int64()), "a": (lists(found.n_a, a), None), "b": (lists(found.n_b, ~a), None)})

    return _texts(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, group int, start long, end long, a array<int>, b array<int>")


def linked(docs: DataFrame, name_a: str = TOKENIZER_A, name_b: str = TOKENIZER_B) -> DataFrame:
    """A row for each document: ``FOUND``, with the pairs of ids that it links and how many links each has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            found = Aligned(piece.column("text").to_pylist(), sides(name_a, name_b))
            doc, pair, n = found.pairs()
            at = pa.array(np.searchsorted(doc, np.arange(found.n_docs + 1)), pa.int32())
            yield batch({
                "row": (piece.column("row"), None), "doc_id": (piece.column("doc_id"), None), "n_a": (found.of_documents(found.n_a), pa.int64()), "n_b": (found.of_documents(found.n_b), pa.int64()),
                "n_groups": (found.of_documents(np.ones(found.n_groups)), pa.int64()), "n_links": (found.of_documents(found.n_a * found.n_b), pa.int64()), "groups_sha256": (found.digests(), pa.string()),
                "pairs": (pa.ListArray.from_arrays(at, pa.array(pair)), None), "times": (pa.ListArray.from_arrays(at, pa.array(n, pa.int32())), None),
            })

    return _texts(docs).mapInArrow(run, FOUND)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n: how many documents link the pair."""
    return found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def _looked_up(found: DataFrame, table) -> DataFrame:
    """``found`` without its pairs, with n_best and count_sum over the pairs of the block; what its table lacks counts one."""
    kept = [c for c in found.columns if c not in ("pairs", "times")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best_of, size_b, blocks, k = table.value
        for b in batches:
            pair, times = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pairs", "times"))
            owner = np.repeat(np.arange(b.num_rows), b.column("pairs").value_lengths().to_numpy(zero_copy_only=False))
            place = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            known = keys[place] == pair if len(keys) else np.zeros(len(pair), bool)
            n = np.where(known, counts[place] if len(counts) else 1, 1)
            own = pair % blocks == k
            sums = [np.zeros(b.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], owner, np.where(own & (n == best_of[pair // size_b]), times, 0))
            np.add.at(sums[1], owner, np.where(own, times * n, 0))
            yield batch({c: (b.column(c), None) for c in kept} | {"n_best": (sums[0], pa.int64()), "count_sum": (sums[1], pa.int64())})

    return found.mapInArrow(run, FOUND.split(", pairs")[0] + ", n_best long, count_sum long")


def digests(docs: DataFrame, name_a: str = TOKENIZER_A, name_b: str = TOKENIZER_B, block: int = 4_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    both = sides(name_a, name_b)
    found = staged(linked(docs, name_a, name_b))
    counts = staged(pair_counts(found))
    size_b = F.lit(both.size_b).cast("long")
    best_of = np.zeros(both.size_a, np.int64)
    best = counts.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("n").alias("n")).toArrow()
    best_of[best.column("a").to_numpy()] = best.column("n").to_numpy()
    often = counts.where("n > 1")
    blocks = max(1, -(-often.count() // block))
    out = None
    for k in range(blocks):
        part = often.where(F.col("pair") % blocks == k).select("pair", "n").toArrow()
        keys, n = part.column("pair").to_numpy(), part.column("n").to_numpy()
        order = np.argsort(keys)
        shared = spark.sparkContext.broadcast((keys[order], n[order], best_of, both.size_b, blocks, k))
        passed = _looked_up(found, shared)
        out = passed if out is None else out.unionByName(passed)
    if blocks > 1:
        same = [c for c in out.columns if c not in ("row", "n_best", "count_sum")]
        out = out.groupBy("row").agg(*[F.first(c).alias(c) for c in same], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    drop_staged(counts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
