"""The default analyzer, and sets of shingles, as helpers over Arrow batches.

``tokenize`` here gives the terms of ``lectern.functions.text.tokenize``, which says the
same in built-in expressions. Those are interpreted word by word; here each distinct
raw word is stemmed once while a worker remembers it, and a text is one pattern
search and look-ups.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import STOP_WORDS, SUFFIX_RULES

RAW = re.compile(r"[a-z0-9][a-z0-9'$,.]*")
_STOP = frozenset(STOP_WORDS)
_RULES = [(re.compile(p), by.replace("$", "\\")) for p, by in SUFFIX_RULES]
Words = Callable[[str | None], list[str]]


def term_of(raw: str) -> str | None:
    """The term of a raw word; None for one that is left out."""
    word = raw.rstrip("',.")
    if len(word) <= 1 or word in _STOP:
        return None
    if len(word) <= 3 or re.search("[0-9$]", word):
        return word
    if word.endswith("s"):
        word = re.sub("([^aeious])s$", r"\1", re.sub("(ss|i)es$", r"\1", word))
    for pattern, by in _RULES:
        if pattern.search(word) and len(short := pattern.sub(by, word)) >= 3:
            return short
    return word


class _Terms(dict):
    """Terms by raw word, those met since the last clearing."""

    def __missing__(self, raw: str) -> str | None:
        if len(self) >= 500_000:
            self.clear()
        self[raw] = out = term_of(raw)
        return out


_terms = _Terms()


def terms(text: str | None) -> list[str]:
    return [t for t in map(_terms.__getitem__, RAW.findall((text or "").lower())) if t]


def analyzer(words: Words, placed: Callable[[str | None], list[tuple[str, int]]] | None = None) -> Callable[[Column | str], Column]:
    """A column function, array of terms in order, of a plain function of a text, which ``.words`` keeps.

    ``placed`` gives terms with their positions, where these are not the terms' own numbers; ``.placed`` keeps it.
    """

    def tokens(c: Column | str) -> Column:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(list(map(words, texts)), index=texts.index, dtype=object)

        return F.pandas_udf(run, "array<string>")(F.col(c) if isinstance(c, str) else c)

    tokens.words, tokens.placed = words, placed
    return tokens


tokenize = analyzer(terms)

_TERM = pa.struct([("word", pa.string()), ("tf", pa.int32())])
COUNTED = "token_count int, terms array<struct<word:string,tf:int>>, gaps array<array<int>>"


def pieces(batches: Iterable[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Halve batches until each holds ``limit`` bytes or one row, in order: Spark bounds a batch by its rows, and what a helper
    makes of a text takes many times the text's room."""
    for batch in batches:
        left = [batch]
        while left:
            b = left.pop()
            if b.num_rows > 1 and b.nbytes > limit:
                half = b.num_rows // 2
                left += [b.slice(half), b.slice(0, half)]
            else:
                yield b


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches, joined and cut so that none parts rows of equal ``keys``, which are numbers; equal ones come one behind the other."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        key = [b.column(k).to_numpy() for k in keys]
        turns = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1
        first, at = tuple(k[0] for k in key), int(turns[-1]) if len(turns) else 0
        if held and (at or first != last):
            if at:
                held.append(b.slice(0, at))
            yield joined()
            held = []
        elif at:
            yield b.slice(0, at)
        held.append(b.slice(at))
        last = tuple(k[-1] for k in key)
    if held:
        yield joined()


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of rows of equal keys start."""
    return np.flatnonzero(np.concatenate(([True], np.any([np.diff(k) != 0 for k in keys], axis=0)))) if len(keys[0]) else np.zeros(0, np.int64)


def pairs_up_to(ends: np.ndarray, limit: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right): each row with every later one before ``ends`` of it, about ``limit`` pairs at once."""
    row = np.arange(len(ends))
    count = np.maximum(ends - row - 1, 0)
    done = np.cumsum(count)
    start = 0
    while start < len(row):
        before = done[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(done, before + limit, "right")))
        n = count[start:end]
        left = np.repeat(row[start:end], n)
        if len(left):
            yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        start = end


def counted(rows: DataFrame, words: Words, placed: Callable[[str | None], list[tuple[str, int]]] | None = None) -> DataFrame:
    """chunk_id, token_count, terms array<struct<word, tf>>, gaps of ``rows(chunk_id, text)``. No shuffle.

    ``gaps`` has, for each of the terms, its first position and the distances from one to the next.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            if placed is None:
                found = list(map(words, texts))
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                said = list(chain.from_iterable(found))
            else:
                pairs = list(map(placed, texts))
                sizes = np.fromiter(map(len, pairs), np.int64, len(pairs))
                said = [w for p in pairs for w, _ in p]
                place = np.fromiter((x for p in pairs for _, x in p), np.int64, len(said))
            codes = pa.array(said, pa.string()).dictionary_encode()
            word = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((place, word, owner))
            word, owner, place = word[order], owner[order], place[order]
            first = np.ones(len(word), bool)
            first[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(first)
            gap = np.diff(place, prepend=0)
            gap[at] = place[at]
            runs = np.append(at, len(word))
            per_text = pa.array(np.searchsorted(owner[at], np.arange(len(sizes) + 1)), pa.int32())
            term = pa.StructArray.from_arrays([codes.dictionary.take(pa.array(word[at])), pa.array(np.diff(runs), pa.int32())], fields=list(_TERM))
            gaps = pa.ListArray.from_arrays(pa.array(runs, pa.int32()), pa.array(gap, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(per_text, term), pa.ListArray.from_arrays(per_text, gaps)], names=["chunk_id", "token_count", "terms", "gaps"])

    schema = T.StructType([rows.schema["chunk_id"], *T._parse_datatype_string(COUNTED).fields])
    return rows.select("chunk_id", "text").mapInArrow(run, schema)


_SHINGLE_WORD = np.zeros(256, bool)
_SHINGLE_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789'")] = True
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
WINDOW = 1 << 20  # bytes


def mixed(h: np.ndarray) -> np.ndarray:
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


def word_hashes(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each run of the bytes ``is_word``: the polynomial of its bytes, from differences of one running sum, then mixed. About ``WINDOW`` bytes at once."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word[raw], [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + WINDOW, "right")))
        first, size = int(start[at]), int(end[to - 1] - start[at])
        up, down = _powers(WINDOW + 1 if size <= WINDOW else 1 << size.bit_length())
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((raw[first : first + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=total[1:])
        out[at:to] = mixed((total[end[at:to] - first] - total[start[at:to] - first]) * down[start[at:to] - first])
        at = to
    return out, start


def shingle_hashes(texts: Iterable[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct hashes of each text's runs of ``n`` words, one text behind the other."""
    said = [(t or "").lower().encode() for t in texts]
    word, start = word_hashes(b"\n".join(said), _SHINGLE_WORD)
    cut = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in said)]))
    runs = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        runs = (runs ^ runs >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(runs)]
    owner = np.repeat(np.arange(len(said)), np.diff(cut))
    inside = owner[: len(runs)] == owner[n - 1 :] if len(runs) else np.zeros(0, bool)
    owner, runs = owner[: len(runs)][inside], runs[inside].view(np.int64)
    own = np.searchsorted(owner, np.arange(len(said) + 1))
    for a, b in zip(own.tolist(), own[1:].tolist(), strict=False):
        runs[a:b].sort()
    first = np.ones(len(runs), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (runs[1:] != runs[:-1])
    return np.searchsorted(owner[first], np.arange(len(said) + 1)), runs[first]


def shingled(rows: DataFrame, n: int = 5, of: str = "text") -> DataFrame:
    """``rows`` with ``s``, the sorted distinct hashes of the shingles of the text ``of``, in its place. No shuffle."""
    kept = [c for c in rows.columns if c != of]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            offsets, hashes = shingle_hashes(b.column(of).to_pylist(), n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes))], names=[*kept, "s"])

    return rows.select(*kept, of).mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField("s", T.ArrayType(T.LongType()))]))
