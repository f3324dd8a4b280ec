"""Token-id output: Simple-8b words in sharded files.

Codec. Ids are cut into blocks of 256. Each 64-bit word holds a 4-bit selector
and 60 bits of payload; the selector fixes how many ids of which width the
payload packs. An id of 60 bits or more leaves the payload of selector 15 all
ones (the escape) and stands in full in a list behind the words. The word
offset of every block is stored, so blocks decode alone and all of a shard's
words decode in a handful of vector operations.

Files. A Parquet folder; one row is one shard (the documents of a few MB of
text, in ascending ``doc_id`` order): ``part``, ``before`` (ids of the same part
before the shard), ``doc_ids`` and ``blob``. Parts ascend in ``doc_id``, too.
Parquet carries the blobs so that any store Spark reads will do and that a task
that is run again replaces its own output.

Cases: a null or empty text is the end id alone; repeated rows are encoded once
each, in the order of ``doc_id`` and text (a null ``doc_id`` sorts first); an
empty table writes no shard and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import batch, pieces, ranges, shared_folder, utf8

MAGIC = b"S8B1"
BLOCK = 256
#: Fixed values of the coding: ids in a word and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 60) - 1
TOKENIZER = "word_bpe_49k.json"
END_ID = 1

SHARDS = "part int, before long, n_docs int, n_ids long, doc_ids array<bigint>, blob binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block and the end, escaped ids)."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    escaped = ids >= ESCAPE
    payload = np.zeros(blocks * BLOCK, np.uint64)
    payload[:n] = np.where(escaped, np.uint64(ESCAPE), ids)
    width = np.frexp(payload.astype(np.float64))[1].astype(np.uint8).reshape(blocks, BLOCK)
    # windowed maxima of widths, each from a shorter window; positions past a block count as width 0
    best = np.full((blocks, BLOCK), 15, np.uint8)
    window, size = width, 1
    for selector in range(14, -1, -1):
        want = int(COUNTS[selector])
        while size < want:
            step = min(size, want - size)
            moved = np.zeros_like(window)
            moved[:, : BLOCK - step] = window[:, step:]
            window, size = np.maximum(window, moved), size + step
        best[window <= BITS[selector]] = selector
    # all blocks advance together, one word a step
    mark = np.zeros(blocks * BLOCK, np.uint8)
    left = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    best, at, base = best.reshape(-1), np.zeros(blocks, np.int64), BLOCK * np.arange(blocks)
    while len(at):
        chosen = best[base + at]
        mark[base + at] = chosen + 1
        at = at + COUNTS[chosen]
        on = at < left
        if not on.all():
            at, base, left = at[on], base[on], left[on]
    where = np.flatnonzero(mark)
    selectors = mark[where] - 1
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in range(2, 16):
        rows = np.flatnonzero(selectors == selector)
        if len(rows):
            step = np.arange(COUNTS[selector])
            index = where[rows][:, None] + step
            inside = (where[rows] % BLOCK)[:, None] + step < BLOCK
            values = np.where(inside, payload[np.minimum(index, len(payload) - 1)], np.uint64(0))
            words[rows] |= np.bitwise_or.reduce(values << (step * BITS[selector]).astype(np.uint64), axis=1)
    offsets = np.searchsorted(where, BLOCK * np.arange(blocks + 1)).astype(np.uint32)
    return words, offsets, ids[escaped]


def unpack(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    before = np.cumsum(counts) - counts
    inside = before - before[offsets[:-1]][block]  # ids of the block in front of the word
    start = block * BLOCK + inside
    end = np.minimum((block + 1) * BLOCK, n)
    for selector in range(2, 16):
        rows = np.flatnonzero(selectors == selector)
        if len(rows):
            step = np.arange(COUNTS[selector])
            at = start[rows][:, None] + step
            values = (words[rows][:, None] >> (step * BITS[selector]).astype(np.uint64)) & np.uint64((1 << int(BITS[selector])) - 1)
            keep = at < end[rows][:, None]
            out[at[keep]] = values[keep]
    if len(escaped):
        out[out == ESCAPE] = escaped
    return out


def to_blob(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One shard: header, ids of each document, block offsets, words, escapes."""
    words, offsets, escaped = pack(ids)
    head = MAGIC + struct.pack("<IIQQQ", len(lengths), len(offsets), len(ids), len(words), len(escaped))
    return b"".join((head, lengths.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes(), escaped.astype("<u8").tobytes()))


def from_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each document) of a shard."""
    if blob[:4] != MAGIC:
        raise ValueError("not a shard of Simple-8b words")
    docs, blocks, n, words, escaped = struct.unpack_from("<IIQQQ", blob, 4)
    at = 4 + struct.calcsize("<IIQQQ")
    out = []
    for kind, count in (("<u4", docs), ("<u4", blocks), ("<u8", words), ("<u8", escaped)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    lengths, offsets, packed, raw = out
    return unpack(packed, offsets, raw, n), lengths


#: What may stand behind a run of letters as a pre-token of its own: ASCII that is no letter, digit or white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _letters(word: str) -> bool:
    """Whether a word is letters alone when lower-cased, as normalising would compose them.

    A lower-cased letter may bring a mark along (U+0130 does). Letters from U+0530 on are
    left to the tokenizer: newer ones may not be letters to its own tables.
    """
    low = word.lower()
    return low.isalpha() and max(low) < "\u0530" and is_normalized("NFC", word)


def _strings(words: pa.Array) -> list[str]:
    """Python strings; by way of NumPy, which is several times faster than one scalar at a time."""
    return words.to_numpy(zero_copy_only=False).tolist()


class WordTokens:
    """Ids of texts by a tokenizer whose pre-tokens never span white space: the
    ids of a text are those of its white-space-separated words, and each
    distinct word meets the tokenizer once while it is remembered.

    Arrow splits a piece of texts and numbers its distinct words; what follows per
    word of the text is array look-ups. A run of letters is one pre-token, ended by an id
    of the vocabulary's word ends, and ASCII marks behind it are the next. So distinct runs of
    letters are encoded many to a call and told apart by their word ends; any other
    word, and any call whose word ends don't add up, is encoded by itself.
    """

    def __init__(self, name: str, remember: int = 600_000, together: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.remember, self.together = Tokenizer.from_file(public_tokenizers.path(name)), remember, together
        # for runs of a-z, which normalising and the byte alphabet leave as they are: the same model without these steps
        self.plain = Tokenizer.from_file(public_tokenizers.path(name))
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.is_end[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.letters: dict[str, int] = {}  # places among the numbers, too
        self.flat, self.start, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def alone(self, words: list[str], tokenizer=None) -> list[list[int]]:
        return [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(words, add_special_tokens=False)]

    def learn_letters(self, runs: list[str], tokenizer) -> None:
        groups = [runs[i : i + self.together] for i in range(0, len(runs), self.together)]
        for i in range(0, len(groups), 64):
            some = groups[i : i + 64]
            flat, counts = [], []
            for group, ids in zip(some, self.alone([" ".join(g) for g in some], tokenizer), strict=True):
                ids = np.array(ids, np.uint32)
                ends = np.flatnonzero(self.is_end[ids]) + 1
                if len(ends) != len(group) or ends[-1] != len(ids):
                    apart = self.alone(group)
                    ids, ends = np.fromiter(chain.from_iterable(apart), np.uint32), np.cumsum([len(x) for x in apart])
                flat.append(ids)
                counts.append(np.diff(ends, prepend=0))
            self.letters.update(zip(chain.from_iterable(some), self.add(np.concatenate(flat), np.concatenate(counts)), strict=True))

    def add(self, flat: np.ndarray, counts: np.ndarray) -> range:
        """Numbers of new runs of ids, which lie one behind the other in ``flat``."""
        first = len(self.count)
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(counts) - counts))
        self.count = np.concatenate((self.count, counts))
        self.flat = np.concatenate((self.flat, flat))
        return range(first, first + len(counts))

    def add_alone(self, words: list[str]) -> range:
        ids = self.alone(words)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return self.add(np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts)

    def learn(self, new: pa.Array) -> np.ndarray:
        """Numbers of words that have none."""
        cores = pc.utf8_rtrim(new, MARKS)
        plain = pc.ascii_is_alpha(cores)
        runs = pc.if_else(plain, pc.ascii_lower(cores), cores).dictionary_encode()
        distinct = _strings(runs.dictionary)
        is_plain = pc.ascii_is_alpha(runs.dictionary).to_numpy(zero_copy_only=False).tolist()
        fresh = [(r, p) for r, p in zip(distinct, is_plain, strict=True) if r not in self.letters and (p or (r and _letters(r)))]
        self.learn_letters([r for r, p in fresh if p], self.plain)
        self.learn_letters([r for r, p in fresh if not p], self.tokenizer)
        out = np.fromiter(map(self.letters.get, distinct, repeat(-1)), np.int64, len(distinct))[runs.indices.to_numpy(zero_copy_only=False)]
        size = pc.binary_length(cores).to_numpy(zero_copy_only=False)
        marks = pc.binary_length(new).to_numpy(zero_copy_only=False) - size
        # letters with marks behind them
        ended = np.flatnonzero((out >= 0) & (marks > 0))
        if len(ended):
            tails = pa.array([w[-m:] for w, m in zip(_strings(new.take(pa.array(ended))), marks[ended].tolist(), strict=True)]).dictionary_encode()
            place = np.array(self.add_alone(_strings(tails.dictionary)))
            body, tail = out[ended], place[tails.indices.to_numpy(zero_copy_only=False)]
            counts = self.count[body] + self.count[tail]
            first = np.cumsum(counts) - counts
            flat = np.empty(int(counts.sum()), np.uint32)
            flat[ranges(first, self.count[body])] = self.flat[ranges(self.start[body], self.count[body])]
            flat[ranges(first + self.count[body], self.count[tail])] = self.flat[ranges(self.start[tail], self.count[tail])]
            out[ended] = np.array(self.add(flat, counts))
        others = np.flatnonzero(out < 0)
        if len(others):
            out[others] = np.array(self.add_alone(_strings(new.take(pa.array(others)))))
        return out

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of these distinct words."""
        if len(self.number) > self.remember:
            self.forget()
        listed = _strings(words)
        out = np.fromiter(map(self.number.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = self.learn(words.take(pa.array(new)))
            self.number.update(zip(map(listed.__getitem__, new.tolist()), out[new].tolist(), strict=True))
        return out

    def encode(self, texts: pa.Array | list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end_id``; ids of each text)."""
        split = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        words = split.flatten().dictionary_encode()
        number = self.numbers(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
        counts = self.count[number]
        ids = self.flat[ranges(self.start[number], counts)] if len(number) else np.zeros(0, np.uint32)
        sums = np.concatenate(([0], np.cumsum(counts)))
        lengths = np.diff(sums[np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))]) + 1
        ends = np.cumsum(lengths) - 1
        out = np.empty(int(lengths.sum()), np.uint32)
        own = np.ones(len(out), bool)
        own[ends] = False
        out[own], out[ends] = ids, end_id
        return out, lengths


@lru_cache(maxsize=2)
def _word_tokens(name: str) -> WordTokens:
    """One per Python worker: what it has learned serves later tasks, too."""
    return WordTokens(name)


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encode ``docs(doc_id, text)`` into shards at ``path``. One shuffle, by range of ``doc_id``."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _word_tokens(tokenizer)
        part, before = TaskContext.get().partitionId(), 0
        for piece in pieces(batches, "text"):
            ids, lengths = tokens.encode(piece.column("text").cast(pa.string()), end_id)
            yield batch({
                "part": ([part], pa.int32()), "before": ([before], pa.int64()), "n_docs": ([len(lengths)], pa.int32()), "n_ids": ([len(ids)], pa.int64()),
                "doc_ids": ([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())), "blob": ([to_blob(ids, lengths)], pa.binary()),
            })
            before += len(ids)

    sorted_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    sorted_docs.mapInArrow(encode, SHARDS).write.option("compression", "zstd").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, ids_bytes."""
    return _decoded(spark, path, "ids array<bigint>", lambda ids, ends: [ids[a:b].astype(np.int64) for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)], pa.list_(pa.int64()))


def read_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored ids."""

    def crc(ids: np.ndarray, ends: np.ndarray) -> list[int]:
        raw = memoryview(ids.astype("<u4").tobytes())
        return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    return _decoded(spark, path, "ids_crc32 long", crc, pa.int64())


def _decoded(spark, path: str, column: str, value, kind: pa.DataType) -> DataFrame:
    name = column.split()[0]

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            part, before, doc_ids, blob = (shard.column(c)[0].as_py() for c in ("part", "before", "doc_ids", "blob"))
            ids, lengths = from_blob(blob)
            ends = np.cumsum(lengths, dtype=np.int64)
            yield batch({
                "part": ([part] * len(doc_ids), pa.int32()), "doc_id": (doc_ids, pa.int64()), "local": (before + ends - lengths, pa.int64()),
                "n_tokens": (lengths.astype(np.int64), pa.int64()), name: (value(ids, ends), kind),
            })

    shards = spark.read.schema(SHARDS).parquet(path)
    # one row per part of the files, which are as many as the tasks that wrote them
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    first = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    docs = shards.select("part", "before", "doc_ids", "blob").mapInArrow(decode, f"part int, doc_id long, local long, n_tokens long, {column}")
    return docs.join(first, "part").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", name)


def token_digests(docs: DataFrame) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and report what the files hold."""
    path = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path)
    return read_digests(docs.sparkSession, path)
