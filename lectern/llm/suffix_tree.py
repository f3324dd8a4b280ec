"""Language-model scores by a probabilistic suffix tree over words.

Symbols. A word of at least ``least`` tokens is a symbol; the others are symbols by
their last two bytes (classes of fewer tokens are pooled), and within a class a known
word has its discounted share of the class, a word never met in training what the
discounts leave. A text ends in the end symbol, which also stands before each text.

Contexts are runs of up to ``depth`` symbols. As in the published learner for such
trees, a run of at least ``least`` occurrences is a candidate, and is retained, with
its suffixes, if the distribution of its next symbol diverges from its suffix's by
``least_divergence`` nats. Next symbols met at least ``least / detail`` times behind a
context are listed; what the others leave, and ``weight`` occurrences more, goes
by the suffix's distribution. A position is scored in the state of the longest
retained suffix of what stands before it.

``least`` is ``reach`` times the root of the training tokens: symbols and contexts
grow with the corpus, as its root at most, and so does what is collected and broadcast. No run is
lost: chunks of positions name, with their counts, the runs that have ``NAMED`` of the cut's share in
them, first contexts, then symbols behind any named context. What chunks leave unnamed of a run that reaches the cut
is less than ``NAMED`` of the cut, so the run's named counts sum to the rest of the cut at least. Spark sums them, only runs that reach
this rest leave the executors (``depth * detail / (1 - NAMED) / reach`` times the root at most, however small a chunk's
share of the corpus is), and a third pass counts these over all texts.
Texts are split once; the passes over runs read symbols.

A text's words under ``hot_share`` travel as (row, word, count) to a join with the
word counts.

Cases: a null or empty text is the end symbol alone; a null id belongs to the
training rows; without training rows all words are unknown and the base score of
a token is log10(0.5 / 0.5) = 0; repeated rows are each scored and each learned
from; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, batch, id_remainder, pieces, staged, utf8

END = b""  # no word is empty
POOLED, ENDED = 0, 1  # symbols of the small classes and of the end
NAMED = 0.75


def count_words(train: DataFrame, hold: int = 300_000) -> DataFrame:
    """word, c: how often each word, and the end, is in the training texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for piece in pieces(batches, "text"):
            for text in piece.column("text").to_pylist():
                found.update(text.translate(LOWER).split())
            found[END] += piece.num_rows
            if len(found) > hold:
                yield batch({"word": (list(found), pa.binary()), "c": (list(found.values()), pa.int64())})
                found.clear()
        if found:
            yield batch({"word": (list(found), pa.binary()), "c": (list(found.values()), pa.int64())})

    return train.select(utf8().alias("text")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Alphabet:
    """What each word is as a symbol."""

    def __init__(self, total: int, types: int, ones: int, twos: int, hot: list[tuple[bytes, int]], classes: list[tuple[bytes, int, int]], least: float):
        """hot: (word, count), all of at least ``least`` among them; classes: (last two bytes, tokens and types of the words under ``least``)."""
        self.total, self.below = total, total + 0.5 * (types + 1)
        self.discount = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        n = len(hot)
        self.number = {w: i for i, (w, _) in enumerate(hot)}
        self.symbol_of = {}
        self.mass, self.kinds = [0.0, 0.0], [0, 0]
        for tail, tokens, kinds in classes:
            if tokens and tokens >= least:
                self.symbol_of[tail] = len(self.mass)
                self.mass.append(tokens)
                self.kinds.append(kinds)
            else:
                self.mass[POOLED] += tokens
                self.kinds[POOLED] += kinds
        self.symbol = np.zeros(n, np.int32)
        self.within, self.base = np.zeros(n), np.zeros(n)
        for i, (w, c) in enumerate(hot):
            self.base[i] = math.log10((c + 0.5) / self.below)
            if w == END:
                self.symbol[i], self.mass[ENDED] = ENDED, c
            elif c >= least:
                self.symbol[i] = len(self.mass)
                self.mass.append(c)
                self.kinds.append(0)
            else:
                self.symbol[i] = self.symbol_of.get(w[-2:], POOLED)
                self.within[i] = math.log10((c - self.discount) / (self.mass[self.symbol[i]] + 1))
        self.symbols = len(self.mass)
        # the chance of a word that training never met, in each class
        self.unknown = [math.log10((self.discount * k + 1) / (m + 1)) for m, k in zip(self.mass, self.kinds, strict=True)]

    def read(self, texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
        """(words with the end of each text, their numbers or -1, their symbols, tokens of each text)."""
        split = [[*t.translate(LOWER).split(), END] for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        get = self.number.get
        words = list(chain.from_iterable(split))
        number = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        rare = np.flatnonzero(number < 0)
        symbol = self.symbol[number] if len(self.symbol) else np.zeros(len(number), np.int32)
        if len(rare):
            # without training rows the end is no hot word
            kinds = (ENDED if words[i] == END else self.symbol_of.get(words[i][-2:], POOLED) for i in rare.tolist())
            symbol[rare] = np.fromiter(kinds, np.int32, len(rare))
        return split, number, symbol, sizes


def _mix(key: np.ndarray | int, symbol: np.ndarray) -> np.ndarray:
    """The key of a run with one more symbol at its far end."""
    mixed = (np.uint64(key) if isinstance(key, int) else key) ^ (symbol.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each wanted key is among the sorted keys, its place there)."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _longer(at: np.ndarray, key: np.ndarray, ids: np.ndarray, place: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``m`` symbols, out of those of one less that end at ``at``: only where the text, and the end before it, reach so far.

    Texts lie one behind the other, so the symbol before a text is an end; before the first one stands ``ids[-1]``.
    """
    reach = place[at] >= m - 2
    at = at[reach]
    return at, _mix(key[reach], ids[at - (m - 1)])


def _key_of(ids: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    key = _mix(0, ids[at])
    for back in range(1, m):
        key = _mix(key, ids[at - back])
    return key


def _chunks(batches: Iterable[pa.RecordBatch], chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, their places in their texts) of whole texts, of ``chunk`` symbols and more; a task's rest joins its last chunk, since few positions name runs by chance."""
    ready, held, count = [], [], 0
    for piece in pieces(batches, "ids"):
        held.append((b"".join(piece.column("ids").to_pylist()), piece.column("n_tokens").to_numpy()))
        count += int(held[-1][1].sum())
        if count >= chunk:
            if ready:
                yield _joined(ready)
            ready, held, count = held, [], 0
    if ready or held:
        yield _joined(ready + held)


def _joined(parts: list[tuple[bytes, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _symbols(b"".join(ids for ids, _ in parts), np.concatenate([sizes for _, sizes in parts]))


def _symbols(ids: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int32), (np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)


def _contexts(train: DataFrame, least: float, total: int, depth: int, chunk: int) -> DataFrame:
    """key of every run of 2 to ``depth`` symbols that may occur ``least`` times in ``total`` positions and does not end a text."""

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, place in _chunks(batches, chunk):
            cut = NAMED * least / total * len(ids)
            at, key = np.arange(len(ids)), _mix(0, ids)
            keep = (np.bincount(ids) >= cut)[ids] & (ids != ENDED)
            for m in range(2, depth + 1):
                at, key = _longer(at[keep], key[keep], ids, place, m)
                found, counts = np.unique(key, return_counts=True)
                found, counts = found[counts >= cut], counts[counts >= cut]
                if not len(found):
                    break
                keep, _ = _find(found, key)
                yield batch({"key": (found.view(np.int64), pa.int64()), "n": (counts, pa.int64())})

    return train.mapInArrow(name, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= (1 - NAMED) * least).select("key")


def _candidates(train: DataFrame, shared, least: float, total: int, depth: int, chunk: int) -> DataFrame:
    """Every symbol behind one of the shared contexts that may occur ``least`` times in ``total`` positions, as the run of both: key, m, last symbol, keys without the farthest and without the last symbol."""

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = shared.value
        for ids, place in _chunks(batches, chunk):
            cut = NAMED * least / total * len(ids)
            at, key = np.arange(len(ids)), _mix(0, ids)
            keep, before = (np.bincount(ids) >= cut)[ids], _mix(0, ids[at - 1])
            for m in range(2, depth + 2):
                at, key, before = at[keep], key[keep], before[keep]
                if m > 2:
                    before = _mix(before[place[at] >= m - 2], ids[at[place[at] >= m - 2] - (m - 1)])
                at, key = _longer(at, key, ids, place, m)
                behind, _ = _find(contexts, before)
                at, key, before = at[behind], key[behind], before[behind]
                found, counts = np.unique(key, return_counts=True)
                found, counts = found[counts >= cut], counts[counts >= cut]
                if not len(found):
                    break
                keep, which = _find(found, key)
                example = np.zeros(len(found), np.int64)
                example[which[keep]] = at[keep]
                yield batch({
                    "key": (found.view(np.int64), pa.int64()), "n": (counts, pa.int64()), "m": (np.full(len(found), m), pa.int32()), "last": (ids[example], pa.int32()),
                    "suffix": (_key_of(ids, example, m - 1).view(np.int64), pa.int64()), "context": (_key_of(ids, example - 1, m - 1).view(np.int64), pa.int64()),
                })

    kept = ("m", "last", "suffix", "context")
    named = train.mapInArrow(name, "key long, n long, m int, last int, suffix long, context long")
    return named.groupBy("key").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in kept]).where(F.col("n") >= (1 - NAMED) * least).select("key", *kept)


def _count_runs(train: DataFrame, shared, depth: int, chunk: int) -> DataFrame:
    """key, n: how often each of the shared sorted keys is in the training texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        n = np.zeros(len(keys), np.int64)
        for ids, place in _chunks(batches, chunk):
            at, key = np.arange(len(ids)), _mix(0, ids)
            for m in range(2, depth + 2):
                at, key = _longer(at, key, ids, place, m)
                met, which = _find(keys, key)
                n += np.bincount(which[met], minlength=len(keys))
                at, key = at[met], key[met]
        met = np.flatnonzero(n)
        yield batch({"key": (keys[met].view(np.int64), pa.int64()), "n": (n[met], pa.int64())})

    return train.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Tree:
    """``context`` and ``back``: keys of the retained contexts and log10 of what their suffixes get; ``gram`` and ``logp``: listed runs behind them; ``root``: no context."""

    def __init__(self, mass: list[float], runs: dict[str, np.ndarray], least: float, depth: int, least_divergence: float, weight: float):
        """runs: arrays key (sorted), m, last, suffix, context, n of the listed runs of two symbols and more."""
        self.depth = depth
        root = np.array(mass) + 0.5
        root /= root.sum()
        self.root = np.log10(root)
        # of all contexts: keys, occurrences, keys of their suffixes, in the order of the keys
        single = np.flatnonzero(np.array(mass) >= least)
        longer = (runs["n"] >= least) & (runs["m"] <= depth) & (runs["last"] != ENDED)
        keys = np.concatenate((_mix(0, single), runs["key"][longer]))
        order = np.argsort(keys)
        keys = keys[order]
        count = np.concatenate((np.array(mass)[single], runs["n"][longer]))[order]
        suffix = np.concatenate((np.zeros(len(single), np.uint64), runs["suffix"][longer]))[order]
        long = np.concatenate((np.ones(len(single), np.int64), runs["m"][longer]))[order]

        known, owner = _find(keys, runs["context"])
        listed = np.flatnonzero(known)
        left = count - np.bincount(owner[listed], runs["n"][listed], len(keys)) + weight
        p, shorter = np.zeros(len(runs["key"])), np.zeros(len(runs["key"]))
        for m in range(2, depth + 2):
            now = listed[runs["m"][listed] == m]
            shorter[now] = root[runs["last"][now]] if m == 2 else p[_find(runs["key"], runs["suffix"][now])[1]]
            p[now] = (runs["n"][now] + left[owner[now]] * shorter[now]) / (count[owner[now]] + weight)
        own, part = owner[listed], runs["n"][listed] / count[owner[listed]]
        divergence = np.bincount(own, part * np.log(part / shorter[listed]), len(keys)).astype(float)
        rest, below = 1 - np.bincount(own, part, len(keys)), 1 - np.bincount(own, shorter[listed], len(keys))
        some = (rest > 1e-12) & (below > 1e-12)
        divergence[some] += rest[some] * np.log(rest[some] / below[some])
        retained = divergence >= least_divergence
        for k in range(depth, 1, -1):
            retained[_find(keys, suffix[(long == k) & retained])[1]] = True
        self.context, self.back = keys[retained], np.log10(left / (count + weight))[retained]
        used = listed[retained[own]]
        self.gram, self.logp = runs["key"][used], np.log10(p[used])

    def log_probs(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 of the chance of each symbol behind its state."""
        state = np.full((self.depth + 1, len(ids)), -1, np.int32)
        at = np.arange(len(ids))
        key = _mix(0, ids[at - 1])
        for k in range(1, self.depth + 1):
            met, which = _find(self.context, key)
            at, key = at[met], key[met]
            state[k, at] = which[met]
            inside = place[at] >= k
            at = at[inside]
            key = _mix(key[inside], ids[at - k - 1])
        level = (state >= 0).sum(axis=0)
        runs = [_mix(0, ids)]
        for back in range(1, self.depth + 1):
            runs.append(_mix(runs[-1], np.roll(ids, back)))
        out, at = np.zeros(len(ids)), np.zeros(0, np.int64)
        for k in range(self.depth, 0, -1):
            at = np.concatenate((at, np.flatnonzero(level == k)))
            met, which = _find(self.gram, runs[k][at])
            out[at[met]] += self.logp[which[met]]
            at = at[~met]
            out[at] += self.back[state[k, at]]
        at = np.concatenate((at, np.flatnonzero(level == 0)))
        out[at] += self.root[ids[at]]
        return out


def alphabet_of(counts: DataFrame, reach: float = 1.0, hot_share: float = 2e-6) -> tuple[Alphabet, float, float]:
    """(alphabet, least count of symbols and contexts, least count of hot words)."""
    total, types, n1, n2 = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    total = int(total)
    least = max(8.0, reach * math.sqrt(total))
    hot_cut = min(hot_share * total, least)
    hot = counts.where((F.col("c") >= hot_cut) | (F.length("word") == 0))
    tails = counts.where((F.length("word") > 0) & (F.col("c") < least)).groupBy(F.substring("word", -2, 2).alias("tail")).agg(F.sum("c"), F.count("*"))
    return Alphabet(total, types, n1, n2, sorted((bytes(r.word), r.c) for r in hot.toLocalIterator()), sorted((bytes(t), int(a), int(b)) for t, a, b in tails.collect()), least), least, hot_cut


def learn(train: DataFrame, alphabet: Alphabet, least: float, depth: int = 4, detail: float = 16.0, least_divergence: float = 0.01, weight: float = 10.0, chunk: int = 2_500_000) -> Tree:
    """The tree of encoded training rows (ids, n_tokens)."""
    listed = max(2.0, least / detail)
    train = train.select("ids", "n_tokens")
    if not alphabet.total:
        named = {c: np.zeros(0, np.int64) for c in ("key", "m", "last", "suffix", "context", "n")}
    else:
        send = train.sparkSession.sparkContext.broadcast
        single = _mix(0, np.flatnonzero(np.array(alphabet.mass) >= least))
        contexts = send(np.sort(np.concatenate((single, _arrays(_contexts(train, least, alphabet.total, depth, chunk))["key"].view(np.uint64)))))
        named = _arrays(_candidates(train, contexts, listed, alphabet.total, depth, chunk))
        shared = send(np.sort(named["key"].view(np.uint64)))
        counted = _arrays(_count_runs(train, shared, depth, chunk).where(F.col("n") >= listed))
        named = {c: v[np.argsort(named["key"].view(np.uint64))] for c, v in named.items()}
        met, which = _find(np.sort(counted["key"].view(np.uint64)), named["key"].view(np.uint64))
        named = {c: v[met] for c, v in named.items()}
        named["n"] = counted["n"][np.argsort(counted["key"].view(np.uint64))][which[met]]
        contexts.unpersist()
        shared.unpersist()
    runs = {c: v.view(np.uint64) if c in ("key", "suffix", "context") else v.astype(np.int64) for c, v in named.items()}
    return Tree(alphabet.mass, runs, least, depth, least_divergence, weight)


def _arrays(rows: DataFrame) -> dict[str, np.ndarray]:
    """Rows of a bounded number as arrays."""
    found = rows.toArrow()
    return {c: found.column(c).to_numpy() for c in found.column_names}


def encode(docs: DataFrame, train: Column, shared) -> DataFrame:
    """Each row's symbols as int32 bytes, what its words under classes and its hot words sum to, and its other words with their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for piece in pieces(batches, "text", 2 << 20):
            split, number, symbol, sizes = a.read(piece.column("text").to_pylist())
            first = np.cumsum(sizes) - sizes
            hot = number >= 0
            base, within = np.zeros(len(number)), np.zeros(len(number))
            base[hot], within[hot] = a.base[number[hot]], a.within[number[hot]]
            cold = Counter()
            owner = np.repeat(np.arange(len(split)), sizes)[~hot]
            words = list(compress(chain.from_iterable(split), (~hot).tolist()))
            cold.update((d, w) for d, w in zip(owner.tolist(), words, strict=True) if w != END)
            by_text: list[tuple[list[bytes], list[int]]] = [([], []) for _ in split]
            for (d, w), m in cold.items():
                by_text[d][0].append(w)
                by_text[d][1].append(m)
            ids = symbol.tobytes()
            yield batch({
                "doc_id": (piece.column("doc_id"), None), "text_hash": (piece.column("text_hash"), None), "train": (piece.column("train"), None), "n_tokens": (sizes, pa.int64()),
                "ids": ([ids[4 * b : 4 * e] for b, e in zip(first.tolist(), (first + sizes).tolist(), strict=True)], pa.binary()),
                "known": (np.add.reduceat(hot.astype(np.int64), first), pa.int64()), "base": (np.add.reduceat(base, first), pa.float64()), "within": (np.add.reduceat(within, first), pa.float64()),
                "words": ([x for x, _ in by_text], pa.list_(pa.binary())), "counts": ([x for _, x in by_text], pa.list_(pa.int32())),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(train, F.lit(False)).alias("train"), utf8().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, train boolean, n_tokens long, ids binary, known long, base double, within double, words array<binary>, counts array<int>")


def score(docs: DataFrame, train: Column, hot_share: float = 2e-6, reach: float = 1.0, **options) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    counts = staged(count_words(docs.where(train)))
    alphabet, least, hot_cut = alphabet_of(counts, reach, hot_share)
    found = staged(encode(docs, train, spark.sparkContext.broadcast(alphabet)))
    shared = spark.sparkContext.broadcast(learn(found.where("train"), alphabet, least, **options))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "ids"):
            sizes = piece.column("n_tokens").to_numpy()
            logs = shared.value.log_probs(*_symbols(b"".join(piece.column("ids").to_pylist()), sizes))
            whole = piece.column("within").to_numpy() + np.add.reduceat(logs, np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", "text_hash", "n_tokens", "known", "base")), pa.array(whole)], names=["doc_id", "text_hash", "n_tokens", "known", "base", "score"])

    key = ["doc_id", "text_hash"]
    scored = found.select(*key, "n_tokens", "known", "base", "within", "ids").mapInArrow(run, "doc_id long, text_hash long, n_tokens long, known long, base double, score double")
    cold = found.select(*key, F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("m"))))
    # a word's class goes by its last two bytes
    classes = spark.createDataFrame([(bytearray(t), float(alphabet.mass[s]), float(alphabet.unknown[s])) for t, s in alphabet.symbol_of.items()], "tail binary, mass double, unknown double")
    looked_up = cold.join(counts.where(F.col("c") < hot_cut), "word", "left").join(F.broadcast(classes), F.substring("word", -2, 2) == F.col("tail"), "left")
    c = F.coalesce("c", F.lit(0))
    mass, unknown = F.coalesce("mass", F.lit(float(alphabet.mass[0]))), F.coalesce("unknown", F.lit(float(alphabet.unknown[0])))
    log_within = F.when(c > 0, F.log10((c - F.lit(alphabet.discount)) / (mass + 1))).otherwise(unknown)
    # of a row's words in one task only their sums move on
    sums = looked_up.groupBy(*key).agg(F.sum(F.when(c > 0, F.col("m")).otherwise(0)).cast("long").alias("known"), F.sum(F.col("m") * F.log10((c + 0.5) / F.lit(alphabet.below))).alias("base"), F.sum(F.col("m") * log_within).alias("score"))
    parts = scored.select(*key, "n_tokens", "known", "base", "score", F.lit(1).alias("rows")).unionByName(sums.select(*key, F.lit(None).cast("long").alias("n_tokens"), "known", "base", "score", F.lit(0).alias("rows")))
    # equal rows of an id were summed together: each gets its share
    whole = parts.groupBy(*key).agg(F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"), F.sum("rows").alias("rows"))
    share = lambda c: (F.col(c) / F.col("rows")).alias(c)
    return whole.select(
        "doc_id", "n_tokens", F.expr("known div rows").alias("n_known"), F.lit(alphabet.total).cast("long").alias("train_tokens"), share("base").alias("base_score"), share("score"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row"),
    ).drop("row")


def score_held_out(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) is not 1 modulo 5; score all."""
    found = score(docs, id_remainder("doc_id", 5) != 1)
    return found.select("doc_id", (id_remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
