"""Language identification of words by a linear-chain conditional random field.

Labels are the languages. A word's scores come from its affixes, character
n-grams and a lexicon (hashed features, and the words that the training sample
uses often); transitions between the languages of neighbouring words are learned
on sequences that switch language, made by joining spans of different training
documents. Forward-backward labels every word, so code-switched text gets word
labels (``label_words``); a document's language is the one with the most
marginal weight over its letters.

Fitting takes ``per_language`` labelled rows of each language at most (those of
smallest hash, so reruns agree) and of each at most ``span`` words, in runs of
neighbouring words at hashed places of the whole text; prediction reads whole texts. The
model is a few arrays, ``2**bits`` feature rows and at most ``lexicon`` words, with a
number for each language: labels are meant to be a few hundred languages at most.

Cases: a null text, or one without letters, is ``und`` with score 0; ties go to the
language that sorts first; without labelled rows every text is ``und``; repeated
rows are each scored; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batch, bounded_sample, id_remainder, pieces, runs_of, staged, texts_of, utf8
from lectern.llm.crf import adam, marginals

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def gram_ids(words: list[str], bits: int, longest: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the hashed runs of bytes of ``^word$`` and the words that they belong to, word after word."""
    data = np.frombuffer(f"^{'$^'.join(words)}$".encode(), np.uint8)
    first = np.flatnonzero(data == 94)
    sizes = np.diff(np.append(first, len(data)))
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(first + sizes, sizes) - np.arange(len(data))
    code = np.zeros(len(data), np.uint64)
    for n in range(1, longest + 1):
        code = code << np.uint64(8)
        code[: len(data) - n + 1] |= data[n - 1 :]
        at = np.flatnonzero(left >= n) if n > 1 else np.flatnonzero((left > 1) & (data != 94))
        ids = (code[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)
        yield ids.astype(np.int64), owner[at]


class Model:
    def __init__(self, languages: list[str], bits: int, lexicon: dict[str, int]):
        self.languages, self.bits, self.lexicon = languages, bits, lexicon
        k = len(languages)
        self.weights = np.zeros(((1 << bits) + len(lexicon), k), np.float32)
        self.transition, self.start = np.zeros((k, k)), np.zeros(k)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(feature, word) pairs: affixes and n-grams, hashed, and the word's place in the lexicon; sorted by word."""
        parts = [*gram_ids(words, self.bits)]
        listed = [(i, self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
        flat = np.concatenate([p[0] for p in parts] + [np.array([(1 << self.bits) + x for _, x in listed], np.int64)])
        owner = np.concatenate([p[1] for p in parts] + [np.array([i for i, _ in listed], np.int64)])
        order = np.argsort(owner, kind="stable")
        return flat[order], owner[order]

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for a in range(0, len(words), 20_000):
            flat, owner = self.features(words[a : a + 20_000])
            counts = np.bincount(owner)
            out[a : a + 20_000] = np.add.reduceat(self.weights[flat], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None]
        return out


def fit(rows: list[tuple[str, str]], bits: int = 16, lexicon: int = 20_000, span: int = 120, steps: int = 60) -> Model:
    """rows: (words joined by spaces, language). Maximum likelihood of the labels of switching sequences, with a Gaussian prior."""
    languages = sorted({lang for _, lang in rows})
    split = [(languages.index(lang), text.split(" ")) for text, lang in rows if text]
    split = [(k, w) for k, w in split if w]
    often = Counter(chain.from_iterable(set(w) for _, w in split))
    model = Model(languages, bits, {w: i for i, (w, n) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0]))[:lexicon]) if n > 1})
    if not split:
        return model
    # sequences of one to four spans, of random documents, cut at random places
    dice = np.random.default_rng(7)
    order = dice.permutation(len(split))
    sequences, at = [], 0
    while at < len(order):
        take = int(dice.integers(1, 5))
        one = []
        for d in order[at : at + take]:
            k, words = split[d]
            one += [(w, k) for w in (words if take == 1 else words[: max(3, int(dice.integers(3, span)))])]
        sequences.append(one)
        at += take
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w, _ in s))}
    number = np.array([vocabulary[w] for s in sequences for w, _ in s])
    label = np.array([k for s in sequences for _, k in s])
    lengths = np.array([len(s) for s in sequences])
    flat, owner = model.features([*vocabulary])
    counts = np.bincount(owner)
    first = np.cumsum(counts) - counts
    used, flat = np.unique(flat, return_inverse=True)
    scale = np.repeat(1 / np.sqrt(counts), counts)
    k, n = len(languages), len(label)
    gold = np.zeros((n, k))
    gold[np.arange(n), label] = 1
    starts = np.cumsum(lengths) - lengths
    gold_start = gold[starts].sum(axis=0)
    inner = np.ones(n, bool)
    inner[starts] = False
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1)

    def gradient(params):
        weights, transition, start = params
        emission = np.add.reduceat(weights[flat] * scale[:, None], first, axis=0)[number]
        gamma, _, pairs = marginals(emission, lengths, transition, start, pairs=True)
        rest = gold - gamma
        by_word = np.stack([np.bincount(number, rest[:, j], len(vocabulary)) for j in range(k)], axis=1)
        moved = by_word[owner] * scale[:, None]
        by_feature = np.stack([np.bincount(flat, moved[:, j], len(used)) for j in range(k)], axis=1)
        return [by_feature - 0.5 * weights, gold_pairs - pairs - 0.1 * transition, gold_start - gamma[starts].sum(axis=0) - 0.1 * start]

    weights, model.transition, model.start = adam([np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)], gradient, steps, 0.3)
    model.weights[used] = weights
    return model


def sample(labelled: DataFrame, per_language: int, span: int = 120, run: int = 30) -> list[tuple[str, str]]:
    """The bounded sample: ``per_language`` rows of each language, ``span`` words of each. Only ids and text hashes are ranked; whole texts stay in tasks."""
    ids = labelled.where("lang is not null and text is not null").select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    rows = texts_of(labelled, staged(bounded_sample(ids, "lang", per_language, ["doc_id", "text_hash"])), "lang")

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            out = []
            for text, seed in zip(piece.column("text").to_pylist(), piece.column("text_hash").to_pylist(), strict=True):
                words = words_of(text.decode("utf-8", "replace"))
                out.append(" ".join(chain.from_iterable(words[a:b] for a, b in runs_of(len(words), seed, span, run))))
            yield batch({"lang": (piece.column("lang"), None), "n": (piece.column("n"), None), "words": (out, pa.string())})

    found = rows.select("lang", "n", "text_hash", F.col("text").cast("binary").alias("text")).mapInArrow(pick, "lang string, n int, words string").collect()
    return [(r.words, r.lang) for r in sorted(found, key=lambda r: (r.lang, r.n))]


def learn(docs: DataFrame, train: Column, per_language: int = 250, span: int = 120, **options) -> Model:
    return fit(sample(docs.where(train), per_language, span), span=span, **options)


class Labeller:
    """Emission scores of words, kept for the words met last."""

    def __init__(self, model: Model, remember: int = 250_000):
        self.model, self.remember = model, remember
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def marginals(self, split: list[list[str]]) -> np.ndarray:
        words = list(chain.from_iterable(split))
        if len(self.number) > self.remember:
            self.number, self.scores = {}, self.scores[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.scores = np.concatenate((self.scores, self.model.emissions(new)))
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        lengths = np.fromiter((len(s) for s in split if s), np.int64)
        return marginals(self.scores[number].astype(np.float64), lengths, self.model.transition, self.model.start)[0]


_labellers: dict[int, Labeller] = {}


def _labeller(shared) -> Labeller:
    """One per worker and model, so that words are scored once in a worker."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) is not None else id(shared.value)
    if key not in _labellers:
        _labellers.clear()
        _labellers[key] = Labeller(shared.value)
    return _labellers[key]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(shared)
        languages = labeller.model.languages
        for piece in pieces(batches, "text", 5 << 20):
            split = [words_of(t.decode("utf-8", "replace")) for t in piece.column("text").to_pylist()]
            split = [[w for w in s if w.isalpha() or any(map(str.isalpha, w))] for s in split] if languages else [[] for _ in split]
            guess, score = [UNKNOWN] * len(split), [0.0] * len(split)
            busy = [i for i, s in enumerate(split) if s]
            if busy:
                gamma = labeller.marginals(split)
                weight = np.fromiter((len(w) for s in split for w in s), np.float64)
                lengths = np.fromiter((len(split[i]) for i in busy), np.int64)
                first = np.cumsum(lengths) - lengths
                share = np.add.reduceat(gamma * weight[:, None], first, axis=0) / np.add.reduceat(weight, first)[:, None]
                best = share.argmax(axis=1)
                for i, b, s in zip(busy, best.tolist(), share[np.arange(len(best)), best].tolist(), strict=True):
                    guess[i], score[i] = languages[b], min(1.0, max(0.0, s))
            yield batch({"doc_id": (piece.column("doc_id"), None), "lang_pred": (guess, pa.string()), "score": (score, pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, words array<struct<word, lang, score>>: every word's most likely language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        languages = shared.value.languages
        for piece in pieces(batches, "text", 1 << 20):
            split = [words_of(t.decode("utf-8", "replace")) if languages else [] for t in piece.column("text").to_pylist()]
            gamma = labeller.marginals(split) if any(split) else np.zeros((0, 1))
            best, at, out = gamma.argmax(axis=1), 0, []
            for s in split:
                out.append([{"word": w, "lang": languages[best[at + i]], "score": float(gamma[at + i, best[at + i]])} for i, w in enumerate(s)])
                at += len(s)
            yield batch({"doc_id": (piece.column("doc_id"), None), "words": (out, kind)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, "doc_id long, words array<struct<word:string,lang:string,score:double>>")


def predict_held_out(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) is not 2 modulo 4; predict all."""
    held_out = id_remainder("doc_id", 4) == 2
    return predict(docs, learn(docs, ~held_out)).select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
