"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features describe its characters,
words and repetition, together with those of its two neighbours and its place in
the document; forward-backward gives each line's probability of being good, and
a document's score is their mean, weighted by line length. Training lines take
their document's label; the weights that map a document's mean to a probability
are learned on the same sample, after the field.

Fitting takes ``per_label`` labelled rows of each label at most (those of
smallest hash), and of each text at most ``fit_lines`` lines: runs of ``run`` neighbouring
lines at hashed places of the whole text, whose features are computed in tasks from the
whole text, too. The weights that map a mean to a probability are learned on the means of the
sample's whole texts. Scoring reads whole texts. No shuffle of texts; the model is a
few hundred numbers. Lines are described in blocks, so that a text of millions of lines
needs no more memory than one of thousands.

Cases: a null or empty text is one empty line; lines end at newlines; rows with a
null label are not learned from, and a document with several label rows counts
once for each; of repeated rows one is learned from; without labelled rows the score is 0.5;
repeated rows are each scored; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import batch, bounded_sample, cut_by_bytes, drop_staged, id_remainder, pieces, runs_of, staged, texts_of, utf8
from lectern.llm.crf import adam, marginals

#: Byte classes that a line's counts are taken of.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "stop": b".,", "shout": b"!?", "pipe": b"|", "mark": b"#$%&*@^~=+_<>{}[]\\",
    "quote": b"\"'`", "other": b"-/:;()", "high": bytes(range(128, 256)),
}
TABLE = np.full(256, len(CLASSES), np.uint8)
for _i, _c in enumerate(CLASSES.values()):
    TABLE[np.frombuffer(_c, np.uint8)] = _i
OWN = len(CLASSES) + 1 + 8  # byte classes, the rest, and what line_features adds
WIDTH = 3 * OWN + 4


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row of OWN numbers for each line."""
    n = len(lines)
    sizes = np.fromiter(map(len, lines), np.int64, n)
    data = TABLE[np.frombuffer(b"".join(lines), np.uint8)]
    kinds = len(CLASSES) + 1
    counts = np.bincount(np.repeat(np.arange(n), sizes) * kinds + data, minlength=n * kinds).reshape(n, kinds)
    out = np.zeros((n, OWN), np.float32)
    out[:, :kinds] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    words = [line.split() for line in lines]
    n_words = np.fromiter(map(len, words), np.int64, n)
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, n)
    most = np.maximum(n_words, 1)
    out[:, kinds] = np.log1p(sizes) / 6
    out[:, kinds + 1] = np.log1p(n_words) / 5
    out[:, kinds + 2] = (sizes - counts[:, 3]) / most / 10
    out[:, kinds + 3] = 1 - distinct / most
    out[:, kinds + 4] = np.fromiter((line[:1].isupper() for line in lines), np.float64, n)
    out[:, kinds + 5] = np.fromiter((line.rstrip().endswith((b".", b"!", b"?")) for line in lines), np.float64, n)
    out[:, kinds + 6] = np.fromiter((sum(map(eq, w, w[1:])) / max(1, len(w)) for w in words), np.float64, n)
    out[:, kinds + 7] = sizes == 0
    return out


class Lines:
    """The lines of texts, each distinct one described once, a block of distinct ones at a time."""

    def __init__(self, texts: list[bytes]):
        split = [t.split(b"\n") for t in texts]
        self.lengths = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.cumsum(self.lengths) - self.lengths
        number: dict[bytes, int] = {}
        n = int(self.lengths.sum())
        self.ids = np.fromiter((number.setdefault(x, len(number)) for x in chain.from_iterable(split)), np.int64, n)
        self.distinct = list(number)
        self.sizes = np.fromiter(map(len, self.distinct), np.float64, len(number))[self.ids] + 1  # bytes and the newline
        # whether a text holds the line before
        owner = np.repeat(np.arange(len(split)), self.lengths)
        self.repeated = np.ones(n, np.float32)
        self.repeated[np.unique(owner * len(number) + self.ids, return_index=True)[1]] = 0
        # the line before and behind, -1 at a text's edges
        self.before, self.after = np.arange(n) - 1, np.arange(n) + 1
        self.before[self.first], self.after[self.first + self.lengths - 1] = -1, -1

    def own(self, block: int = 50_000) -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, len(self.distinct), block):
            yield a, line_features(self.distinct[a : a + block])

    def edges(self, at: np.ndarray) -> np.ndarray:
        return np.stack((self.before[at] < 0, self.after[at] < 0, self.repeated[at], np.ones(len(at))), axis=1).astype(np.float32)

    def features(self, at: np.ndarray) -> np.ndarray:
        """A row of WIDTH numbers for each of the lines ``at``: a line's own, its neighbours', its place."""
        own = np.concatenate([np.zeros((1, OWN), np.float32), *(x for _, x in self.own())])
        place = np.append(self.ids, -1)
        return np.concatenate((own[place[at] + 1], own[place[self.before[at]] + 1], own[place[self.after[at]] + 1], self.edges(at)), axis=1)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """features @ weights of all lines, by parts, so that no line's features are kept."""
        parts = np.zeros((len(self.distinct) + 1, 3, weights.shape[1]))  # the last row is for no line
        for a, x in self.own():
            parts[a : a + len(x)] = np.einsum("nf,pfk->npk", x, weights[: 3 * OWN].reshape(3, OWN, -1), optimize=True)
        place = np.append(self.ids, -1)
        out = parts[self.ids, 0] + parts[place[self.before], 1] + parts[place[self.after], 2]
        return out + self.edges(np.arange(len(self.ids))) @ weights[3 * OWN :]


class Model:
    """Labels: 0 bad, 1 good."""

    def __init__(self):
        self.weights, self.transition, self.start = np.zeros((WIDTH, 2)), np.zeros((2, 2)), np.zeros(2)
        self.scale, self.bias = 0.0, 0.0

    def means(self, texts: list[bytes]) -> np.ndarray:
        lines = Lines(texts)
        gamma, _, _ = marginals(lines.emissions(self.weights), lines.lengths, self.transition, self.start)
        return np.add.reduceat(gamma[:, 1] * lines.sizes, lines.first) / np.add.reduceat(lines.sizes, lines.first)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        mean = np.clip(self.means(texts), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.scale * np.log(mean / (1 - mean)) + self.bias)))


def fit_field(features: np.ndarray, lengths: np.ndarray, label: np.ndarray, share: np.ndarray, steps: int = 200) -> Model:
    """The field of runs of lines: ``label`` and the weight ``share`` of each run."""
    model = Model()
    n = len(features)
    y = np.repeat(label, lengths)
    gold = np.zeros((n, 2))
    gold[np.arange(n), y] = 1
    first = np.cumsum(lengths) - lengths
    own = np.repeat(share, lengths)[:, None]
    gold_pairs = np.zeros((2, 2))
    inner = np.ones(n, bool)
    inner[first] = False
    np.add.at(gold_pairs, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    documents = share @ lengths

    def gradient(params):
        weights, transition, start = params
        gamma, _, pairs = marginals((features @ weights.astype(np.float32)).astype(np.float64), lengths, transition, start, pairs=True)
        rest = (gold - gamma) * own
        return [features.T @ rest.astype(np.float32) - 0.02 * weights, (gold_pairs - pairs) / documents - 0.5 * transition, rest[first].sum(axis=0) - 0.1 * start]

    model.weights, model.transition, model.start = adam([model.weights, model.transition, model.start], gradient, steps, 0.05)
    return model


def calibrate(model: Model, mean: np.ndarray, y: np.ndarray) -> Model:
    """Sets the weights from a mean to a probability."""
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    logit = np.log(mean / (1 - mean))

    def gradient(params):
        scale, bias = params
        rest = y - 1 / (1 + np.exp(-(scale * logit + bias)))
        return [np.array([(rest * logit).sum() - 0.01 * scale[0]]), np.array([rest.sum()])]

    (scale,), (bias,) = adam([np.array([1.0]), np.array([0.0])], gradient, 300, 0.05)
    model.scale, model.bias = float(scale), float(bias)
    return model


def learn(docs: DataFrame, labels: DataFrame, train: Column, per_label: int = 1500, fit_lines: int = 60, run: int = 12) -> Model:
    """Fit on the bounded sample. Only ids, labels and text hashes are ranked; texts are fetched for the chosen rows alone and stay in tasks."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(train).distinct()
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    sample = staged(texts_of(docs, staged(bounded_sample(known.join(hashed, "doc_id"), "quality", per_label, ["doc_id", "text_hash"])), "quality"))
    rows = sample.select("quality", "n", "text_hash", utf8().alias("text"))

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            lines = Lines(piece.column("text").to_pylist())
            out: list[tuple[int, int, bytes]] = []
            for d, (first, n, seed) in enumerate(zip(lines.first.tolist(), lines.lengths.tolist(), piece.column("text_hash").to_pylist(), strict=True)):
                out += [(d, b - a, np.arange(first + a, first + b)) for a, b in runs_of(n, seed, fit_lines, run)]
            features = lines.features(np.concatenate([at for *_, at in out]))
            ends = np.cumsum([n for _, n, _ in out])
            of = pa.array([d for d, *_ in out])
            yield batch({
                "quality": (piece.column("quality").take(of), None), "n": (piece.column("n").take(of), None), "at": ([int(at[0]) for *_, at in out], pa.int64()),
                "features": ([features[e - n : e].tobytes() for (_, n, _), e in zip(out, ends.tolist(), strict=True)], pa.binary()),
            })

    runs = sorted((r.quality, r.n, r.at, bytes(r.features)) for r in rows.mapInArrow(describe, "quality int, n int, at long, features binary").toLocalIterator())
    if not runs:
        return Model()
    label, owner, lengths = np.array([r[0] for r in runs]), [r[:2] for r in runs], np.array([len(r[3]) // (4 * WIDTH) for r in runs])
    features = np.frombuffer(b"".join(r[3] for r in runs), np.float32).reshape(-1, WIDTH)
    del runs
    # each document and each label weigh the same
    lines_of, of_label = Counter(), Counter(k for k, _ in set(owner))
    for o, n in zip(owner, lengths.tolist(), strict=True):
        lines_of[o] += n
    share = np.array([sum(of_label.values()) / 2 / of_label[o[0]] / lines_of[o] for o in owner])
    model = fit_field(features, lengths, label, share)
    del features
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            yield batch({"quality": (piece.column("quality"), None), "n": (piece.column("n"), None), "mean": (shared.value.means(piece.column("text").to_pylist()), pa.float64())})

    means = sorted(tuple(r) for r in rows.mapInArrow(measure, "quality int, n int, mean double").collect())
    drop_staged(sample)
    return calibrate(model, np.array([m for *_, m in means]), np.array([k for k, *_ in means]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            yield batch({"doc_id": (piece.column("doc_id"), None), "score": (shared.value.scores(piece.column("text").to_pylist()), pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, "doc_id long, score double")


def score_held_out(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """Learn from the labels whose crc32(doc_id) is not 0 modulo 5; score all."""
    model = learn(docs, labels, id_remainder("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score under ``cut``; all columns stay, and no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts):
        return type(texts)(np.concatenate([np.zeros(0), *map(shared.value.scores, cut_by_bytes([bytes(t) for t in texts], 2 << 20))]))

    return docs.where(scored(utf8()) >= cut)
