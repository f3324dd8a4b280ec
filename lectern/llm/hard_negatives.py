"""Hard negatives by BOND, the vertical scan of columns.

A task lays its rows out in blocks of columns, sorted by label. For each anchor the
columns are read in the order of the anchor's magnitudes, the largest first, some at a
time: the candidates' partial scores grow, and what the columns that are left can still
add at most and at least, by their minima and maxima in the block, bounds every
score from both sides. Candidates whose bounds leave the anchor's windows go out of the bitmap;
those that stay to the last column have exact scores.

First scan, positives: the window is what reaches an anchor's ``positives``-th best row of its own label.
Second scan, negatives: one window for each positive, ``low`` to ``high`` hundredths of its score, cut from
below by the ``negatives``-th best row that the task holds inside it.

Anchors are a stated set, scanned in blocks of at most ``block_bytes``: a block is shared with the
tasks, and each task returns its few best rows for each anchor and window, so all rows are
read twice a block and no pair outside the windows leaves a task.

Scores are exact: components are whole numbers, held to 2^24 either way, and sums are kept in floats only while
they are below 2^24 (single) or 2^53 (double), else in integers of 64 bits.

Cases: rows with a null label, a null vector or a component that is null or not finite take no part; a
vector shorter than others counts zeros in what it lacks; an empty vector scores zero; ties go to the smaller id, a null id last;
a row with the anchor's own id is no partner of it, and a null id is no anchor; repeated rows each take part,
as anchors, too; a positive score of zero has the window zero, a negative one has none; an anchor without positives
or negatives has no rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import batch, staged

MOST = 1 << 24
NO_ID = np.iinfo(np.int64).max  # a null id, which sorts last
ROWS = 1 << 14
VECTOR = "vec_id long, label int, q array<int>"
#: How many columns are read between two looks at the bounds, first to last; then the last again and again.
STEPS = (16, 8, 8, 8, 4)


def quantised(vectors: DataFrame, scale: int = 256, label: Column | None = None) -> DataFrame:
    """vec_id, label, q: the rows that take part, with floor(scale * component)."""
    label = F.col("label") if label is None else label

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("embedding")
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good = np.bincount(owner, weights=~np.isfinite(flat), minlength=len(sizes)) == 0
            q = np.clip(np.floor(scale * flat[good[owner]]), -MOST, MOST).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes[good]))), pa.int32()), pa.array(q))
            keep = pa.array(good)
            yield batch({"vec_id": (b.column("vec_id").filter(keep), None), "label": (b.column("label").filter(keep), None), "q": (lists, None)})

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("label is not null and embedding is not null").mapInArrow(run, VECTOR)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` numbers, shorter vectors filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Anchors:
    """A block of anchors: ids, labels, vectors (rows of equal width), and the order of each one's dimensions."""

    def __init__(self, rows: pa.Table):
        lists = rows.column("q").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.ids, self.labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        self.width = int(sizes.max()) if len(sizes) else 0
        self.q = _matrix(lists, self.width).astype(np.int32)


class Block:
    """Columns of a task's rows, sorted by label, with where each label stands."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, most_anchor: int):
        order = np.lexsort((ids, labels))
        self.ids, labels = ids[order], labels[order]
        self.labels, self.first = np.unique(labels, return_index=True)
        self.last = np.append(self.first[1:], len(labels))
        bound = int(np.abs(q).max(initial=0)) * most_anchor * max(1, q.shape[1])
        self.kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        self.columns = np.ascontiguousarray(q[order].T.astype(self.kind))
        per = lambda f: np.stack([f(self.columns[:, a:b], axis=1) for a, b in zip(self.first, self.last, strict=True)])
        self.least, self.most = per(np.min), per(np.max)  # a row for each label

    def stretches(self, label: int, same: bool) -> list[tuple[int, int, list[int]]]:
        """(first, behind the last, labels' places) of the rows of ``label``, or of those beside it."""
        k = int(np.searchsorted(self.labels, label))
        held = k < len(self.labels) and self.labels[k] == label
        if same:
            return [(self.first[k], self.last[k], [k])] if held else []
        n = len(self.labels)
        sides = [list(range(k)), list(range(k + 1, n))] if held else [list(range(n))]
        return [(self.first[s[0]], self.last[s[-1]], s) for s in sides if s]


def scan(columns: np.ndarray, least: np.ndarray, most: np.ndarray, anchor: np.ndarray, floor: int, ceiling: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of all rows of ``columns`` (a row each dimension) whose inner product with ``anchor`` is in [floor, ceiling]."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    order = order[: np.count_nonzero(anchor)]  # the rest adds nothing
    a = anchor[order].astype(columns.dtype)
    high = np.where(a > 0, a * most[order], a * least[order])
    low = np.where(a > 0, a * least[order], a * most[order])
    # what the dimensions from each on can still add
    # (whole numbers, not floats: a limit may pass what the columns' kind holds exactly)
    high, low = (np.append(np.cumsum(x[::-1])[::-1], 0).astype(np.int64).tolist() for x in (high, low))
    alive = None  # the bitmap, as places once it has shrunk
    partial = np.zeros(columns.shape[1], columns.dtype)
    at, step = 0, 0
    while at < len(order):
        to = min(len(order), at + STEPS[min(step, len(STEPS) - 1)])
        read = columns[order[at:to]] if alive is None else columns[np.ix_(order[at:to], alive)]
        partial = partial + a[at:to] @ read
        at, step = to, step + 1
        keep = (partial >= floor - high[at]) & (partial <= ceiling - low[at])
        n = np.count_nonzero(keep)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < 0.7 * len(keep) or at == len(order):
            alive = np.flatnonzero(keep) if alive is None else alive[keep]
            partial = partial[keep]
    if alive is None:  # an anchor of zeros
        inside = floor <= 0 <= ceiling
        alive, partial = np.arange(columns.shape[1])[: None if inside else 0], partial[: None if inside else 0]
    return alive, partial.astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n by score, the largest first, then id."""
    if len(ids) > 4 * n:  # ties with the n-th stay
        keep = scores >= np.partition(scores, len(scores) - n)[len(scores) - n]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:n]
    return ids[order], scores[order]


def _blocks(batches: Iterable[pa.RecordBatch], width: int, most_anchor: int) -> Iterator[Block]:
    held: list[pa.RecordBatch] = []
    rows = 0

    def close() -> Block:
        table = pa.Table.from_batches(held)
        lists = pa.concat_arrays([b.column("q") for b in held])
        longest = int(lists.value_lengths().to_numpy(zero_copy_only=False).max(initial=0))
        ids = table.column("vec_id").fill_null(NO_ID).to_numpy()
        # an anchor's dimensions beyond a vector's add nothing, and a vector's beyond the anchors' neither
        return Block(ids, table.column("label").to_numpy(), _matrix(lists, max(longest, width))[:, :width], most_anchor)

    for b in batches:
        for start in range(0, b.num_rows, ROWS):
            part = b.slice(start, ROWS)
            held.append(part)
            rows += part.num_rows
            if rows >= ROWS:
                yield close()
                held, rows = [], 0
    if rows:
        yield close()


FLOOR, CEILING = -(1 << 62), 1 << 62
POSITIVE = "anchor int, positive_id long, positive_score long"
NEGATIVE = "anchor int, window int, negative_id long, negative_score long"


def _scan_positives(rows: DataFrame, shared, n: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        ids = [np.zeros(0, np.int64)] * len(anchors.ids)
        scores = list(ids)
        for block in _blocks(batches, anchors.width, int(np.abs(anchors.q).max(initial=0))):
            for i, (own, label, q) in enumerate(zip(anchors.ids.tolist(), anchors.labels.tolist(), anchors.q, strict=True)):
                for x, y, held in block.stretches(label, True):
                    floor = int(scores[i][-1]) if len(scores[i]) == n else FLOOR
                    place, score = scan(block.columns[:, x:y], block.least[held[0]], block.most[held[0]], q, floor, CEILING)
                    other = block.ids[x + place] != own
                    if other.any():
                        ids[i], scores[i] = _best(np.concatenate((ids[i], block.ids[x + place][other])), np.concatenate((scores[i], score[other])), n)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        if sizes.sum():
            yield batch({"anchor": (np.repeat(np.arange(len(ids)), sizes), pa.int32()), "positive_id": (np.concatenate(ids), pa.int64()), "positive_score": (np.concatenate(scores), pa.int64())})

    return rows.mapInArrow(run, POSITIVE)


def _scan_negatives(rows: DataFrame, shared, n: int, low: int, high: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = shared.value
        # (floor, ceiling) of each anchor's windows, and the best rows inside so far
        limits = [[(-(-low * p // 100), high * p // 100) for p in own] for own in windows]
        best = [[(np.zeros(0, np.int64),) * 2 for _ in own] for own in windows]
        for block in _blocks(batches, anchors.width, int(np.abs(anchors.q).max(initial=0))):
            for i, (label, q) in enumerate(zip(anchors.labels.tolist(), anchors.q, strict=True)):
                for x, y, held in block.stretches(label, False):
                    now = [(max(f, int(s[-1]) if len(s) == n else f), c) for (f, c), (_, s) in zip(limits[i], best[i], strict=True)]
                    now = [(f, c) for f, c in now if f <= c]
                    if not now:
                        continue
                    least, most = block.least[held].min(axis=0), block.most[held].max(axis=0)
                    place, score = scan(block.columns[:, x:y], least, most, q, min(f for f, _ in now), max(c for _, c in now))
                    if not len(place):
                        continue
                    found = block.ids[x + place]
                    for w, (f, c) in enumerate(limits[i]):
                        inside = (score >= f) & (score <= c)
                        if inside.any():
                            was = best[i][w]
                            best[i][w] = _best(np.concatenate((was[0], found[inside])), np.concatenate((was[1], score[inside])), n)
        out = [(i, w, a, s) for i, own in enumerate(best) for w, (ids, scores) in enumerate(own) for a, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        if out:
            yield batch({c: (list(v), t) for c, v, t in zip(("anchor", "window", "negative_id", "negative_score"), zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    return rows.mapInArrow(run, NEGATIVE)


def _first(found: DataFrame, by: list[str], score: str, row: str, n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), row)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, label: Column | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows of ``vectors(vec_id, embedding, label)`` whose id ``every`` divides; an anchor's positives are its first
    ``positives`` other rows of its label, and of each positive's window, low * positive_score <= 100 * negative_score <= high * positive_score,
    the first ``negatives`` rows of other labels are returned.
    """
    spark = vectors.sparkSession
    rows = staged(quantised(vectors, scale, label))
    chosen = rows.where(F.col("vec_id") % every == 0)
    size = chosen.agg(F.coalesce(F.sum(F.size("q") * 4 + 32), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    made = []
    null_id = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    for k in range(blocks):
        table = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).orderBy("vec_id").toArrow()
        if not table.num_rows:
            continue
        anchors = Anchors(table)
        found = _scan_positives(rows, spark.sparkContext.broadcast(anchors), positives)
        held = _first(found, ["anchor"], "positive_score", "positive_id", positives).orderBy("anchor", "rank").select(*POSITIVE.replace(" int", "").replace(" long", "").split(", ")).toArrow()
        owner, ids, scores = (held.column(c).to_numpy() for c in ("anchor", "positive_id", "positive_score"))
        at = np.searchsorted(owner, np.arange(table.num_rows + 1))
        windows = [scores[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
        named = spark.createDataFrame(pa.table({"anchor": pa.array(owner, pa.int32()), "window": pa.array(np.arange(len(owner)) - at[owner], pa.int32()), "anchor_id": pa.array(anchors.ids[owner]), "positive_id": pa.array(ids), "positive_score": pa.array(scores)}))
        found = _scan_negatives(rows, spark.sparkContext.broadcast((anchors, windows)), negatives, low, high)
        best = _first(found, ["anchor", "window"], "negative_score", "negative_id", negatives)
        made.append(best.join(F.broadcast(named), ["anchor", "window"]).select("anchor_id", null_id("positive_id"), "rank", null_id("negative_id"), "positive_score", "negative_score"))
    if not made:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def moved_label(every: int = 7, labels: int = 10) -> Column:
    """The label, of the rows whose id ``every`` divides the next one."""
    return F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
