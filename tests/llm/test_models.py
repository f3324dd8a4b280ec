"""Suffix tree, language identification and line quality."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import crf, language_id, quality, suffix_tree

SMALL = "/root/testdata/sf0.001"


def test_marginals_match_enumeration():
    dice = np.random.default_rng(1)
    lengths, k = np.array([3, 1, 4, 2]), 3
    e, t, s = dice.normal(size=(lengths.sum(), k)) * 2, dice.normal(size=(k, k)), dice.normal(size=k)
    gamma, total, pairs = crf.marginals(e, lengths, t, s, pairs=True)
    at, logs, want_pairs = 0, 0.0, np.zeros((k, k))
    for n in lengths:
        weights = {}
        for path in itertools.product(range(k), repeat=int(n)):
            weights[path] = math.exp(s[path[0]] + sum(e[at + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
        z = sum(weights.values())
        logs += math.log(z)
        for i in range(n):
            for y in range(k):
                assert abs(gamma[at + i, y] - sum(w for p, w in weights.items() if p[i] == y) / z) < 1e-9
        for p, w in weights.items():
            for a, b in zip(p, p[1:], strict=False):
                want_pairs[a, b] += w / z
        at += n
    assert abs(total - logs) < 1e-9 and np.allclose(pairs, want_pairs)


@pytest.mark.parametrize("longest", [64, 7, 1])
def test_pieces_of_a_long_sequence_give_its_marginals(longest):
    dice = np.random.default_rng(3)
    lengths, k = np.array([900, 1, 7, 65, 64, 128, 0, 300]), 4
    e, t, s = dice.normal(size=(lengths.sum(), k)) * 3, dice.normal(size=(k, k)) * 2, dice.normal(size=k)
    whole, cut = (crf.marginals(e, lengths, t, s, pairs=True, longest=n) for n in (10_000, longest))
    assert np.abs(whole[0] - cut[0]).max() < 1e-9 and abs(whole[1] - cut[1]) < 1e-7 and np.abs(whole[2] - cut[2]).max() < 1e-7


def plain_forward_backward(emission, transition, start):
    """Marginals of one sequence, position by position."""
    z = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    k = range(len(start))
    forward = [[start[y] + emission[0][y] for y in k]]
    for e in emission[1:]:
        forward.append([e[y] + z([forward[-1][a] + transition[a][y] for a in k]) for y in k])
    backward = [[0.0] * len(start)]
    for e in reversed(emission[1:]):
        backward.insert(0, [z([transition[y][b] + e[b] + backward[0][b] for b in k]) for y in k])
    return [[math.exp(f[y] + b[y] - z([f[a] + b[a] for a in k])) for y in k] for f, b in zip(forward, backward, strict=True)]


def plain_line(line):
    """The features of one line, each by its own words."""
    n, words = len(line), line.split()
    kinds = [bytes(c) for c in quality.CLASSES.values()]
    counts = [sum(b in c for b in line) for c in kinds]
    counts.append(n - sum(counts))
    most = max(1, len(words))
    return [math.sqrt(c / max(1, n)) for c in counts] + [
        math.log1p(n) / 6, math.log1p(len(words)) / 5, (n - line.count(b" ") - line.count(b"\t")) / most / 10, 1 - len(set(words)) / most, line[:1].isupper(),
        line.rstrip().endswith((b".", b"!", b"?")), sum(a == b for a, b in zip(words, words[1:], strict=False)) / most, n == 0,
    ]


def test_quality_score_by_hand():
    dice = np.random.default_rng(5)
    model = quality.Model()
    model.weights, model.transition, model.start, model.scale, model.bias = dice.normal(size=model.weights.shape), dice.normal(size=(2, 2)), dice.normal(size=2), 0.7, -0.2
    texts = ["One line.\n\nTwo  two | lines!\nOne line.\n\ttab é 12", "", "\n", "x", "a b\n" * 40]
    for text, got in zip(texts, model.scores([t.encode() for t in texts]).tolist(), strict=True):
        lines = text.encode().split(b"\n")
        own, none = [plain_line(x) for x in lines], [0.0] * quality.OWN
        rows = [own[i] + (own[i - 1] if i else none) + (own[i + 1] if i + 1 < len(own) else none) + [i == 0, i + 1 == len(own), lines[i] in lines[:i], 1] for i in range(len(lines))]
        emission = [[sum(f * w for f, w in zip(row, model.weights[:, y], strict=True)) for y in (0, 1)] for row in rows]
        good = [g[1] for g in plain_forward_backward(emission, model.transition.tolist(), model.start.tolist())]
        mean = min(1 - 1e-4, max(1e-4, sum(g * (len(x) + 1) for g, x in zip(good, lines, strict=True)) / sum(len(x) + 1 for x in lines)))
        assert abs(got - 1 / (1 + math.exp(-(0.7 * math.log(mean / (1 - mean)) - 0.2)))) < 1e-5
    assert len(model.scores([b"\n" * (1 << 20), b"a\n" * 300_000])) == 2


def test_language_score_by_hand(spark):
    rows = [("the cat and the dog sat", "en"), ("the house of the cat", "en"), ("der hund und die katze", "de"), ("die maus und der hund", "de")] * 3
    model = language_id.fit(rows, bits=10)
    texts = ["The dog und die Katze", "der, der 12 x_y", "straße " * 3000]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", text.lower())
        emission = []
        for w in words:
            data, ids = f"^{w}$".encode(), []
            for n in range(1, 6):
                for a in range(len(data) - n + 1):
                    if n > 1 or 0 < a < len(data) - 1:
                        ids.append((int.from_bytes(data[a : a + n], "big") + n) * 0x9E3779B97F4A7C15 % 2**64 >> 54)
            ids += [1024 + model.lexicon[w]] if w in model.lexicon else []
            emission.append([sum(float(model.weights[x, y]) for x in ids) / math.sqrt(len(ids)) for y in (0, 1)])
        gamma = plain_forward_backward(emission, model.transition.tolist(), model.start.tolist())
        share = [sum(g[y] * len(w) for g, w in zip(gamma, words, strict=True)) / sum(map(len, words)) for y in (0, 1)]
        best = max((0, 1), key=lambda y: share[y])  # noqa: B023
        assert got[i][0] == model.languages[best] and abs(got[i][1] - share[best]) < 1e-5


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_language(spark, docs):
    extra = spark.createDataFrame([(9000, None, "en"), (9001, "", "en"), (9002, "123 !!", None), (9003, "²³", "fr")], "doc_id long, text string, lang string")
    rows = language_id.predict_held_out(docs.select("doc_id", "text", "lang").unionByName(extra)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count() + 4 and all(0 <= r.score <= 1 for r in rows)
    assert all(by[i].lang_pred == "und" for i in (9000, 9001, 9002, 9003))
    truth = [(r.lang, by[r.doc_id].lang_pred) for r in docs.collect() if by[r.doc_id].held_out]
    assert sum(a == b for a, b in truth) >= 0.97 * len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_code_switching(spark, docs):
    model = language_id.learn(docs, docs.doc_id >= 0)
    en, de = (" ".join(docs.where(f"lang = '{x}' and length(text) > 400").first().text.split()[:40]) for x in ("en", "de"))
    found = language_id.label_words(spark.createDataFrame([(1, f"{en} {de}"), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    words = [w.lang for w in found[0].words]
    half = len(language_id.words_of(en))
    assert words[:half].count("en") > 0.9 * half and words[half:].count("de") > 0.9 * (len(words) - half) and found[1].words == []
    assert {r.lang_pred for r in language_id.predict(docs.limit(3), language_id.fit([])).collect()} == {"und"}


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    extra = spark.createDataFrame([(9000, None), (9001, ""), (9002, "\n\n")], "doc_id long, text string")
    rows = quality.score_held_out(docs.select("doc_id", "text").unionByName(extra), labels).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count() + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    pairs = [(r.quality, by[r.doc_id].predicted) for r in labels.collect() if r.doc_id in by]
    assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs)
    model = quality.learn(docs, labels, labels.doc_id >= 0)
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    scored = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert kept == {i for i, v in scored.items() if v >= 0.3}
    assert {r.score for r in quality.score(docs.limit(2), quality.Model()).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []


def plain_base(rows):
    tokens = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w] + [""]
    train = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    out = {}
    for i, t in rows:
        ws = tokens(t)
        out[i] = (len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    return out


@pytest.mark.parametrize("hot", [2e-6, 1e-3])
def test_suffix_tree(spark, docs, hot):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000, None), (5001, ""), (5002, "Zzz zzz q"), (5003, "the a"), (5003, "the a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_tree.score(df, suffix_tree.id_remainder("doc_id", 5) != 1, hot_share=hot).collect()
    want = plain_base(rows)
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        n, known, train, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and abs(r.base_score - base) < 1e-6 * max(1, -base)
        assert r.score < 0
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def plain_scores(rows, train_ids, reach, detail, depth, least_divergence, weight):
    """The tree's scores, by counting tuples of symbols one text at a time."""
    split = [("" if t is None else t).encode().translate(suffix_tree.LOWER).split() + [b""] for _, t in rows]
    learned = [w for w, (i, _) in zip(split, rows, strict=True) if i in train_ids]
    c = Counter(w for ws in learned for w in ws)
    total = sum(c.values())
    least = max(8.0, reach * math.sqrt(total))
    ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
    discount = min(0.9, max(0.1, ones / (ones + 2 * twos)))
    tails = Counter()
    for w, n in c.items():
        if w and n < least:
            tails[w[-2:]] += n

    def symbol(w):
        if not w or c[w] >= least:
            return w
        return ("class", w[-2:] if tails[w[-2:]] >= least else "pooled")

    mass, kinds = Counter({("class", "pooled"): 0}), Counter()
    for w, n in c.items():
        mass[symbol(w)] += n
        kinds[symbol(w)] += isinstance(symbol(w), tuple)
    root = {s: (m + 0.5) / (total + 0.5 * len(mass)) for s, m in mass.items()}
    after = defaultdict(Counter)
    for ws in learned:
        run = [b"", *map(symbol, ws)]
        for i in range(1, len(run)):
            for k in range(1, min(depth, i) + 1):
                after[tuple(run[i - k : i])][run[i]] += 1
    contexts = {x for x, n in after.items() if n.total() >= least}
    cut = max(2.0, least / detail)

    def p(s, x):
        """Of a symbol behind a context of which all suffixes are contexts."""
        if not x:
            return root[s]
        kept = {y: n for y, n in after[x].items() if n >= cut}
        return (kept.get(s, 0) + (after[x].total() - sum(kept.values()) + weight) * p(s, x[1:])) / (after[x].total() + weight)

    retained = set()
    for x in contexts:
        n = after[x].total()
        kept = {y: m / n for y, m in after[x].items() if m >= cut}
        divergence = sum(q * math.log(q / p(y, x[1:])) for y, q in kept.items())
        rest, below = 1 - sum(kept.values()), 1 - sum(p(y, x[1:]) for y in kept)
        if rest > 1e-12 and below > 1e-12:
            divergence += rest * math.log(rest / below)
        if divergence >= least_divergence:
            retained |= {x[k:] for k in range(len(x))}
    scores = []
    for ws in split:
        run, logs = [b"", *map(symbol, ws)], 0.0
        for i in range(1, len(run)):
            x = ()
            for k in range(1, min(depth, i) + 1):
                if tuple(run[i - k : i]) not in retained:
                    break
                x = tuple(run[i - k : i])
            logs += math.log10(p(run[i], x))
            if isinstance(run[i], tuple):
                w = ws[i - 1]
                logs += math.log10((c[w] - discount if c[w] else discount * kinds[run[i]] + 1) / (mass[run[i]] + 1))
        scores.append(logs)
    return scores, retained


@pytest.mark.parametrize("chunk", [1_000_000, 2_000])
def test_suffix_tree_matches_plain_counting(spark, docs, chunk):
    rows = [(r.doc_id, r.text) for r in docs.limit(80).collect()] + [(5000, None), (5001, ""), (5002, "Zzz zzz q")]
    options = {"reach": 0.12, "detail": 4.0, "depth": 3, "least_divergence": 0.05, "weight": 5.0}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in suffix_tree.score(df, F.col("doc_id") % 4 != 0, hot_share=1e-3, chunk=chunk, **options).collect()}
    want, retained = plain_scores(rows, {i for i, _ in rows if i % 4}, **options)
    assert {len(x) for x in retained} == {1, 2, 3}
    for (i, _), w in zip(rows, want, strict=True):
        assert abs(got[i] - w) < 1e-6 * max(1, -w)


def test_few_runs_leave_the_executors_however_small_a_chunk(spark, docs):
    """Chunks of a ten-thousandth of the least count's share name every run, as those of a corpus of billions of tokens do."""
    counts = suffix_tree.staged(suffix_tree.count_words(docs))
    a, least, _ = suffix_tree.alphabet_of(counts)
    found = suffix_tree.staged(suffix_tree.encode(docs, F.lit(True), spark.sparkContext.broadcast(a))).select("ids", "n_tokens")
    chunk, listed = 500, least / 16
    assert suffix_tree.NAMED * least / a.total * chunk < 1.5
    contexts = suffix_tree._contexts(found, least, a.total, 4, chunk).toPandas().key.to_numpy().astype("uint64")
    assert 0 < len(contexts) <= 3 * a.total / ((1 - suffix_tree.NAMED) * least)
    shared = spark.sparkContext.broadcast(np.sort(np.concatenate((suffix_tree._mix(0, np.flatnonzero(np.array(a.mass) >= least)), contexts))))
    named = suffix_tree._candidates(found, shared, listed, a.total, 4, chunk).count()
    every = len({tuple(x[max(0, i - m) : i + 1]) for r in found.collect() for x in [np.frombuffer(r.ids, np.int32).tolist()] for i in range(len(x)) for m in range(1, 5)})
    assert 0 < named <= 4 * a.total / ((1 - suffix_tree.NAMED) * listed) and named < every / 10


def test_suffix_tree_is_a_distribution(spark, docs):
    train = docs.limit(60)
    counts = suffix_tree.staged(suffix_tree.count_words(train))
    a, least, _ = suffix_tree.alphabet_of(counts, 0.2)
    found = suffix_tree.staged(suffix_tree.encode(train, F.lit(True), spark.sparkContext.broadcast(a)))
    tree = suffix_tree.learn(found, a, least)
    text = np.frombuffer(max((bytes(r.ids) for r in found.collect()), key=len), np.int32)[:40]
    for before in range(0, 40, 3):
        # the same text up to a position, with every symbol there
        ids = np.concatenate([np.append(np.append(text[:before], s), 1) for s in range(a.symbols)]).astype(np.int32)
        at = np.arange(a.symbols) * (before + 2) + before
        logs = tree.log_probs(ids, np.tile(np.arange(before + 2), a.symbols))
        assert abs((10.0 ** logs[at]).sum() - 1) < 1e-9
    # within a class: the known words' shares and the unknown's
    tails = {}
    for r in counts.collect():
        w, c = bytes(r.word), r.c
        if w and c < least:
            tails.setdefault(a.symbol_of.get(w[-2:], 0), []).append(c)
    for k, cs in tails.items():
        assert abs(sum((c - a.discount) / (a.mass[k] + 1) for c in cs) + 10 ** a.unknown[k] - 1) < 1e-6


def test_contexts_grow_with_the_corpus(spark, docs):
    sizes = []
    for n in (25, 100, 200):
        counts = suffix_tree.staged(suffix_tree.count_words(docs.orderBy("doc_id").limit(n)))
        a, least, _ = suffix_tree.alphabet_of(counts, 0.2)
        found = suffix_tree.staged(suffix_tree.encode(docs.orderBy("doc_id").limit(n), F.lit(True), spark.sparkContext.broadcast(a)))
        sizes.append(len(suffix_tree.learn(found, a, least).context))
    assert sizes == sorted(set(sizes)) and sizes[2] > 1.5 * sizes[0]


def test_suffix_tree_without_training(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = suffix_tree.score(df, suffix_tree.F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got) and len(got) == 2
    assert suffix_tree.score(df.limit(0), suffix_tree.F.lit(True)).collect() == []
