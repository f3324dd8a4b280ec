"""MinHash classes, token alignment and hard negatives against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import hard_negatives, minhash, token_alignment

WORDS = [f"w{i}" for i in range(400)]


def plain_set(text, width=3):
    words = (text or "").encode().translate(minhash.LOWER).split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(rows, percent=85, width=3):
    sets = [plain_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (d is None, d or 0))
    return Counter((d, len(sets[i]), None if least[find(i)][0] else least[find(i)][1]) for i, (d, _) in enumerate(rows))


def edited(dice, words, n):
    words = list(words)
    for _ in range(n):
        words[dice.randrange(len(words))] = dice.choice(WORDS)
    return words


def corpus(seed, size, longest):
    dice = random.Random(seed)
    passage = dice.choices(WORDS, k=60)
    rows = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "one"), (-5, "ONE"), (-6, "one two"), (-7, " one\ttwo "), (-8, "one two three")]
    while len(rows) < size:
        base = dice.choices(WORDS, k=dice.randint(3, longest))
        if dice.random() < 0.3:
            base += passage
        for _ in range(dice.choice([1, 1, 1, 4, 12])):
            rows.append((len(rows), dice.choice([" ", "\n", "  "]).join(edited(dice, base, dice.choice([0, 0, 1, 2, len(base) // 30, len(base) // 20])))))
    return rows


@pytest.mark.parametrize(("k", "block"), [(256, 4096), (64, 3)])
def test_classes_equal_plain_components(spark, k, block):
    rows = corpus(k, 500, 700)  # most sets are larger than the smaller sketch
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k, share=0.5, block=block)
    assert Counter(map(tuple, found.collect())) == plain_components(rows)


def test_classes_of_odd_tables(spark):
    long = " ".join(f"x{i % 5003}y{i // 7}" for i in range(200_000))
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (None, "A B C D"), (None, "only here with no id"), (3, long), (4, long + " end"), (5, "q" * 3_000_000), (5, "q" * 3_000_000), (6, "a b c d"), (6, "a b c d")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, sign string, cls int")
    found = Counter(map(tuple, minhash.near_duplicates(docs).collect()))
    assert found == plain_components(rows)
    assert minhash.digests(minhash.near_duplicates(docs.limit(0))).collect() == []


def test_shingles_do_not_depend_on_where_a_text_is_cut():
    dice = random.Random(5)
    text = b" ".join(str(dice.randrange(10**6)).encode() for _ in range(400_000))
    whole = minhash.shingle_sets([text], 3)[0]
    assert len(whole) == len(plain_set(text.decode()))
    some = minhash.shingle_sets([text[:1000], b"", text[:1000].upper()], 3)
    assert (some[0] == some[2]).all() and not len(some[1])


def test_near_copies_cost_rows_in_proportion(spark):
    """Pairs that are looked at, of n near copies of one text and a passage that all others share."""
    dice = random.Random(7)
    base, passage = dice.choices(WORDS, k=150), dice.choices(WORDS, k=50)
    seen = []
    for n in (300, 600):
        rows = [" ".join(edited(dice, base, dice.choice([0, 1, 2, 3, 8]))) for _ in range(n)] + [" ".join(dice.choices(WORDS, k=60) + passage) for _ in range(n)]
        sets = minhash.Sets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 3, 256, 85, 0.65)
        counted = []
        verify = sets.verified
        sets.verified = lambda pairs: counted.append(pairs.count()) or verify(pairs)  # noqa: B023
        minhash.links(sets).count()
        seen.append(sum(counted))
    assert seen[1] < 3 * seen[0] and seen[1] < 12 * 1200


def test_long_texts_that_are_alike_but_not_linked_leave_few_pairs(spark):
    """Texts of one base with edits of their own, 0.6 to 0.8 alike: more shingles than a sketch holds, and all pairs share prefix values."""
    dice = random.Random(11)
    base = [f"w{i}" for i in range(420)]
    rows = []
    for d in range(200):
        words = list(base)
        for k, i in enumerate(dice.sample(range(0, 420, 6), dice.choice([11, 13, 15]))):
            words[i] = f"own{d}x{k}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame([*rows, (200, rows[0][1] + " end")], "doc_id long, text string")
    sets, counted = minhash.Sets(docs, 3, 256, 85, 0.65), []
    verify = sets.verified
    sets.verified = lambda pairs: counted.append(pairs.count()) or verify(pairs)
    linked = sets.classes.join(minhash.links(sets), "cls").groupBy("root").agg(F.sort_array(F.collect_list("rep.doc_id")).alias("ids"))
    assert [r.ids for r in linked.collect()] == [[0, 200]]
    assert sum(counted) <= 20


@pytest.mark.parametrize("block", [7, 4096])
def test_members_of_lists_meet_as_by_plain_conditions(spark, block):
    """The second round's helper against the conditions that the first round's joins use, on lists of sets of many sizes."""
    dice = random.Random(3)
    base = [f"w{i}" for i in range(500)]
    rows = []
    for d in range(60):
        words = base[: dice.randrange(60, 500)]
        for k in range(dice.randrange(1, 6)):
            words[dice.randrange(len(words))] = f"own{d}x{k}"
        rows.append((d, " ".join(words)))
    sets = minhash.Sets(spark.createDataFrame(rows, "doc_id long, text string"), 3, 128, 85, 0.65)
    entries = minhash._entries(sets.classes, sets.percent, sets.k, sets.floor).withColumn("root", F.col("cls") % 5).cache()
    side = lambda end: entries.select("value", *[F.col(c).alias(f"{c}{end}") for c in ("cls", "n", "place", "root")])
    met = side("_x").join(side("_y"), "value").where((F.col("cls_x") < F.col("cls_y")) & (F.col("root_x") != F.col("root_y")) & sets.near("_x", "_y"))
    want = sets.tightly(met.select(F.col("cls_x").alias("a"), F.col("cls_y").alias("b")).distinct())
    found = sorted(map(tuple, sets.meeting(entries, block).distinct().collect()))
    assert found == sorted(map(tuple, want.collect())) and len(found) > 20
    # no join makes these pairs, so their number is no row's of a join
    assert "root_l" not in sets.meeting(entries, block)._jdf.queryExecution().toString()


def plain_alignment(rows):
    both = token_alignment.sides()
    a, b = both.plainly([t or "" for _, t in rows])
    found, held = [], []
    for (d, text), x, y in zip(rows, a, b, strict=True):
        want = b" " + text.encode() if text else b""
        if not want or b"".join(both.bytes_a[i] for i in x) != want or b"".join(both.bytes_b[i] for i in y) != want:
            found.append((d, 0, 0, [], Counter()))
            held.append(set())
            continue
        ends_a, ends_b = np.cumsum([len(both.bytes_a[i]) for i in x]).tolist(), np.cumsum([len(both.bytes_b[i]) for i in y]).tolist()
        groups = []
        for end in sorted(set(ends_a) & set(ends_b)):
            done_a, done_b = sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups)
            groups.append((x[done_a : ends_a.index(end) + 1], y[done_b : ends_b.index(end) + 1]))
        links = Counter((i, j) for g in groups for i in g[0] for j in g[1])
        found.append((d, len(x), len(y), groups, links))
        held.append(set(links))
    count = Counter(p for h in held for p in h)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = Counter()
    for d, n_a, n_b, groups, links in found:
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out[(d, n_a, n_b, len(groups), links.total(), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else "")] += 1
    return out


HARD = ["", None, " ", "plain words of a text", "two  spaces\tand\na line", "ＦＵＬＬ ｗｉｄｔｈ", "naïve café – “quoted” 日本語の文章です", "<|endoftext|> <s> </s> <0x41> ▁ bar", "😀👍🏽 mixed 中文 text", "a" * 500, "ab" * 3000, "\x00\x01 control", "trailing space ", " leading", "nbsp here", "é combining"]


def test_alignment_equals_a_plain_version(spark):
    dice = random.Random(3)
    alphabet = "abcdefghij  ÄÖß\n.,;0123456789日本語é"
    rows = [*enumerate(HARD), (3, "plain words of a text"), (None, "no id"), *((100 + i, "".join(dice.choices(alphabet, k=dice.randint(1, 300)))) for i in range(200))]
    docs = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, pairs string, n int").repartition(3)
    want = plain_alignment(rows)
    for block in (4_000_000, 50):  # one table of counts, and several
        got = Counter(map(tuple, token_alignment.digests(docs, block=block).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))
        assert got == want
    assert token_alignment.digests(docs.limit(0)).collect() == []


def test_alignment_groups_and_wide_groups(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    rows = token_alignment.groups(docs).orderBy("doc_id", "group").collect()
    both = token_alignment.sides()
    for i, text in enumerate(HARD):
        own = [r for r in rows if r.doc_id == i]
        if own:
            whole = b" " + text.encode()
            assert own[0].start == 0 and own[-1].end == len(whole) and all(x.end == y.start for x, y in zip(own, own[1:], strict=False))
            for r in own:
                assert b"".join(both.bytes_a[x] for x in r.a) == b"".join(both.bytes_b[x] for x in r.b) == whole[r.start : r.end]
    texts = [(t or "").encode() for t in HARD]
    narrow = [x.tolist() for x in token_alignment.Aligned(texts, both).pairs()]
    monkeypatch.setattr(token_alignment, "WIDE", 1)
    assert [x.tolist() for x in token_alignment.Aligned(texts, both).pairs()] == narrow


def plain_negatives(rows, every=50, scale=256):
    used = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [int(np.floor(scale * np.float64(x))) for x in v]) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda found: sorted(found, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    out = Counter()
    for i, lab, v in used:
        if i is None or i % every:
            continue
        dot = [(j, sum(x * y for x, y in zip(v, w, strict=False)), other) for j, other, w in used]
        for p, ps, _ in order([r for r in dot if r[2] == lab and r[0] != i])[:5]:
            for rank, (n, ns, _) in enumerate(order([r for r in dot if r[2] != lab and 50 * ps <= 100 * r[1] <= 95 * ps])[:3], 1):
                out[(i, p, rank, n, ps, ns)] += 1
    return out


@pytest.mark.parametrize("scale", [0.1, 3.0, 5000.0])
def test_negatives_equal_a_plain_version(spark, scale, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 97)
    dice = random.Random(int(scale))
    pool = [[dice.gauss(0, scale) for _ in range(24)] for _ in range(150)]
    rows = [(i, [float(np.float32(x)) for x in dice.choice(pool)], dice.randrange(10)) for i in range(700)]
    rows += [(800, [float("nan")] * 24, 1), (850, [1.0, None], 1), (900, None, 1), (950, [float("inf")], 2), (1000, [1.0] * 24, None), (1050, [], 3), (1100, [0.0] * 24, 4), (None, pool[0], 2), (1150, pool[1][:5], 5), (1151, pool[1] + [9.0], 6), (350, pool[2], 3), (350, pool[2], 3)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, q string").repartition(3)
    want = plain_negatives(rows)
    for bytes_ in (16 << 20, 300):  # anchors in one block, and in several
        got = hard_negatives.mine(table, label=hard_negatives.moved_label(), block_bytes=bytes_)
        assert Counter(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    assert hard_negatives.mine(table.limit(0)).collect() == []


def test_scan_finds_what_a_product_finds_and_leaves_columns_out():
    dice = np.random.default_rng(1)
    columns = np.floor(dice.normal(0, 30, (64, 5000))).astype(np.float32)
    for k in range(20):
        anchor = np.floor(dice.normal(0, 1, 64) * np.linspace(100, 0, 64)).astype(np.int32)
        whole = anchor @ columns.astype(np.int64)
        floor, ceiling = int(np.quantile(whole, 0.99)), int(np.quantile(whole, 0.999)) + k
        place, score = hard_negatives.scan(columns, columns.min(axis=1), columns.max(axis=1), anchor, floor, ceiling)
        inside = (whole >= floor) & (whole <= ceiling)
        assert place.tolist() == np.flatnonzero(inside).tolist() and score.tolist() == whole[inside].astype(int).tolist()


def test_hot_groups(spark):
    """A third of the rows are one text, or one vector."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text in very many rows").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("text"))
    found = minhash.near_duplicates(docs)
    assert found.where("component_id = 0").count() == 1000 and found.select("component_id").distinct().count() == 2001
    vectors = spark.range(1500).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.rand(1), F.rand(2))).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    got = Counter(map(tuple, hard_negatives.mine(vectors, label=hard_negatives.moved_label()).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == plain_negatives(rows)
