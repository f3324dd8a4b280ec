"""Mixing and quotation linking, and the pipeline."""

import random
import re

import pytest

import corpus_pipeline
from lectern.llm import mixing, quotes

SMALL = "/root/testdata/sf0.001"


def plain_targets(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    dice = random.Random(seed)
    rows = [(i, " ".join(["w"] * dice.choice((0, 1, 5, 50, 300))), dice.choice(["a", "a", "a", "a", "b", "é", None, "Z"])) for i in range(900)]
    rows += [(9000, None, "a"), (9001, "x", "only"), (3, rows[3][1], rows[3][2]), (None, "q q", "b"), (9002, "", "empty")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) < 300  # one document
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    again = mixing.repeat_documents(df)
    assert again.columns == df.columns and again.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).collect() == []


def test_mean_copies(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "a" if i % 3 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mix(df, share=0.5, seed=0).collect()
    mean = {r.doc_id: r.target / r.source_size for r in first}
    seen = dict.fromkeys(mean, 0)
    for seed in range(12):
        for r in mixing.mix(df, share=0.5, seed=seed).collect():
            seen[r.doc_id] += r.copies
    assert abs(sum(seen.values()) / 12 - sum(mean.values())) < 2.5
    assert len({v for v in seen.values()}) > 3


def test_mix_of_copies(spark):
    """A third of the rows are one row, another third one text without ids; each is counted as one member."""
    rows = [(7, "same words here", "a", k % 2) for k in range(400)] + [(None, "no id", "a", k) for k in range(400)] + [(100 + i, "x " * (1 + i % 9), "a" if i % 2 else "b", 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for ident, size in ((7, 3), (None, 2)):
        own = [r for r in got if r.doc_id == ident and r.size == size]
        assert len(own) == 400 and abs(sum(r.copies for r in own) - 400 * own[0].target / own[0].source_size) < 1
    out = mixing.repeat_documents(df).collect()
    assert len(out) == sum(r.copies for r in got) and sum(len(r.text.split()) for r in out) == sum(r.taken for r in got)
    assert sum(r.doc_id == 7 for r in out) == sum(r.copies for r in got if r.doc_id == 7)
    assert sum(r.doc_id is None for r in out) == sum(r.copies for r in got if r.doc_id is None)
    assert {r.copies for r in out if r.doc_id == 7} == {0, 1}


CHAT = [
    (1, 0, "a", "Hello there\n\nSecond  paragraph here"),
    (1, 1, "b", "> hello   THERE\nmy answer"),
    (1, 2, "a", "> > hello there\n> my answer\nThanks"),
    (1, 3, "b", "> never said\nstill"),
    (2, 0, "a", ">Thanks\nfrom elsewhere"),
    (2, 1, "b", None),
    (2, 2, "b", "> from elsewhere\n> "),
    (2, 3, "a", "Hello there"),
    (2, 3, "a", "Hello there"),
    (3, 0, "a", "> later words\nme"),
    (3, 1, "b", "later words"),
]


def test_quotes(spark):
    df = spark.createDataFrame([(*r, "x") for r in CHAT], "conv_id long, turn long, role string, text string, depth string")
    out = quotes.conversations(df)
    by = {(r.conv_id, r.turn): r for r in out.collect()}
    reply = {k: (r.reply_conv, r.reply_turn) for k, r in by.items() if r.reply_turn is not None}
    assert reply == {(1, 1): (1, 0), (1, 2): (1, 1), (2, 0): (1, 2), (2, 2): (2, 0)}
    assert [by[k].depth for k in ((1, 0), (1, 1), (1, 2), (2, 0), (2, 2))] == [0, 1, 2, 3, 4]
    assert (by[2, 2].root_conv, by[2, 2].root_turn) == (1, 0)
    assert by[1, 2].clean == "Thanks" and by[1, 2].max_level == 2 and by[1, 2].n_quotes == 2
    assert by[2, 1].clean == "" and by[1, 3].clean == "still" and by[2, 2].clean == ""
    assert out.count() == len(CHAT)
    assert [(r.conv_id, r.turn) for r in quotes.reply_order(out).limit(5).collect()] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 2)]
    assert quotes.conversations(df.limit(0)).collect() == []
    assert not any(re.search("(?m)^>", r.clean) for r in out.collect())


def test_quotes_cycle(spark):
    rows = [(1, 0, "> bb\naa"), (2, 0, "> aa\nbb")]
    out = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert len(out) == 2 and all(r.reply_turn == 0 for r in out)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        after = corpus_pipeline.staged(after)
        if name != "mixing":
            assert 0 < after.count() <= docs.count()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(last) == docs.count()
    ordered = sorted(last, key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, last))


def test_quotes_of_parts(spark):
    three = "First part\nof two lines\n\nSecond part\n\nThird part"
    rows = [
        (1, 0, three),
        (1, 1, "> first part\n> of two lines\n>\n> third part\nto two of three paragraphs"),
        (1, 2, "> of two lines\nto a line"),
        (1, 3, "Alpha\nBravo\nCharlie\nDelta"),
        (1, 4, "> Bravo\n> Charlie\n> said nowhere\nto lines among others"),
        (2, 0, "Alpha"), (2, 1, "Bravo"),
        # each line was first said elsewhere, the run of them here
        (3, 0, "Bravo"), (3, 1, "Charlie"), (3, 2, "Alpha\nBravo\nCharlie\nEcho"), (3, 3, "> Alpha\n> Bravo\n> Charlie\nto a run"),
        # the first of all is the quoting conversation's own later message
        (4, 0, "> only here and later\nme"), (4, 1, "only here and later"), (5, 0, "only here and later"),
        (6, 0, "> one thing\n> and another\n> and no other\nto a rewrapped paragraph\n\n> lost"), (7, 0, "intro\n\none thing and\nanother and no other"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    by = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotes.conversations(df).collect() if r.reply_turn is not None}
    assert by == {(1, 1): (1, 0), (1, 2): (1, 0), (1, 4): (1, 3), (3, 3): (3, 2), (4, 0): (5, 0), (6, 0): (7, 0)}
