"""Every operator and pipeline stage on tables with nulls, repeated ids, odd names and long texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import decontaminate, language_id, line_chunks, matroska, mixing, quality, simhash, suffix_tree, token_ids

NAMES = (
    "rows gone once drop chunks given id hash nth f_id f_hash from row times plan p_id p_source p_hash h slot up rest n_docs payload _payload media packet packets cues error track offset fp least root k_id k_hash again "
    "r_id r_hash score _spans _hit_id _hit_hash spans items part before local held n u value count by first chunk c sign at"
).split()
LONG = "\n".join(f"a long line number {i} with words" for i in range(20_000))
ITEM = "one two three four five six seven eight nine ten eleven"
TEXTS = [
    (1, "first text of one id\nwith two lines\nand a third"), (1, "second text of one id\nquite another thing\nto be kept"), (None, "a text without an id\nand its lines\nfor once"), (None, "another text without an id\nand other lines\nfor twice"),
    (2, "repeated row\nof two lines\nor three"), (2, "repeated row\nof two lines\nor three"), (3, "repeated row\nof two lines\nor three"), (4, None), (5, ""), (6, " \n\n "), (7, LONG), (8, f"prefix {ITEM.upper()} suffix"), (None, None), (9, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 4 == 3 else "en", None if k % 5 == 4 else f"src{k % 2}", *[f"{n} {k}" for n in NAMES]) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)).cache()


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, 1, 0), (2, None, 0), (6, 0, 1), (9, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def same_columns(before, after):
    """Rows as they came in, and each given column with its own value."""
    assert after.columns[: len(before.columns)] == before.columns or set(before.columns) <= set(after.columns)
    known = Counter(map(str, before.drop("text").collect()))
    got = Counter(map(str, after.select(*[c for c in before.columns if c != "text"]).collect()))
    assert not got.keys() - known.keys()
    return known, got


def test_names_and_repeated_ids(odd):
    known, got = same_columns(odd, line_chunks.drop_repeated_chunks(odd))
    assert got == known
    kept = simhash.drop_near_duplicates(odd)
    same_columns(odd, kept)
    found = Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())
    assert max(found.values()) == 1 and {t for _, t in found if t and len(t) > 1 and t.strip()} == {t for _, t in TEXTS if t and len(t) > 1 and t.strip()}
    assert sum(not (t or "").strip() for _, t in found) == 1
    known, got = same_columns(odd, mixing.repeat_documents(odd, share=1.0, most=1.0, weights=(1.0,)))
    assert sum(got.values()) >= len(TEXTS) - 6
    media = matroska.mux(odd, "text")
    known, got = same_columns(odd.drop("media"), media)
    assert got == known and media.columns == [*(c for c in odd.columns if c != "media"), "media"]
    packets = matroska.packets(media)
    assert packets.where("doc_id = 9").select("packet", "track", "size", "payload").collect() == [(0, 1, 576, "payload 13")]
    assert matroska.cues(media).count() == len(TEXTS) - 1 + -(-len(LONG) // (576 * 256)) and "error 1" not in {r.error for r in matroska.demux(media).select("error").collect()}
    assert matroska.packets(media.limit(0)).count() == 0 == matroska.cues(media.limit(0)).count()


def test_decontamination(odd, place, spark):
    items = spark.read.parquet(f"{place}/benchmark.parquet")
    known, got = same_columns(odd, decontaminate.remove_documents(odd, items))
    assert known - got == Counter({str(odd.where("doc_id = 8").drop("text").first()): 1})
    cut = decontaminate.remove_spans(odd, items)
    known, got = same_columns(odd, cut)
    assert got == known and cut.where("doc_id = 8").first().text.split() == ["prefix", "suffix"]
    assert decontaminate.remove_spans(odd.limit(0), items).collect() == []


def test_models(odd, place, spark):
    labels = spark.read.parquet(f"{place}/labels.parquet")
    scored = quality.score_held_out(odd, labels).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r.score <= 1 for r in scored)
    same_columns(odd, quality.keep_good(odd, quality.learn(odd, labels, F.lit(True))))
    guessed = language_id.predict_held_out(odd).collect()
    assert len(guessed) == len(TEXTS) and {r.lang_pred for r in guessed if r.doc_id in (4, 5, 6)} == {"und"}
    model = language_id.learn(odd, F.lit(True))
    assert language_id.label_words(odd, model).count() == len(TEXTS) and language_id.label_words(odd.limit(0), model).count() == 0
    assert suffix_tree.score_held_out(odd).count() == len(TEXTS)
    assert token_ids.token_digests(odd).count() == len(TEXTS)


def test_every_stage(odd, place, spark):
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, place)
            if last:
                assert out.count() == docs.count()
            else:
                known, got = same_columns(docs, out)
                assert out.columns == docs.columns and (name == "mixing" or not got - known)
    # the rows that went: all but one of each component, and contaminated ones
    kept = corpus_pipeline.near_duplicates(spark, odd, place).select("doc_id", "text").collect()
    assert len(kept) == len({t if (t or "").strip() else None for _, t in TEXTS})
