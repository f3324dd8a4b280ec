"""Registered queries over whole tables against plain versions."""

import re

import pytest

from lectern.operators import retrieval
from lectern.plans import queries


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """45 short chunks of each of a question's words push the one long chunk with all of them out of the first arm."""
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(i, "alpha alpha alpha" if i % 2 else "bravo bravo bravo") for i in range(90)]
    docs += [(100, "alpha bravo " + "filler words " * 1500), (101, "bravo " + "filler words " * 1500 + "alpha"), (102, "Zulu"), (103, None)]
    spark.createDataFrame([(*x, "en" if x[0] % 3 else "de", f"src{x[0] % 3}") for x in docs], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    items = [(0, "alpha bravo"), (1, "alpha zulu"), (2, "zulu or nothing"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d, dict(docs), dict(items)


def plain_strict(docs, items):
    """(question, chunk) -> rank, of the fixture's plain words."""
    out = {}
    for q, question in items.items():
        for group in re.split(" or ", question or ""):
            want = group.split()
            for c, text in docs.items():
                words = re.findall("[a-z]+", (text or "").lower())
                if want and set(want) <= set(words):
                    rank = retrieval.cover_density([[i for i, x in enumerate(words) if x == w] for w in want])
                    out[q, c] = max(rank, out.get((q, c), 0))
    return out


def test_strict_arm_enters_the_fusion(spark, place):
    d, docs, items = place
    want = plain_strict(docs, items)
    assert set(want) == {(0, 100), (0, 101), (2, 102)}
    bm = {(r.query_id, r.chunk_id): r.pos for r in queries.r1_bm25(spark, d).collect()}
    assert (0, 100) not in bm and (0, 101) not in bm
    ranked = {(r.query_id, r.chunk_id): r for r in queries.QUERIES["r4_keyword_rank"](spark, d).collect()}
    assert set(ranked) == set(bm) | set(want)
    # a question's order: the place in the first arm, or 0.8 times that in the second, if this is less
    for q in items:
        second = {c: k for k, c in enumerate(sorted((c for x, c in want if x == q), key=lambda c: (-want[q, c], c)))}
        chunks = [c for x, c in ranked if x == q]
        key = lambda c: (min(bm.get((q, c), 1e9), 0.8 * second.get(c, 1e9)), bm.get((q, c), 1e9), second.get(c, 0))  # noqa: B023, E731
        assert [c for c in sorted(chunks, key=lambda c: ranked[q, c].pos)] == sorted(chunks, key=key)  # noqa: B023
    assert abs(ranked[0, 101].raw - want[0, 101]) < 1e-6
    assert ranked[0, 100].pos == 1
    for name in ("r5_rrf_fuse", "r6_source_weights", "r7_retrieve"):
        assert (0, 100) in {(r.query_id, r.chunk_id) for r in queries.QUERIES[name](spark, d).collect()}, name
    assert (0, "Document 100") in {(r.query_id, r.label) for r in queries.r10_search_passages(spark, d).collect()}


def test_whole_questions(spark, place):
    d, docs, items = place
    want = plain_strict(docs, items)
    assert {(r.query_id, r.chunk_id) for r in queries.r2_all_terms(spark, d).collect()} == set(want)
    assert {(r.query_id, r.chunk_id): round(r.raw, 9) for r in queries.r2_cover_density(spark, d).collect()} == {k: round(v, 9) for k, v in want.items()}


def test_all_languages_and_bytes(spark, tmp_path):
    rows = [(1, "the that", "en"), (2, "OF for, caf\u00e9 of  FOR", "en"), (3, "the that und in this", "de"), (4, None, "fr"), (5, "rien", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    mentions = {}
    for i, text, _ in rows:
        for a, b in re.findall(queries.PAIR, text or ""):
            key = (i, f"{a.capitalize()} {b}")
            mentions[key] = mentions.get(key, 0) + 1
    assert {(r.source, r.cohort): r.n for r in queries.f6_pattern_mentions(spark, d).collect()} == mentions and {i for i, _ in mentions} == {1, 2, 3}
    assert tuple(queries.f7_audit_cohorts(spark, d).first()) == ("Of FOR|Of for|The that", True)
    assert {1, 2, 3, 5} >= {r.chunk_id for r in queries.i2_english_lexemes(spark, d).collect()} >= {3, 5}


def test_uploads_of_a_table_in_a_folder_of_parts(spark, tmp_path):
    """A table may be a file or a folder of files."""
    rows = spark.createDataFrame([(i, f"some words of number {i} " * 20) for i in range(8)], "doc_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["x1_stream_uploads"](spark, str(tmp_path)).collect()
    assert len(got) == 8 and {r.status for r in got} <= {"live", "failed"} and any(r.status == "live" and r.embedded == 1 for r in got)
