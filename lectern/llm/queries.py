"""The registered queries ``opN_<name>`` of this subpackage, thin over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, hard_negatives, language_id, line_chunks, matroska, minhash, mixing, quality, quotes, simhash, suffix_tree, token_alignment, token_ids
from lectern.llm.common import table


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(table(spark, sf_dir, "documents"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_digests(table(spark, sf_dir, "documents"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_held_out(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_held_out(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hit_digests(decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.digests(quotes.conversations(table(spark, sf_dir, "conversations")))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.digests(line_chunks.drop_repeated_chunks(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digests(minhash.near_duplicates(table(spark, sf_dir, "documents")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digests(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=hard_negatives.moved_label())


QUERIES = {f.__name__: f for f in (
    op1_matroska, op2_token_ids, op3_suffix_tree, op4_language_id, op5_decontaminate, op6_pivotal_mix, op7_quotation_links, op8_line_chunks, op9_simhash, op10_line_quality, op11_minhash, op12_token_alignment, op13_hard_negatives,
)}

ORACLES: dict[str, str] = {
    "op5_decontaminate": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, least(10, len(w)) AS k, w FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark)
        ), windows AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS x FROM b WHERE k > 0),
        places AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d JOIN (SELECT DISTINCT k FROM windows) ON len(w) >= k),
        hits AS (SELECT r, p.k, i, item_id FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS x FROM places) p JOIN windows v ON v.k = p.k AND v.x = p.x),
        covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hits) GROUP BY r),
        items AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS said FROM hits GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""",
    "op11_minhash": """
        WITH RECURSIVE said AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
            FROM said
        ), classes AS (
            SELECT row_number() OVER () AS c, list_sort(s) AS s, len(s) AS n, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
        ), items AS (SELECT c, n, unnest(s) AS x FROM classes),
        ranked AS (
            SELECT c, n, x, row_number() OVER (PARTITION BY c ORDER BY often, x) AS place
            FROM (SELECT c, n, x, count(*) OVER (PARTITION BY x) AS often FROM items)
        ), prefix AS (SELECT c, n, x FROM ranked WHERE place <= n - (85 * n + 99) // 100 + 1),
        met AS (SELECT DISTINCT a.c AS a, b.c AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
        shared AS (SELECT a, b, count(*) AS k FROM met JOIN items i ON i.c = a JOIN items j ON j.c = b AND j.x = i.x GROUP BY a, b),
        links AS (SELECT a, b FROM shared JOIN classes p ON p.c = a JOIN classes q ON q.c = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
        roots AS (SELECT reach.a AS c, min(q.least) AS component_id FROM reach JOIN classes q ON q.c = reach.b GROUP BY reach.a)
        SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
        FROM sets LEFT JOIN classes ON classes.s = list_sort(sets.s) LEFT JOIN roots USING (c)""",
    "op13_hard_negatives": """
        WITH rows AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
            FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
        ), positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3""",
}
