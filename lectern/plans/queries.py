"""The registered queries of the reference's operators, each with its SQL where SQL can say it.

The driver's tables stand in for the corpus: ``documents`` for documents and
chunks, ``benchmark`` for questions, ``conversations`` for answers and turns,
``events`` for every kind of event log, ``labels`` for the exclusion list.
"""

from __future__ import annotations

import html
import io
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.functions.analysis import pieces
from lectern.functions.english import english_lexemes
from lectern.operators import chunking, corpus, dedup, folds, grounding, index, pages, retrieval, segments
from lectern.plans import sql
from lectern.sources import files
from lectern.sources.staging import shared_folder, spread, staged
from lectern.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def doc_index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return index.build_index(table(spark, sf_dir, "documents"), id_col="doc_id")


# -- text ---------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, md5({sql.trim_all("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(160), ' ', 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS m FROM documents""")
def t2_normalize_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.text_md5(t.normalize_whitespace("text", letters=False)).alias("m"))


@query(f"SELECT doc_id, md5({sql.collapsed('text')}) AS m FROM documents")
def t1_collapse_letter_spacing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.text_md5(t.collapse_letter_spacing("text")).alias("m"))


@query(f"""SELECT doc_id, count(*) AS pages, md5(string_agg(n || ':' || {sql.normalized(sql.collapsed('x'))}, '|' ORDER BY n)) AS m FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE {sql.trim_all('x')} <> '' GROUP BY doc_id""")
def t4_segments_from_pages(spark, sf_dir):
    """Each line a page: numbers and texts of the pages that are not blank."""
    # a row of a generator: the filter would make the segments again
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(pages.segments_from_pages(F.translate("text", "\n", "\f")))).alias("s"))
    said = F.array_join(F.transform("s", lambda x: F.concat(x["ordinal"].cast("string"), F.lit(":"), t.trim_all(x["text"]))), "|")
    return docs.where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("pages"), t.text_md5(said).alias("m"))


@query("""SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(lower(url), '\\.[a-z0-9]+$', ''), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80) AS slug FROM pages""")
def t10_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.slug("url").alias("slug"))


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '[^{sql.SPACE}]+')) AS words FROM documents""")
def t11_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.word_count("text").cast("long").alias("words"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS m FROM documents")
def t12_content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.content_sha256("text").alias("sha"), t.text_md5("text").alias("m"))


@query("""SELECT page_id, CASE WHEN regexp_matches(p, '(?i)module[ \\t_]*?[0-9]') THEN 'Module ' || regexp_extract(p, '(?i)module[ \\t_]*?([0-9])', 1) END AS module FROM (SELECT page_id, replace(url, '/en/', '/Module_') AS p FROM pages)""")
def t13_module_of(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.module_of(F.replace("url", F.lit("/en/"), F.lit("/Module_"))).alias("module"))


@query(f"""SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[{sql.SPACE}]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' ') AS k FROM benchmark""")
def t14_normalize_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", t.normalize_query("text").alias("k"))


@query()
def t7_html_to_text(spark, sf_dir):
    return pages.html_to_text(table(spark, sf_dir, "pages")).select("page_id", "title", "text")


@query("""WITH l AS (SELECT doc_id, source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
n AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
c AS (SELECT source, line FROM l JOIN n USING (source) GROUP BY source, line, total HAVING count(*) >= greatest(2, ceil(total * 0.05)) AND length(line) < 120),
g AS (SELECT source, list(line) AS gone FROM c GROUP BY source)
SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(gone, []), x)), chr(10))) AS m FROM documents LEFT JOIN g USING (source)""")
def t9_strip_boilerplate(spark, sf_dir):
    docs = pages.strip_shared_boilerplate(table(spark, sf_dir, "documents"), "source", share=0.05)
    return docs.select("doc_id", t.text_md5("text").alias("m"))


@query()
def t9_page_boilerplate(spark, sf_dir):
    site = F.regexp_extract("url", "://([^/]+)", 1)
    text = pages.html_to_text(table(spark, sf_dir, "pages")).withColumn("site", site)
    return pages.strip_shared_boilerplate(text, "site").select("page_id", "site", "title", "text")


# -- policy -------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT page_id, url, md5(html) AS h, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages),
e AS (SELECT *, CASE WHEN host IN (SELECT min(host) FROM f) THEN 'excluded_archive' WHEN regexp_matches(url, '(?i)page=3') THEN 'confidential' END AS early FROM f),
d AS (SELECT *, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id) AS first_id FROM e WHERE early IS NULL)
SELECT page_id, early AS disposition FROM e WHERE early IS NOT NULL UNION ALL SELECT page_id, CASE WHEN page_id <> first_id THEN 'exact_duplicate' WHEN page_id % 2 = 0 THEN 'full_text' ELSE 'catalog' END FROM d""")
def f1_source_policy(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    files = p.select("page_id", F.lit(0).alias("stage"), F.col("page_id").alias("archive_no"), F.regexp_extract("url", "://([^/]+)", 1).alias("archive"), "url", t.text_md5("html").alias("sha256"))
    files = files.withColumn("path", F.concat(F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit(" "), "url"))
    allow = files.where("page_id % 2 = 0").select("path")
    out = files.agg(F.min("archive").alias("archive")).withColumn("why", F.lit("left out"))
    return corpus.apply_source_policy(files, allow, out, ["page=3"]).select("page_id", "disposition")


@query("""SELECT page_id, regexp_matches(url, '(?i)(?:ref=x)|(?:/fr/)') AS confidential FROM pages""")
def f2_drop_confidential(spark, sf_dir):
    kept, gone = corpus.drop_confidential(table(spark, sf_dir, "pages"), ["ref=x", "/fr/"], "url")
    return kept.select("page_id", F.lit(False).alias("confidential")).unionByName(gone.select("page_id", F.lit(True).alias("confidential")))


@query("""SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def f3_drop_excluded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept, _ = corpus.drop_excluded(docs, docs, table(spark, sf_dir, "labels").where("toxic = 1"))
    return kept.select("doc_id", "n_chars")


@query("""WITH c AS (SELECT user_id AS doc_id, arg_max(event_type, event_id) AS last FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id),
o AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT doc_id FROM c WHERE last = 'error' UNION SELECT doc_id FROM o WHERE doc_id NOT IN (SELECT doc_id FROM c)""")
def f4_fold_exclusions(spark, sf_dir):
    old = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(None).cast("string").alias("title"), F.lit("toxic").alias("reason")).distinct()
    ev = table(spark, sf_dir, "events").where("event_type in ('error', 'signup')")
    commands = ev.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "exclude").otherwise("restore").alias("action"), F.lit(None).cast("string").alias("title"), F.lit("command").alias("reason"))
    return corpus.fold_exclusions(old, commands).select("doc_id")


RISKS = [("money", r"(?i)\$[0-9,]+", "figures"), ("license", r"(?i)\b(licensed|public license|copyright)\b", "license text"), ("mail", r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", "addresses")]


@query("\nUNION ALL\n".join(f"SELECT doc_id, '{label}' AS label, len(list_distinct(regexp_extract_all(text, '{p}')))::int AS n_hits FROM documents WHERE regexp_matches(text, '{p}')" for label, p, _ in RISKS))
def f5_document_risks(spark, sf_dir):
    rules = spark.createDataFrame(RISKS, "label string, pattern string, why string")
    return grounding.scan_document_risks(table(spark, sf_dir, "documents"), rules).select("doc_id", "label", "n_hits")


#: Word borders and case as SQL's patterns know them: ASCII.
PAIR = r"(?ai)\b(the|of|in|and)[ ]+(that|this|for|with)\b"
PAIR_SQL = "(?i)\\b(the|of|in|and)[ ]+(that|this|for|with)\\b"


@query(f"""SELECT doc_id AS source, upper(a[1]) || lower(a[2:]) || ' ' || b AS cohort, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{PAIR_SQL}', 1)) AS a, unnest(regexp_extract_all(text, '{PAIR_SQL}', 2)) AS b FROM documents) GROUP BY ALL""")
def f6_pattern_mentions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("source", F.col("doc_id"))
    return grounding.find_cohort_mentions(docs, PAIR).groupBy("source", "cohort").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT DISTINCT upper(a[1]) || lower(a[2:]) || ' ' || b AS c FROM (SELECT unnest(regexp_extract_all(text, '(?i)\\b(the|of)[ ]+(that|for)\\b', 1)) AS a, unnest(regexp_extract_all(text, '(?i)\\b(the|of)[ ]+(that|for)\\b', 2)) AS b FROM documents))
SELECT array_to_string(list_sort(list(c)), '|') AS labels, count(*) > 1 AS conflict FROM m""")
def f7_audit_cohorts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("source", F.col("doc_id"))
    return grounding.audit_cohorts(grounding.find_cohort_mentions(docs, r"(?ai)\b(the|of)[ ]+(that|for)\b")).select(F.array_join("labels", "|").alias("labels"), "conflict")


# -- dedup --------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id <> f THEN 'duplicate content of ' || f END AS reason FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS f FROM documents)""")
def d1_exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("sha256", t.text_md5("text")).withColumn("label", F.col("doc_id").cast("string"))
    kept, gone = dedup.drop_exact_duplicates(docs, "sha256", ["doc_id"], "label")
    return kept.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(gone.select("doc_id", "reason"))


@query(f"""SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS m FROM (SELECT doc_id, {sql.shingles('text')} AS s FROM documents)""")
def d2_shingles(spark, sf_dir):
    s = t.shingles("text")
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join(F.sort_array("s"), "|").cast("binary")).alias("m"))


SIMILAR_SQL = f"""s0 AS (SELECT doc_id, {sql.shingles('text')} AS s FROM documents), c AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY list_sort(s)) AS cls FROM s0 WHERE len(s) > 0),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS w FROM c WHERE doc_id = cls),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b USING (w) WHERE a.doc_id < b.doc_id GROUP BY ALL),
alike AS (SELECT a, b, c / (na + nb - c) AS similarity FROM p WHERE c / (na + nb - c) >= 0.6)"""


@query(f"WITH {SIMILAR_SQL} SELECT a, b, round(similarity, 6) AS similarity FROM alike UNION ALL SELECT cls, doc_id, 1.0 FROM c WHERE doc_id <> cls")
def d3_jaccard_pairs(spark, sf_dir):
    return dedup.jaccard_pairs(table(spark, sf_dir, "documents"), key="doc_id").select("a", "b", F.round("similarity", 6).alias("similarity"))


#: The greedy rule as a recursion over the places of the first rows of classes: each step settles the next row by the kept ones before it.
GREEDY_SQL = f"""WITH RECURSIVE {SIMILAR_SQL},
f AS (SELECT cls, arg_min(c.doc_id, (-length(text), c.doc_id)) AS fid, max(length(text)) AS l FROM c JOIN documents d ON d.doc_id = c.doc_id GROUP BY cls),
o AS (SELECT cls, fid, row_number() OVER (ORDER BY l DESC, fid) AS n FROM f WHERE cls IN (SELECT a FROM alike UNION SELECT b FROM alike)),
e AS MATERIALIZED (SELECT least(x.n, y.n) AS p, greatest(x.n, y.n) AS q, similarity FROM alike JOIN o x ON x.cls = a JOIN o y ON y.cls = b),
w AS (SELECT 0 AS n, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT w.n + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.q = w.n + 1 AND list_contains(w.kept, e.p)) THEN kept ELSE list_append(kept, w.n + 1) END FROM w WHERE w.n < (SELECT count(*) FROM o)),
k AS (SELECT unnest(kept) AS n FROM (SELECT kept FROM w ORDER BY n DESC LIMIT 1)),
m AS (SELECT q, min(p) AS p, arg_min(similarity, p) AS similarity FROM e WHERE p IN (SELECT n FROM k) AND q NOT IN (SELECT n FROM k) GROUP BY q)
SELECT coalesce(z.fid, f.fid) AS kept, c.doc_id AS dropped, round(coalesce(m.similarity, 1.0), 3) AS similarity FROM c JOIN f USING (cls) LEFT JOIN o ON o.cls = c.cls LEFT JOIN m ON m.q = o.n LEFT JOIN o z ON z.n = m.p WHERE m.q IS NOT NULL OR c.doc_id <> f.fid"""


@query(GREEDY_SQL)
def d4_near_duplicates(spark, sf_dir):
    _, dupes = dedup.drop_near_duplicates(table(spark, sf_dir, "documents").withColumn("key", F.col("doc_id")))
    return dupes


#: The same over the readable first copies, and what became of the others.
DRAFTS_SQL = f"""{GREEDY_SQL.replace("FROM documents)", "FROM live)").replace("JOIN documents d", "JOIN live d").replace("WITH RECURSIVE", "WITH RECURSIVE every AS (SELECT *, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id FROM documents WHERE doc_id % 11 <> 0), live AS (SELECT doc_id, text FROM every WHERE doc_id = first_id AND doc_id % 13 <> 0),").replace("SELECT coalesce(z.fid", ", drafts AS (SELECT coalesce(z.fid")})
SELECT doc_id, 'confidential' AS disposition, 'confidential' AS reason FROM documents WHERE doc_id % 11 = 0
UNION ALL SELECT doc_id, 'exact_duplicate', 'duplicate content of drafts.zip:' || lpad(first_id::varchar, 12, '0') FROM every WHERE doc_id <> first_id
UNION ALL SELECT doc_id, 'extraction_failed', 'extraction failed: broken' FROM every WHERE doc_id = first_id AND doc_id % 13 = 0
UNION ALL SELECT doc_id, CASE WHEN dropped IS NULL THEN 'full_text' ELSE 'near_duplicate' END, 'near-duplicate draft of "' || lpad(kept::varchar, 12, '0') || '" (jaccard ' || regexp_replace(similarity::double::varchar, '[.]0$', '') || ')' FROM live LEFT JOIN drafts ON dropped = doc_id"""


@query(DRAFTS_SQL)
def f1_draft_policy(spark, sf_dir):
    """The rules of archives that hold drafts: every document a file of one archive."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.when(F.col("doc_id") % 11 == 0, "secret ").otherwise(""), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    rows = docs.select("doc_id", F.lit("drafts.zip").alias("archive"), F.lit(0).alias("archive_no"), path.alias("path"), t.text_md5("text").alias("sha256"), "text", F.when(F.col("doc_id") % 13 == 0, "broken").alias("error"))
    return corpus.apply_draft_policy(rows, ["secret"]).select("doc_id", "disposition", "reason")


@query("""WITH e AS (SELECT md5(text) AS h FROM documents WHERE doc_id % 7 = 0), u AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS n FROM u WHERE h NOT IN (SELECT h FROM e)) WHERE n = 1""")
def d5_duplicate_uploads(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("id"), F.col("doc_id").alias("created_at"), t.text_md5("text").alias("sha256"))
    fresh, _ = dedup.drop_duplicate_uploads(docs.where("doc_id % 7 <> 0"), docs.where("doc_id % 7 = 0").withColumn("status", F.lit("live")))
    return fresh.select("doc_id")


# -- chunks and catalogs ------------------------------------------------------------------------------------------


def doc_chunks(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), chunking.flat_segments("text").alias("segments"))
    return chunking.chunk_documents(docs)


@query(f"""SELECT doc_id, line_no, line AS heading FROM (SELECT doc_id, CASE WHEN line_no % 3 = 1 THEN upper(line) ELSE line END AS line, line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents))
WHERE length({sql.trim_all('line')}) BETWEEN 3 AND 90 AND NOT regexp_matches({sql.trim_all('line')}, '[.!?]$') AND length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 3 AND regexp_replace(line, '[^A-Za-z]', '', 'g') = upper(regexp_replace(line, '[^A-Za-z]', '', 'g'))""")
def c1_headings(spark, sf_dir):
    """Every third line stands in capitals."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    lines = lines.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.when(F.col("p") % 3 == 0, t.upper_one_to_one("line")).otherwise(F.col("line")).alias("heading"))
    return lines.where(t.is_heading("heading"))


@query()
def c4_chunk_documents(spark, sf_dir):
    return doc_chunks(spark, sf_dir)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN a = b THEN 'p.' || a ELSE 'pp. ' || a || '–' || b END AS locator FROM (SELECT l_orderkey, l_linenumber, l_linenumber AS a, l_linenumber + l_linenumber % 3 AS b FROM lineitem)""")
def c5_locators(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + F.col("l_linenumber") % 3).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", t.format_locator(F.lit("p."), "a", "b").alias("locator"))


@query(f"SELECT doc_id, {sql.purpose('text')} AS purpose FROM documents")
def c6_catalog_purpose(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.catalog_purpose("text").alias("purpose"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '(?i)\\.[a-z0-9]+$', ''), '_+', ' ', 'g') AS title FROM pages""")
def c7_catalog_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", chunking.catalog_title("url").alias("title"))


@query("""WITH e AS (SELECT source AS module, lpad(doc_id::varchar, 9, '0') AS name, lang FROM documents),
g AS (SELECT module, count(*) AS n, string_agg('- ' || name || ' — ' || module || ' — ' || lang, chr(10) ORDER BY name) AS lines FROM e GROUP BY module)
SELECT module, md5(module || ' — worksheet and template catalog' || chr(10) || chr(10) || 'The following ' || n || ' fill-in worksheets are provided to participants in ' || module || '.' || chr(10) || chr(10) || lines) AS m FROM g""")
def c9_render_catalog(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select(F.col("source").alias("module"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.col("lang").alias("purpose"))
    return chunking.render_catalog(e).select("module", t.text_md5("text").alias("m"))


@query()
def c10_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", t.word_count("text").alias("words"), t.content_sha256("text").alias("sha256"))
    return chunking.build_manifest(docs, doc_chunks(spark, sf_dir))[0]


# -- index --------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS m FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents)""")
def i1_tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.tokenize("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("m"))


@query()
def i2_english_lexemes(spark, sf_dir):
    return index.chunk_terms(table(spark, sf_dir, "documents"), english_lexemes, id_col="doc_id").select("chunk_id", "word", "tf")


@query(f"WITH {sql.INDEX} SELECT chunk_id, word, tf::int AS tf FROM terms")
def i3_chunk_terms(spark, sf_dir):
    return doc_index(spark, sf_dir)["terms"].select("chunk_id", "word", "tf")


@query(f"WITH {sql.INDEX} SELECT chunk_id, token_count::int AS token_count FROM lens")
def i4_token_count(spark, sf_dir):
    return index.token_count(table(spark, sf_dir, "documents"), id_col="doc_id")


@query(f"WITH {sql.INDEX} SELECT word, ndoc FROM lexemes")
def i5_lexeme_stats(spark, sf_dir):
    return doc_index(spark, sf_dir)["lexemes"]


@query(f"WITH {sql.INDEX} SELECT count(*) AS chunk_count, round(avg(token_count), 6) AS avg_len FROM lens")
def i6_corpus_stats(spark, sf_dir):
    return doc_index(spark, sf_dir)["stats"].select("chunk_count", F.round("avg_len", 6).alias("avg_len"))


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' refreshed wording' ELSE text END AS text FROM documents),
w AS (SELECT DISTINCT doc_id, unnest({sql.tokens('text')}) AS word FROM d) SELECT word, count(*) AS ndoc FROM w GROUP BY word""")
def i7_refresh_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id"))
    old = index.build_index(docs)
    changed = docs.where("doc_id % 10 = 3").withColumn("text", F.concat("text", F.lit(" refreshed wording")))
    new = index.refresh_stats(old["terms"], old["lexemes"], index.token_count(docs), changed, changed.select(F.col("id").alias("chunk_id")))
    return new["lexemes"]


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN text || ' edited again' WHEN doc_id % 10 = 3 THEN text || ' refreshed wording' ELSE text END AS text FROM documents),
w AS (SELECT DISTINCT doc_id, unnest({sql.tokens('text')}) AS word FROM d) SELECT word, count(*) AS ndoc FROM w GROUP BY word""")
def i7_segments(spark, sf_dir):
    """A segment of all documents, edits in segments of their own, and these compacted."""
    docs, root = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", "text"), _place(spark, "segments")
    segments.write_segment(docs, root)
    for keep, more in (("doc_id % 10 = 3", " refreshed wording"), ("doc_id % 7 = 1", " edited again")):
        segments.write_segment(docs.where(keep).withColumn("text", F.concat("text", F.lit(more))), root)
    segments.compact(spark, root, tier=2)
    return segments.read_segments(spark, root)["lexemes"]


@query("""SELECT source AS source_type, count(*) AS docs, sum(n_chars)::bigint AS chunks, sum(len(regexp_extract_all(text, '[^ \\n]+')))::bigint AS words FROM documents GROUP BY ROLLUP (source)""")
def i8_corpus_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("source_type"), F.col("n_chars").alias("chunk_count"), t.word_count("text").cast("long").alias("words"))
    return index.corpus_report(d)


@query("""WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS f FROM documents) SELECT CASE WHEN doc_id <> f THEN 'duplicate content' ELSE 'short' END AS reason, count(*) AS n FROM d WHERE doc_id <> f OR doc_id % 5 = 0 GROUP BY 1""")
def i9_skip_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("sha256", t.text_md5("text")).withColumn("label", F.col("doc_id").cast("string"))
    kept, gone = dedup.drop_exact_duplicates(docs, "sha256", ["doc_id"], "label")
    return index.skip_report(gone.select("reason").unionByName(kept.where("doc_id % 5 = 0").select(F.lit("short").alias("reason"))))


@query("""SELECT d.doc_id, count(e.vec_id) AS chunks, count(CASE WHEN e.label % 2 = 0 THEN 1 END) AS embedded FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id % 400 GROUP BY d.doc_id""")
def i10_inventory(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 400).alias("doc_id"), F.when(F.col("label") % 2 == 0, F.col("embedding")).alias("embedding"))
    return index.index_inventory(table(spark, sf_dir, "documents"), chunks)


@query("""SELECT (SELECT count(*) FROM events) AS documents, count(*) AS chunks, count(CASE WHEN label % 2 = 0 THEN 1 END) AS embedded, (SELECT max(ts) FROM events) AS last_ingest, 'hybrid' AS mode, true AS ok FROM embeddings""")
def i11_health(spark, sf_dir):
    docs = table(spark, sf_dir, "events").select(F.col("ts").alias("ingested_at"))
    return index.index_health(docs, table(spark, sf_dir, "embeddings").select(F.when(F.col("label") % 2 == 0, F.col("embedding")).alias("embedding")))


# -- embeddings ---------------------------------------------------------------------------------------------------


def vectors(spark, sf_dir) -> DataFrame:
    docs, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return docs.join(e, docs["doc_id"] == e["vec_id"]).select(F.col("doc_id").alias("id"), "text", "embedding")


@query("""SELECT d.doc_id AS id, e.vec_id IS NOT NULL AND d.doc_id % 3 <> 0 AS carried FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")
def e1_carry_embeddings(spark, sf_dir):
    new = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return corpus.carry_embeddings(vectors(spark, sf_dir), new).select("id", F.col("embedding").isNotNull().alias("carried"))


@query("""SELECT doc_id AS id, ceil((length(text) + length(source) + 2) / 4)::int AS tokens FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def e2_pending_embeddings(spark, sf_dir):
    chunks = corpus.carry_embeddings(vectors(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("heading")))
    return corpus.pending_embeddings(chunks).select("id", "tokens")


@query("""WITH RECURSIVE t AS (SELECT doc_id AS id, ceil(length(text) / 4)::int AS tokens FROM documents),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id, tokens) AS n FROM t),
r AS (SELECT 0::bigint AS n, -1::bigint AS batch, 8001::bigint AS filled UNION ALL
SELECT o.n, r.batch + CASE WHEN r.filled + o.tokens > 8000 THEN 1 ELSE 0 END, CASE WHEN r.filled + o.tokens > 8000 THEN o.tokens ELSE r.filled + o.tokens END FROM r JOIN o ON o.n = r.n + 1)
SELECT id, tokens, batch FROM o JOIN r USING (n)""")
def e4_token_batches(spark, sf_dir):
    pending = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), t.estimate_tokens("text").alias("tokens"))
    return chunking.token_batches(pending)


# -- retrieval ----------------------------------------------------------------------------------------------------


@query(f"WITH {sql.BM25} SELECT query_id, chunk_id, round(raw, 6) AS raw, pos::int AS pos FROM bm")
def r1_bm25(spark, sf_dir):
    return retrieval.bm25(questions(spark, sf_dir), doc_index(spark, sf_dir)).select("query_id", "chunk_id", F.round("raw", 6).alias("raw"), "pos")


@query(f"WITH {sql.BM25} SELECT query_id, chunk_id, round(raw, 6) AS raw, pos::int AS pos FROM bm")
def r1_bm25_by_blocks(spark, sf_dir):
    """The same rows, from blocks of postings with bounds."""
    built = doc_index(spark, sf_dir)
    return retrieval.bm25_by_blocks(questions(spark, sf_dir), built, index.impact_blocks(built)).select("query_id", "chunk_id", F.round("raw", 6).alias("raw"), "pos")


@query(f"""WITH tok AS (SELECT doc_id AS chunk_id, {sql.tokens('text')} AS t FROM documents), {sql.STRICT} SELECT DISTINCT query_id, chunk_id FROM cover""")
def r2_all_terms(spark, sf_dir):
    return strict_arm(spark, sf_dir, limit=1 << 30).select("query_id", "chunk_id")


@query(f"""WITH tok AS (SELECT doc_id AS chunk_id, {sql.tokens('text')} AS t FROM documents), {sql.STRICT} SELECT query_id, chunk_id, round(raw, 9) AS raw, pos::int AS pos FROM strict_arm""")
def r2_cover_density(spark, sf_dir):
    return strict_arm(spark, sf_dir).select("query_id", "chunk_id", F.round("raw", 9).alias("raw"), "pos")


def strict_arm(spark, sf_dir, limit: int = retrieval.PER_ARM) -> DataFrame:
    """The chunks with all terms of the benchmark's questions."""
    return retrieval.all_terms_match(questions(spark, sf_dir), doc_index(spark, sf_dir), limit=limit)


@query(f"WITH {sql.cosine('vec_id % 50 = 0')} SELECT query_id, chunk_id, round(raw, 5) AS raw FROM sem")
def r3_cosine_top_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.cosine_top_k(e.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), e).select("query_id", "chunk_id", F.round("raw", 5).alias("raw"))


@query(f"WITH {sql.cosine('vec_id % 50 = 0')} SELECT query_id, chunk_id, round(raw, 5) AS raw FROM sem")
def r3_vector_index(spark, sf_dir):
    """The same rows from inverted lists, by their bounds."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    found = retrieval.vector_index_top_k(e.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), retrieval.build_vector_index(e))
    return found.select("query_id", "chunk_id", F.round("raw", 5).alias("raw"))


def semantic_arm(spark, sf_dir) -> DataFrame:
    """Of the benchmark's questions: the vector of a question's id is its own."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.cosine_top_k(e.withColumnRenamed("chunk_id", "query_id").join(questions(spark, sf_dir).select("query_id"), "query_id", "left_semi"), e)


KEYWORD_SQL = f"""WITH {sql.BM25}, {sql.STRICT},
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.pos AS p1, a.raw AS r1, b.pos * 0.8 AS p2, b.pos AS q2, b.raw AS r2 FROM bm a FULL JOIN strict_arm b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
k AS (SELECT query_id, chunk_id, CASE WHEN p2 IS NOT NULL AND (p1 IS NULL OR p2 < p1) THEN p2 ELSE p1 END AS rank, CASE WHEN p2 IS NULL THEN r1 WHEN p1 IS NULL OR p2 < p1 THEN r2 ELSE greatest(r1, r2) END AS raw, coalesce(p1, q2 + 1073741824) AS met FROM j),
kw AS (SELECT query_id, chunk_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY rank, met) - 1 AS pos FROM k)"""


def keyword_arm(spark, sf_dir) -> DataFrame:
    """BM25 and all terms of the benchmark's questions as one vote."""
    return retrieval.lexical(questions(spark, sf_dir), doc_index(spark, sf_dir))


@query(f"{KEYWORD_SQL} SELECT query_id, chunk_id, pos::int AS pos, round(raw, 6) AS raw FROM kw")
def r4_keyword_rank(spark, sf_dir):
    return keyword_arm(spark, sf_dir).select("query_id", "chunk_id", "pos", F.round("raw", 6).alias("raw"))


FUSED_SQL = f"""{KEYWORD_SQL}, {sql.cosine('vec_id IN (SELECT item_id FROM benchmark)')}, u AS (SELECT query_id, chunk_id, pos, raw, 1 AS kw FROM kw UNION ALL SELECT query_id, chunk_id, pos, raw, 0 FROM sem),
f AS (SELECT query_id, chunk_id, sum(1 / (60 + pos + 1)) AS score, greatest(0, coalesce(max(CASE WHEN kw = 1 THEN raw END), 0)) AS lex_score, greatest(0, coalesce(max(CASE WHEN kw = 0 THEN raw END), 0)) AS sem_score, string_agg(CASE WHEN kw = 1 THEN 'keyword' ELSE 'semantic' END, '+' ORDER BY kw DESC) AS arms FROM u GROUP BY ALL)"""


def fused(spark, sf_dir) -> DataFrame:
    return retrieval.rrf_fuse(keyword_arm(spark, sf_dir), semantic_arm(spark, sf_dir))


@query(f"{FUSED_SQL} SELECT query_id, chunk_id, round(score, 8) AS score, round(lex_score, 5) AS lex_score, round(sem_score, 5) AS sem_score, arms FROM f")
def r5_rrf_fuse(spark, sf_dir):
    return fused(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 8).alias("score"), F.round("lex_score", 5).alias("lex_score"), F.round("sem_score", 5).alias("sem_score"), F.array_join("arms", "+").alias("arms"))


WEIGHTS = {"src0": 1.3, "src1": 1.1, "src2": 0.92}
HITS_SQL = f"""{FUSED_SQL}, w AS (SELECT query_id, chunk_id, score * CASE source WHEN 'src0' THEN 1.3 WHEN 'src1' THEN 1.1 WHEN 'src2' THEN 0.92 ELSE 1 END * CASE WHEN chunk_id IN (3, 50) THEN 1.12 ELSE 1 END AS score, lex_score, sem_score, source, text FROM f JOIN documents ON doc_id = chunk_id),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM w) WHERE rank < 8)"""


def hits(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), "doc_id", "text", F.lit(None).cast("string").alias("heading"), F.lit(None).cast("string").alias("locator"))
    documents = docs.select("doc_id", F.col("source").alias("source_type"), F.concat(F.lit("Document "), "doc_id").alias("source_label"))
    return retrieval.fuse_hits(keyword_arm(spark, sf_dir), semantic_arm(spark, sf_dir), chunks, documents, WEIGHTS, [3, 50])


@query(f"{HITS_SQL} SELECT query_id, chunk_id, rank::int AS rank, round(score, 8) AS score, length(text) AS n FROM h")
def r7_retrieve(spark, sf_dir):
    return hits(spark, sf_dir).select("query_id", "chunk_id", "rank", F.round("score", 8).alias("score"), F.length("text").cast("long").alias("n"))


@query()
def r7_retrieve_chunks(spark, sf_dir):
    """The one call over chunks: chunking, index, and the three arms of the same questions."""
    e = table(spark, sf_dir, "embeddings")
    chunks = doc_chunks(spark, sf_dir).select("id", "doc_id", "text", "heading", "locator")
    # the first chunk of a document has the vector of the document's number
    with_vectors = chunks.join(e.select(F.concat(F.col("vec_id").cast("string"), F.lit("#0")).alias("id"), "embedding"), "id", "left")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("source_type"), F.concat(F.lit("Document "), "doc_id").alias("source_label"))
    q = questions(spark, sf_dir)
    found = retrieval.retrieve(q, e.select(F.col("vec_id").alias("query_id"), "embedding"), index.build_index(chunks), with_vectors, documents, weights=WEIGHTS)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 8).alias("score"), F.array_join("arms", "+").alias("arms"))


@query(f"{FUSED_SQL} SELECT query_id, chunk_id, round(score * CASE source WHEN 'src0' THEN 1.3 WHEN 'src1' THEN 1.1 WHEN 'src2' THEN 0.92 ELSE 1 END, 8) AS score FROM f JOIN documents ON doc_id = chunk_id")
def r6_source_weights(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("source_type"))
    return retrieval.apply_source_weights(fused(spark, sf_dir).join(docs, "chunk_id"), WEIGHTS).select("query_id", "chunk_id", F.round("score", 8).alias("score"))


@query(f"{HITS_SQL} SELECT item_id AS query_id, coalesce(lex < 20 AND sem < 0.35, true) AS thin FROM benchmark LEFT JOIN (SELECT query_id, max(lex_score) AS lex, max(sem_score) AS sem FROM h GROUP BY query_id) ON item_id = query_id")
def r8_is_thin(spark, sf_dir):
    return retrieval.is_thin(questions(spark, sf_dir), hits(spark, sf_dir), min_lex=20.0)


@query(f"{HITS_SQL} SELECT query_id, md5(string_agg('Document ' || chunk_id || '#' || text, ' ' ORDER BY rank)) AS blocks FROM h GROUP BY query_id")
def r9_context_blocks(spark, sf_dir):
    b = retrieval.context_blocks(hits(spark, sf_dir))
    return b.select("query_id", t.text_md5(F.array_join(F.transform("blocks", lambda x: F.concat(x["title"], F.lit("#"), x["text"])), " ")).alias("blocks"))


@query(f"""{HITS_SQL}, asked AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9$]{{3,}}') AS w FROM benchmark), marks AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM asked)
SELECT query_id, rank::int AS rank, 'Document ' || chunk_id AS label, md5(list_reduce(list_prepend(text, w), lambda a, x: regexp_replace(a, '(?i)(' || replace(x, '$', '\\$') || ')', '[\\1]', 'g'))) AS m FROM h JOIN marks ON item_id = query_id WHERE rank < 5""")
def r10_search_passages(spark, sf_dir):
    return retrieval.search_passages(questions(spark, sf_dir), hits(spark, sf_dir)).select("query_id", "rank", "label", t.text_md5("passage").alias("m"))


@query(f"""{HITS_SQL}, b AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS body, arg_min(chunk_id, rank) AS top_chunk FROM h GROUP BY query_id)
SELECT item_id AS query_id, coalesce(contains(lower(body), lower(text)), false) AS passed, top_chunk FROM benchmark LEFT JOIN b ON item_id = query_id""")
def r11_evaluate(spark, sf_dir):
    cases = questions(spark, sf_dir).select("query_id", F.concat(F.lit("\\Q"), "text", F.lit("\\E")).alias("want"))
    return retrieval.evaluate_retrieval(cases, hits(spark, sf_dir))


@query(f"""{HITS_SQL}, b AS (SELECT item_id % 2 = 0 AS answerable, greatest(0, coalesce(max(lex_score), 0)) AS best FROM benchmark LEFT JOIN h ON item_id = query_id GROUP BY item_id)
SELECT answerable, round(min(best), 5) AS least, round(max(best), 5) AS greatest, count(*) AS n FROM b GROUP BY answerable""")
def r12_score_separation(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("answerable", F.col("query_id") % 2 == 0)
    return retrieval.score_separation(q, hits(spark, sf_dir))[1].select("answerable", F.round("least", 5).alias("least"), F.round("greatest", 5).alias("greatest"), "n")


# -- grounding ----------------------------------------------------------------------------------------------------


def small_talk_sql(x: str) -> str:
    s = sql.trim_all(x)
    # no lookbehind here: a capitalised word at the start or behind a sentence's end is lower-cased first
    rest = f"regexp_replace(regexp_replace({s}, '\\b(?:I''ll|I''m|I)\\b', '', 'g'), '(^|[.!?][{sql.SPACE}])[A-Z]', '\\1x', 'g')"
    claim, assertion = grounding.CLAIM.replace("'", "''"), grounding.ASSERTION.replace("'", "''")
    return f"CASE WHEN {s} = '' THEN true WHEN length({s}) > 180 THEN false WHEN regexp_matches({s}, '[0-9]|\\$|%') THEN false WHEN ends_with({s}, '?') THEN true WHEN regexp_matches({s}, '{assertion}') OR regexp_matches({s}, '{claim}') THEN false WHEN length({s}) > 90 THEN false ELSE NOT regexp_matches({rest}, '\\b[A-Z][a-z]{{2,}}') END"


LINES_SQL = "lines AS (SELECT conv_id * 1000 + turn AS response_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_idx FROM conversations WHERE role = 'assistant')"


def lines(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("response_id"), F.posexplode(F.split("text", "\n")).alias("block_idx", "text"))


@query(f"WITH {LINES_SQL} SELECT response_id, block_idx::int AS block_idx, {small_talk_sql('text')} AS ok FROM lines")
def g1_is_conversational(spark, sf_dir):
    return lines(spark, sf_dir).select("response_id", "block_idx", grounding.is_conversational("text").alias("ok"))


@query(f"WITH {LINES_SQL} SELECT response_id, block_idx::int AS block_idx, length(text) % 3 = 0 OR {small_talk_sql('text')} AS shown FROM lines")
def g2_should_show(spark, sf_dir):
    return lines(spark, sf_dir).select("response_id", "block_idx", grounding.should_show_block("text", F.length("text") % 3 == 0).alias("shown"))


def answer_blocks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every third length of line is cited, of documents whose number its length gives."""
    n = F.length("text")
    cite = F.array(F.struct((n % 5).cast("int").alias("document_index"), F.lit("a title").alias("document_title"), F.substring("text", 1, 10).alias("cited_text")), F.struct((n % 7).cast("int").alias("document_index"), F.lit("another").alias("document_title"), F.lit("q").alias("cited_text")))
    blocks = lines(spark, sf_dir).withColumn("citations", F.when(n % 3 == 0, cite).otherwise(F.array().cast("array<struct<document_index:int,document_title:string,cited_text:string>>")))
    idx = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("document_index")
    h = lines(spark, sf_dir).select("response_id").distinct().select("response_id", idx)
    chunk = F.concat(F.lit("c"), ((F.col("response_id") + F.col("document_index")) % 900).cast("string"))
    return blocks, h.select("response_id", F.col("document_index").cast("int").alias("document_index"), chunk.alias("id"), chunk.alias("doc_id"), F.concat(F.lit("Source "), chunk).alias("source_label"), F.when(F.col("document_index") % 2 == 0, "p.4").alias("locator"), F.lit("o").alias("origin"))


@query(f"""WITH {LINES_SQL}, b AS (SELECT *, length(text) % 3 = 0 AS cited, {small_talk_sql('text')} AS talk FROM lines),
c AS (SELECT response_id, block_idx, 0 AS pt, length(text) % 5 AS i, 'a title' AS ti FROM b WHERE cited UNION ALL SELECT response_id, block_idx, 1, length(text) % 7, 'another' FROM b WHERE cited),
k AS (SELECT response_id, min(block_idx * 2 + pt) AS o, i, arg_min(ti, block_idx * 2 + pt) AS ti FROM c GROUP BY response_id, i),
s AS (SELECT response_id, string_agg(CASE WHEN i > 5 THEN ti ELSE 'Source c' || ((response_id + i) % 900) || CASE WHEN i % 2 = 0 THEN ', p.4' ELSE '' END END, '|' ORDER BY o) AS sources FROM k GROUP BY response_id),
v AS (SELECT response_id, {sql.trim_all("string_agg(text, '' ORDER BY block_idx)")} AS text, bool_or(cited) AS anyc, bool_or(NOT cited AND NOT talk) AS open, sum(CASE WHEN cited THEN length(text) ELSE 0 END) AS nc FROM b GROUP BY response_id)
SELECT response_id, reason, reason = 'ok' AS grounded, CASE WHEN reason IN ('empty', 'no_citation') THEN '' ELSE coalesce(sources, '') END AS sources, round(CASE WHEN length(text) > 0 THEN nc / length(text) ELSE 0 END, 6) AS cited_ratio FROM (SELECT *, CASE WHEN text = '' THEN 'empty' WHEN NOT anyc AND open THEN 'no_citation' WHEN anyc AND open AND nc / length(text) < 0.2 THEN 'thinly_cited' ELSE 'ok' END AS reason FROM v) LEFT JOIN s USING (response_id)""")
def g3_enforce_grounding(spark, sf_dir):
    v = grounding.enforce_grounding(*answer_blocks(spark, sf_dir))
    return v.select("response_id", "reason", "grounded", F.array_join(F.transform("sources", lambda s: s["label"]), "|").alias("sources"), F.round("cited_ratio", 6).alias("cited_ratio"))


@query(f"""{HITS_SQL}, m AS (SELECT DISTINCT query_id, upper(a[1]) || lower(a[2:]) || ' ' || b AS c FROM (SELECT query_id, unnest(regexp_extract_all(text, '(?i)\\b(the|of|in|and)[ ]+(that|this|for|with)\\b', 1)) AS a, unnest(regexp_extract_all(text, '(?i)\\b(the|of|in|and)[ ]+(that|this|for|with)\\b', 2)) AS b FROM h)),
g AS (SELECT query_id, CASE WHEN count(*) > 1 THEN string_agg(c, '|' ORDER BY c) ELSE '' END AS labels FROM m GROUP BY query_id) SELECT query_id, coalesce(labels, '') AS labels FROM (SELECT DISTINCT query_id FROM h) LEFT JOIN g USING (query_id)""")
def g5_conflicts(spark, sf_dir):
    return grounding.detect_cohort_conflict(hits(spark, sf_dir), PAIR.replace("(?ai)", "(?i)")).select("query_id", F.array_join("labels", "|").alias("labels"))


@query("""WITH r AS (SELECT conv_id AS response_id, turn AS round, text, length(text) % 4 = 0 AS grounded, length(text) % 5 = 0 AS has_tools FROM conversations WHERE role <> 'system'),
w AS (SELECT *, coalesce(bool_or(grounded) OVER p, false) AS g, coalesce(bool_or(has_tools) OVER p, false) AS a FROM r WINDOW p AS (PARTITION BY response_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT response_id, round, CASE WHEN length(text) = 0 THEN 'nothing' WHEN grounded THEN 'shown' WHEN (g OR a OR has_tools) AND length(text) <= 320 THEN 'short_follow_up' WHEN g OR a OR has_tools THEN 'dropped_follow_up' ELSE 'escalate_no_citation' END AS disposition FROM w""")
def g6_dispositions(spark, sf_dir):
    n = F.length("text")
    r = table(spark, sf_dir, "conversations").where("role <> 'system'").select(F.col("conv_id").alias("response_id"), F.col("turn").alias("round"), "text", (n % 4 == 0).alias("grounded"), (n % 5 == 0).alias("has_tools"), F.lit(False).alias("thin"), F.lit(False).alias("refused"))
    return grounding.response_disposition(r).select("response_id", "round", "disposition")


@query("""SELECT conv_id, turn FROM conversations WHERE regexp_matches(text || CASE WHEN turn % 2 = 1 THEN ' Here''s a link' ELSE '' END, '(?i)\\b(here''?s? (?:a|the) link)\\b') AND conv_id % 2 = 0""")
def g7_missing_link(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.concat("text", F.lit(" Here's a link"))).otherwise(F.col("text")).alias("text"), (F.col("conv_id") % 2 == 1).alias("booking_offered"))
    return grounding.missing_booking_link(a).select("conv_id", "turn")


@query(f"""WITH g AS (SELECT user_id AS q, string_agg(event_type || ' ', '' ORDER BY event_id) AS tx, bool_or(event_type = 'error') AS escalated, bool_or(value > 90) AS grounded, count(DISTINCT props) AS n_sources FROM events GROUP BY user_id)
SELECT q, escalated, grounded, n_sources, len(string_split(trim(tx), ' '))::int AS words FROM g""")
def g8_audit_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("q"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "escalated").otherwise("text").alias("kind"), F.concat("event_type", F.lit(" ")).alias("text"), F.array("props").alias("sources"), (F.col("value") > 90).alias("grounded"))
    return grounding.audit_runs(e).select("q", "escalated", "grounded", F.size("sources").cast("long").alias("n_sources"), "words")


def audits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("q"), F.col("event_id").alias("seq"), F.col("event_type").isin("error", "view").alias("escalated"))
    return e.where("seq % 2 = 0"), e.where("seq % 2 = 1 and q % 10 <> 3")


AUDIT_SQL = """WITH e AS (SELECT user_id AS q, event_id AS seq, event_type IN ('error', 'view') AS esc FROM events), b AS (SELECT * FROM e WHERE seq % 2 = 0), a AS (SELECT * FROM e WHERE seq % 2 = 1 AND q % 10 <> 3),
l AS (SELECT q, arg_max(esc, seq) AS now FROM a GROUP BY q), c AS (SELECT b.q, CASE WHEN esc AND NOT now THEN 'FIXED' WHEN NOT esc AND now THEN 'REGRESSED' ELSE 'unchanged' END AS change FROM b JOIN l USING (q))"""


@query(f"{AUDIT_SQL} SELECT q, change, count(*) AS n FROM c GROUP BY ALL")
def g9_compare_audits(spark, sf_dir):
    return grounding.compare_audits(*audits(spark, sf_dir)).groupBy("q", "change").agg(F.count("*").alias("n"))


@query(f"{AUDIT_SQL} SELECT count(*) FILTER (change = 'FIXED') AS fixed, count(*) FILTER (change = 'REGRESSED') AS regressed, count(*) FILTER (change = 'unchanged') AS unchanged, (SELECT count(*) FROM b WHERE esc) AS escalations_before, (SELECT count(*) FROM a WHERE esc) AS escalations_after FROM c")
def g9_audit_summary(spark, sf_dir):
    return grounding.audit_summary(*audits(spark, sf_dir))


@query("""SELECT user_id AS request_id, sum(event_id)::bigint AS input_tokens, count(*) AS output_tokens, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END)::bigint AS cache_read_input_tokens, sum(event_id % 3)::bigint AS cache_creation_input_tokens, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) = 0 AND sum(event_id) > 1000 AS cache_missed FROM events GROUP BY user_id""")
def g10_usage(spark, sf_dir):
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.when(F.col("event_type") == "click", 0).otherwise(1).cast("long").alias("cache_read_input_tokens"), (F.col("event_id") % 3).alias("cache_creation_input_tokens"))
    return grounding.usage_rollup(u)


# -- folds --------------------------------------------------------------------------------------------------------


def lead_calls(spark, sf_dir) -> DataFrame:
    kind = lambda k, v: F.when(F.col("event_type") == k, v)
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("conversation_id"), F.col("event_id").alias("seq"), "ts", kind("signup", F.concat(F.lit("  name "), k)).alias("name"), kind("click", F.concat(k, F.when(F.col("value") > 20, "@mail.example").otherwise(" at mail"))).alias("email"),
        kind("view", F.when(F.col("value") > 20, k).otherwise(F.lit("  "))).alias("company"), kind("purchase", k).alias("interest"), kind("error", F.lit("talk")).alias("booking_route"), F.lit(None).cast("string").alias("source_url"),
    )


LEADS_SQL = """calls AS (SELECT user_id AS conversation_id, event_id AS seq, ts, json_extract_string(props, '$.k') AS k, event_type, value FROM events),
clean AS (SELECT conversation_id, seq, ts, CASE WHEN event_type = 'signup' THEN trim('  name ' || k) END AS name, CASE WHEN event_type = 'click' AND value > 20 THEN k || '@mail.example' END AS email, CASE WHEN event_type = 'view' AND value > 20 THEN k END AS company, CASE WHEN event_type = 'purchase' THEN k END AS interest, CASE WHEN event_type = 'error' THEN 'talk' END AS booking_route FROM calls),
leads AS (SELECT conversation_id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(email, seq) FILTER (email IS NOT NULL) AS email, arg_max(company, seq) FILTER (company IS NOT NULL) AS company, arg_max(interest, seq) FILTER (interest IS NOT NULL) AS interest, arg_max(booking_route, seq) FILTER (booking_route IS NOT NULL) AS booking_route, min(ts) AS created_at FROM clean GROUP BY conversation_id)"""


@query(f"WITH {LEADS_SQL} SELECT conversation_id, seq, name, email, company, interest FROM clean")
def l1_clean_leads(spark, sf_dir):
    return folds.clean_lead_fields(lead_calls(spark, sf_dir)).select("conversation_id", "seq", "name", "email", "company", "interest")


@query(f"WITH {LEADS_SQL} SELECT * FROM leads")
def l2_merge_leads(spark, sf_dir):
    return folds.merge_leads(folds.clean_lead_fields(lead_calls(spark, sf_dir))).drop("id", "source_url")


MIRROR_SQL = """s AS (SELECT user_id AS conversation_id, max(event_id) AS saved FROM events WHERE event_type IN ('signup', 'click') GROUP BY user_id),
o AS (SELECT user_id AS conversation_id, max(event_id) AS done, arg_max(event_type, event_id) = 'purchase' AS ok, max(ts) FILTER (event_type = 'purchase') AS mirrored_at FROM events WHERE event_type IN ('purchase', 'error') AND user_id % 7 <> 0 GROUP BY user_id),
m AS (SELECT conversation_id, CASE WHEN done IS NULL THEN 'pending' WHEN NOT ok THEN 'failed' WHEN saved > done THEN 'pending' ELSE 'synced' END AS mirror_status, mirrored_at FROM s LEFT JOIN o USING (conversation_id))"""


def mirrored(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("seq"), "ts", "event_type")
    outcome = e.where("event_type in ('purchase', 'error') and conversation_id % 7 <> 0").select("conversation_id", "seq", "ts", (F.col("event_type") == "purchase").alias("ok"), F.lit(None).cast("string").alias("error"))
    return folds.mirror_state(e.where("event_type in ('signup', 'click')"), outcome)


@query(f"WITH {MIRROR_SQL} SELECT * FROM m")
def l3_mirror_state(spark, sf_dir):
    return mirrored(spark, sf_dir).drop("mirror_error")


@query(f"WITH {LEADS_SQL}, {MIRROR_SQL} SELECT created_at, name, email, company, interest, booking_route, conversation_id FROM leads JOIN m USING (conversation_id) WHERE mirror_status <> 'synced'")
def l4_mirror_backlog(spark, sf_dir):
    leads = folds.merge_leads(folds.clean_lead_fields(lead_calls(spark, sf_dir)))
    return folds.mirror_backlog(leads.join(mirrored(spark, sf_dir), "conversation_id")).drop("source_url")


@query(f"WITH {LEADS_SQL}, {MIRROR_SQL} SELECT created_at, name, email, company, interest, booking_route, NULL::varchar AS source_url, conversation_id FROM leads JOIN m USING (conversation_id) WHERE mirror_status <> 'synced'")
def l4_mirror_sheet(spark, sf_dir):
    """The backlog written as a sheet and read back."""
    leads = folds.merge_leads(folds.clean_lead_fields(lead_calls(spark, sf_dir)))
    backlog, path = folds.mirror_backlog(leads.join(mirrored(spark, sf_dir), "conversation_id")), _place(spark, "sheet")
    files.write_sheet(backlog, path)
    kinds = {c: kind for c, kind in backlog.dtypes}
    sheet = files.read_sheet(spark, path, ", ".join(f"{c} string" for c in backlog.columns))
    return sheet.select(*[F.col(c).cast(kinds[c]) for c in backlog.columns])


def escalations(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turns = c.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    requests = c.where("role = 'assistant' and turn % 2 = 1").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 4 == 1, F.col("text")).alias("question"), F.lit(None).cast("string").alias("context"), F.lit("no_citation").alias("reason"))
    leads = folds.merge_leads(folds.clean_lead_fields(lead_calls(spark, sf_dir)))
    return folds.build_escalations(requests, leads, turns)


ESC_SQL = """u AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS last_user, count(*) AS n_turns FROM conversations GROUP BY conv_id),
esc AS (SELECT sha256(c.conv_id || '#' || c.turn) AS id, c.conv_id AS conversation_id, coalesce(CASE WHEN turn % 4 = 1 THEN nullif(trim(text, chr(10) || ' '), '') END, last_user, '(not stated)') AS question, n_turns, CASE WHEN email IS NOT NULL OR name IS NOT NULL THEN sha256(c.conv_id::varchar) END AS lead_id FROM conversations c JOIN u ON u.conv_id = c.conv_id LEFT JOIN leads l ON l.conversation_id = c.conv_id WHERE role = 'assistant' AND turn % 2 = 1)"""


@query(f"WITH {LEADS_SQL}, {ESC_SQL} SELECT id, conversation_id, md5(question) AS question, n_turns, lead_id FROM esc")
def l5_build_escalations(spark, sf_dir):
    return escalations(spark, sf_dir).select("id", "conversation_id", t.text_md5("question").alias("question"), F.size("transcript").cast("long").alias("n_turns"), "lead_id")


@query(f"WITH {LEADS_SQL}, {ESC_SQL}, b AS (SELECT * FROM esc WHERE conversation_id % 3 <> 0 ORDER BY conversation_id, id LIMIT 100) SELECT b.id, b.conversation_id, l.name, l.email FROM b LEFT JOIN leads l ON sha256(l.conversation_id::varchar) = b.lead_id")
def l6_escalation_backlog(spark, sf_dir):
    e = escalations(spark, sf_dir).withColumns({"email_status": F.when(F.col("conversation_id") % 3 == 0, "sent").otherwise("pending"), "created_at": F.col("conversation_id")})
    leads = folds.merge_leads(folds.clean_lead_fields(lead_calls(spark, sf_dir)))
    return folds.escalation_backlog(e, leads).select("id", "conversation_id", "lead.name", "lead.email")


@query(f"""WITH {LEADS_SQL}, {ESC_SQL}, said AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS said FROM conversations GROUP BY conv_id)
SELECT e.id, 'Question: ' || substr(regexp_replace(question, '[\r\n]+', ' ', 'g'), 1, 60) AS subject, concat_ws(chr(10), 'Why: No source for the answer', 'Question: ' || question, 'Contact: ' || coalesce(nullif(concat_ws(', ', l.name, l.email, l.company), ''), 'not given'), '', 'Transcript', said) AS body
FROM esc e JOIN said ON said.conv_id = e.conversation_id LEFT JOIN leads l ON sha256(l.conversation_id::varchar) = e.lead_id""")
def l7_render_escalations(spark, sf_dir):
    leads = folds.merge_leads(folds.clean_lead_fields(lead_calls(spark, sf_dir)))
    e = escalations(spark, sf_dir).join(leads.select(F.col("id").alias("lead_id"), F.struct("name", "email", "company").alias("lead")), "lead_id", "left")
    return folds.render_escalation(e, {"no_citation": "No source for the answer"})


@query("""SELECT user_id AS conversation_id, min(ts) AS started_at, max(ts) AS last_seen_at, arg_min(props, ts) FILTER (event_type <> 'view') AS source_url, arg_min(event_type, ts) AS user_agent FROM events GROUP BY user_id""")
def l8_conversations(spark, sf_dir):
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("conversation_id"), "ts", F.when(F.col("event_type") != "view", F.col("props")).alias("source_url"), F.col("event_type").alias("user_agent"))
    return folds.upsert_conversations(r)


@query("""SELECT user_id AS conversation_id, event_id * 2 + k AS seq, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE k WHEN 0 THEN event_type ELSE props END AS content, CASE WHEN k = 1 THEN value > 50 END AS grounded FROM events CROSS JOIN (SELECT unnest([0, 1]) AS k)""")
def l9_append_turns(spark, sf_dir):
    x = table(spark, sf_dir, "events").select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("question"), F.col("props").alias("answer"), (F.col("value") > 50).alias("grounded"))
    return folds.append_turns(x)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'general' END AS route, CASE o_orderstatus WHEN 'F' THEN 'https://f.example' WHEN 'O' THEN 'https://o.example' ELSE 'https://g.example' END AS url FROM orders""")
def l10_resolve_route(spark, sf_dir):
    routes = spark.createDataFrame([("F", "https://f.example"), ("O", "https://o.example"), ("general", "https://g.example")], "route string, url string")
    return folds.resolve_route(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("route")), routes).select("o_orderkey", "route", "url")


def edits(spark, sf_dir) -> DataFrame:
    value = F.when(F.col("event_type") != "error", F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("key"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), "ts", value.alias("value"), F.lit("w").alias("who"))


TRAIL_SQL = """e AS (SELECT 'key' || user_id AS key, event_id AS seq, ts, CASE WHEN event_type <> 'error' THEN 'v' || (event_id % 3) END AS value FROM events),
p AS (SELECT *, coalesce(lag(value) OVER (PARTITION BY key ORDER BY seq), 'v0') AS previous FROM e), trail AS (SELECT key, seq, ts, previous AS value FROM p WHERE value IS NOT NULL AND value <> previous)"""


def trail(spark, sf_dir) -> DataFrame:
    e = edits(spark, sf_dir)
    return folds.version_trail(e, e.select("key").distinct().withColumn("value", F.lit("v0")))


@query(f"WITH {TRAIL_SQL} SELECT key, seq, value FROM trail")
def v1_version_trail(spark, sf_dir):
    return trail(spark, sf_dir).select("key", "seq", "value")


@query(f"WITH {TRAIL_SQL} SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS n FROM trail) WHERE n <= 5")
def v2_prune_versions(spark, sf_dir):
    return folds.prune_versions(trail(spark, sf_dir), keep=5).select("key", "seq")


@query(f"WITH {TRAIL_SQL} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS n FROM trail) WHERE n <= 20")
def v3_list_versions(spark, sf_dir):
    return folds.list_versions(trail(spark, sf_dir)).select("key", "seq", "value")


@query(f"WITH {TRAIL_SQL} SELECT count(*) AS edits, count(restored) AS restored FROM (SELECT NULL AS restored FROM e UNION ALL SELECT seq FROM trail WHERE seq % 97 = 0)")
def v4_restore_versions(spark, sf_dir):
    v = trail(spark, sf_dir)
    wanted = v.where("seq % 97 = 0").select("key", F.col("seq").alias("version_seq"), (F.col("seq") + 1_000_000).alias("seq"), "ts", F.lit("w").alias("who"))
    return folds.restore_versions(edits(spark, sf_dir), v, wanted).agg(F.count("*").alias("edits"), F.count("restored_from").alias("restored"))


@query("""WITH s AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 0) SELECT c.c_custkey AS key, coalesce(s.v, 'default') AS value, s.v IS NULL AS is_default FROM customer c LEFT JOIN s ON c.c_custkey = s.k""")
def v5_current_settings(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return folds.current_settings(c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value")), c.select(F.col("c_custkey").alias("key"), F.lit("default").alias("value")))


@query("SELECT user_id AS upload_id, arg_max(event_type, event_id) AS status, arg_max(props, event_id) AS doc_id FROM events GROUP BY user_id")
def v6_upload_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("upload_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("error"), F.col("props").alias("doc_id"))
    return folds.upload_status(e).drop("error")


def uploads(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(".pdf")).alias("filename"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("display_name"), F.lit("application/pdf").alias("media_type"), F.col("p_size").alias("size_bytes"), (F.col("p_partkey") % 5 != 0).alias("downloadable"), F.when(F.col("p_partkey") % 7 == 0, "removed").otherwise("live").alias("status"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS name FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def v7_list_materials(spark, sf_dir):
    return folds.list_materials(uploads(spark, sf_dir)).select("id", "name")


@query("SELECT l_partkey AS upload_id, count(*) AS downloads FROM lineitem WHERE l_partkey % 5 <> 0 AND l_partkey % 7 <> 0 AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY l_partkey")
def v8_download_counts(spark, sf_dir):
    return folds.download_counts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("upload_id")), uploads(spark, sf_dir))


# -- sets ---------------------------------------------------------------------------------------------------------


@query("SELECT 'd' || doc_id AS doc_id, lang, NULL AS url FROM documents UNION ALL SELECT 'p' || page_id, NULL, url FROM pages")
def u1_union_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "lang")
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_id"), "url")
    return corpus.union_sources(d, p)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u2_missing_pages(spark, sf_dir):
    return corpus.missing_pages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT CASE WHEN doc_id % 4 = 0 THEN 'upload-' ELSE 'd-' END || doc_id AS doc_id, 'old' AS v FROM documents WHERE doc_id % 4 = 0 OR doc_id = 1 UNION ALL SELECT 'p-' || page_id, 'new' FROM pages""")
def u3_scoped_replace(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    old = table(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 4 == 0, "upload-").otherwise("d-"), i).alias("doc_id"), F.lit("old").alias("v"))
    new = table(spark, sf_dir, "pages").select(F.concat(F.lit("p-"), F.col("page_id").cast("string")).alias("doc_id"), F.lit("new").alias("v"))
    return corpus.scoped_replace(old, new, also=["d-1"])


@query("""SELECT count(*) AS pages, count(*) + 1 AS chunks, count(*) FILTER (item_id % 3 <> 0) AS carried, (SELECT count(*) FROM documents) + count(*) FILTER (item_id % 3 = 0) + 1 AS pending, 'Client knowledge' AS note FROM benchmark""")
def u4_sync_website(spark, sf_dir):
    """The benchmark's items as pages over an index that has them, a third of them as they were worded before, and a page that is gone, all with vectors."""
    return synced(spark, sf_dir)["counts"]


@query("""SELECT 'page-' || item_id || '#0' AS id, CASE WHEN item_id % 3 <> 0 THEN item_id::double END AS vector FROM benchmark UNION ALL SELECT doc_id || '#0', NULL FROM documents UNION ALL SELECT 'client-knowledge#0', NULL""")
def u4_synced_chunks(spark, sf_dir):
    return synced(spark, sf_dir)["chunks"].select("id", F.col("embedding")[0].cast("double").alias("vector"))


def synced(spark, sf_dir) -> dict[str, DataFrame]:
    body = lambda text: F.concat(F.lit("<html><head><title>Item</title></head><body><main><p>"), F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></main></body></html>"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("page-"), F.col("item_id").cast("string")).alias("doc_id"), F.lit("one").alias("site"), F.concat(F.lit("https://one.example/"), "item_id").alias("url"), "item_id", "text")
    then = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("An older wording of this: "), "text")).otherwise(F.col("text"))
    before = items.select("doc_id", "site", "url", "item_id", body(then).alias("html"))
    before = before.unionByName(before.where("item_id = 0").withColumn("doc_id", F.lit("page-gone")))
    cleaned = pages.strip_shared_boilerplate(pages.html_to_text(before), "site")
    website = corpus.chunk_pages(cleaned, "doc_id").join(before.select("doc_id", F.col("item_id").cast("float").alias("v")), "doc_id").withColumns({"embedding": F.array("v"), "source_type": F.lit("website")}).drop("v")
    rest = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("id"), F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(None).cast("array<float>").alias("embedding"), F.lit("program_document").alias("source_type"))
    note = spark.createDataFrame([("client-knowledge", "Client knowledge", "What the client says goes first.")], "doc_id string, title string, text string")
    return corpus.sync_website(rest.unionByName(website, allowMissingColumns=True), items.select("doc_id", "site", "url", body(F.col("text")).alias("html")), note=note)


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'rewritten note of one line' ELSE text END AS text FROM documents) SELECT count(*) AS chunk_count FROM c WHERE doc_id % 50 = 7""")
def v9_reindex_notes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    old = chunking.chunk_documents(docs.select("doc_id", chunking.flat_segments("text").alias("segments"))).withColumn("embedding", F.lit(None).cast("array<float>"))
    note = docs.where("doc_id % 50 = 7").select("doc_id", chunking.flat_segments(F.lit("rewritten note of one line")).alias("segments"))
    return corpus.reindex_note(old, note)["chunks"].where("text = 'rewritten note of one line'").agg(F.count("*").alias("chunk_count"))


# -- sources and checks of inputs ---------------------------------------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id || '#0' AS id, doc_id::varchar AS doc_id, md5(text) AS m FROM documents")
def s1_corpus_jsonl(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("id"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    path = _place(spark, "corpus")
    files.write_corpus_jsonl(docs, path)
    return files.read_corpus_jsonl(spark, path).select("id", "doc_id", t.text_md5("text").alias("m"))


@query("SELECT doc_id::varchar AS doc_id, source AS source_type, md5(text) AS sha256, length(text)::int AS words FROM documents")
def s2_manifest(spark, sf_dir):
    """Manifests of 64 parts of the corpus, each one JSON object over many lines."""
    entry = F.struct(F.col("doc_id").cast("string").alias("docId"), F.col("source").alias("sourceType"), t.text_md5("text").alias("sha256"), F.length("text").alias("words"))
    parts = table(spark, sf_dir, "documents").groupBy(F.pmod("doc_id", F.lit(64)).alias("part")).agg(F.collect_list(entry).alias("documents"))
    path = _place(spark, "manifests")
    parts.select(F.regexp_replace(F.to_json(F.struct("documents")), r"\},\{", "},\n{").alias("value"), "part").repartition("part").write.partitionBy("part").text(path)
    return files.read_manifest(spark, f"{path}/*")["documents"].select("doc_id", "source_type", "sha256", "words")


@query("SELECT doc_id, md5(text) AS m FROM documents")
def s4_files(spark, sf_dir):
    """Documents as lines of files, read as bytes."""
    path = _place(spark, "raw")
    table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.text(path)
    lines = files.read_files(spark, path, "*.txt").select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    return lines.select(F.from_json("line", "doc_id long, text string").alias("d")).select("d.doc_id", t.text_md5("d.text").alias("m"))


@query("SELECT doc_id, md5(text) AS m FROM documents")
def s6_versioned_index(spark, sf_dir):
    docs, root = table(spark, sf_dir, "documents"), _place(spark, "index")
    files.write_index({"chunks": docs.limit(0)}, root, "v1")
    files.write_index({"chunks": docs}, root, "v2")
    return files.read_index(spark, root, ["chunks"])["chunks"].select("doc_id", t.text_md5("text").alias("m"))


@query("SELECT doc_id, source, CASE WHEN source = 'src3' THEN 1 ELSE 0 END AS replaced FROM documents WHERE source <> 'src3' OR doc_id % 3 = 0")
def s7_replace_slice(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(0).alias("replaced")), _place(spark, "slices")
    files.replace_slice(docs, path, "source")
    files.replace_slice(docs.where("source = 'src3' and doc_id % 3 = 0").withColumn("replaced", F.lit(1)), path, "source")
    return spark.read.parquet(path).select("doc_id", "source", "replaced")


@query(f"""SELECT path, CASE WHEN sheet THEN 0 ELSE n END::int AS segments, CASE WHEN sheet THEN 'unsupported format .xlsx' WHEN n = 0 THEN 'no text' END AS error
FROM (SELECT doc_id || CASE WHEN doc_id % 9 = 0 THEN '.xlsx' ELSE '.txt' END AS path, doc_id % 9 = 0 AS sheet, len(list_filter(string_split(text, chr(12)), lambda x: {sql.trim_all('x')} <> '')) AS n FROM documents)""")
def t6_extract_text(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, ".xlsx").otherwise(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return pages.extract_text(raw).select("path", F.size("segments").alias("segments"), "error")


@query("""SELECT page_id, coalesce(nullif(trim(regexp_replace(ti, '(?i)[ ]*[|]\\s*.*$', '')), ''), url) AS title FROM (SELECT page_id, url, 'Page ' || page_id || ' | ' || url AS ti FROM pages)""")
def t8_page_title(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("raw", F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit(" | "), "url"))
    return p.select("page_id", pages.page_title("raw", "url", "http").alias("title"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'unsupported type exe' WHEN p_size * 1000000 > 26214400 THEN 'larger than 25 MB' END AS reason FROM part")
def f8_validate_uploads(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ".exe").otherwise(".PDF")).alias("filename"), (F.col("p_size").cast("long") * 1_000_000).alias("size_bytes"))
    good, bad = corpus.validate_upload(p)
    return good.select("id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", "reason"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN 'message length' WHEN role = 'system' THEN 'history item' WHEN turn % 2 = 1 THEN 'conversation id' END AS reason FROM (SELECT conv_id, turn, role, CASE WHEN length(text) > 300 THEN repeat('x', 301) ELSE text END AS text FROM conversations)""")
def f9_validate_messages(spark, sf_dir):
    ident = F.when(F.col("turn") % 2 == 1, F.lit("none")).otherwise(F.lit("123e4567-e89b-12d3-a456-426614174000"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.length("text") > 300, F.repeat(F.lit("x"), F.lit(2001))).otherwise(F.col("text")).alias("message"), F.array(F.struct("role", F.col("role").alias("content"))).alias("history"), ident.alias("conversation_id"), F.lit(None).cast("string").alias("source_url"))
    good, bad = corpus.validate_messages(c)
    return good.select("conv_id", "turn", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("conv_id", "turn", "reason"))


@query("SELECT doc_id, ceil(length(text) / 4)::int AS tokens FROM documents")
def e3_estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.estimate_tokens("text").alias("tokens"))


@query("SELECT doc_id::varchar AS id, length(text)::double AS characters, (length(text) - length(replace(text, 'e', '')))::double AS es FROM documents")
def e5_embed_batches(spark, sf_dir):
    pending = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"), t.estimate_tokens("text").alias("tokens"))
    found = corpus.embed_batches(chunking.token_batches(pending), lambda bodies: [[float(len(b)), float(b.count("e"))] for b in bodies])
    return found.select("id", F.col("embedding")[0].cast("double").alias("characters"), F.col("embedding")[1].cast("double").alias("es"))


@query(f"""SELECT name, module, coalesce(purpose, name || ' worksheet used during ' || module || ' of the program.') AS purpose FROM (SELECT doc_id || ' sheet' AS name, 'Module ' || (doc_id % 5) AS module, {sql.purpose('text')} AS purpose FROM documents)""")
def c8_catalog_entries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("Module "), (F.col("doc_id") % 5).cast("string"), F.lit(".zip")).alias("archive"), F.concat(F.col("doc_id").cast("string"), F.lit("_sheet.docx")).alias("path"), "text")
    return chunking.catalog_entries(d)


@query("SELECT page_id, url, md5(html) AS m FROM pages")
def s3_read_pages(spark, sf_dir):
    return files.read_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", t.text_md5("html").alias("m"))


def _zipped(docs: DataFrame, members: Callable[[str], dict[str, bytes]]) -> DataFrame:
    """path, content: a zip file of each of ``docs(doc_id, text)``."""

    def run(batches):
        for b in pieces(batches):
            out = []
            for text in b.column("text").to_pylist():
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for name, data in members(text or "").items():
                        z.writestr(name, data)
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], names=["path", "content"])

    return docs.select("path", "text").mapInArrow(run, "path string, content binary")


@query("""SELECT doc_id || '.zip' AS archive, 'whole.txt' AS path, md5(text) AS m, NULL::varchar AS error FROM documents UNION ALL SELECT doc_id || '.zip', 'lines/first.txt', md5(string_split(text, chr(10))[1]), NULL FROM documents""")
def s5_expand_archives(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".zip")).alias("path"), "text")
    zips = _zipped(docs, lambda text: {"whole.txt": text.encode(), "lines/": b"", "lines/first.txt": text.split("\n")[0].encode()})
    return pages.expand_archives(zips).select("archive", "path", F.md5("content").alias("m"), "error")


@query(f"SELECT doc_id || '.docx' AS path, md5({sql.normalized(sql.collapsed('text'))}) AS m FROM documents WHERE {sql.trim_all('text')} <> ''")
def t5_office_text(spark, sf_dir):
    """Every document as a word-processor file, a paragraph a line and all but ASCII as numeric entities, and its text read back."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), "text")

    def members(text: str) -> dict[str, bytes]:
        lines = "".join(f"<w:p><w:r><w:t>{html.escape(x)}</w:t></w:r></w:p>" for x in text.split("\n"))
        return {"word/document.xml": f"<w:document><w:body>{lines}</w:body></w:document>".encode("ascii", "xmlcharrefreplace")}

    found = pages.extract_text(_zipped(docs, members))
    return found.where("error is null").select("path", t.text_md5(F.col("segments")[0]["text"]).alias("m"))


NOTES_SQL = """d AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'note number ' || doc_id || CASE WHEN doc_id % 100 = 7 THEN '' ELSE ' rewritten' END ELSE text END AS text FROM documents)"""


def reindexed(spark, sf_dir) -> dict[str, DataFrame]:
    """Every document a chunk with a vector; of the notes among them half have new words."""
    i = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents")
    is_note, said = F.col("doc_id") % 50 == 7, F.concat(F.lit("note number "), i)
    old = docs.select(F.concat(i, F.lit("#0")).alias("id"), i.alias("doc_id"), F.when(is_note, said).otherwise(F.col("text")).alias("text"), F.array(F.col("doc_id").cast("float")).alias("embedding"))
    new = F.when(F.col("doc_id") % 100 == 7, said).otherwise(F.concat(said, F.lit(" rewritten")))
    return corpus.reindex_note(old, docs.where(is_note).select(i.alias("doc_id"), chunking.flat_segments(new).alias("segments")))


@query(f"WITH {NOTES_SQL} SELECT doc_id || '#0' AS id, md5(text) AS m, CASE WHEN doc_id % 50 <> 7 OR doc_id % 100 = 7 THEN doc_id::float::double END AS vector FROM d")
def v9_reindex_chunks(spark, sf_dir):
    return reindexed(spark, sf_dir)["chunks"].select("id", t.text_md5("text").alias("m"), F.col("embedding")[0].cast("double").alias("vector"))


@query(f"WITH {NOTES_SQL}, w AS (SELECT DISTINCT doc_id, unnest({sql.tokens('text')}) AS word FROM d) SELECT word, count(*) AS ndoc FROM w GROUP BY word")
def v9_reindex_stats(spark, sf_dir):
    return reindexed(spark, sf_dir)["lexemes"].select("word", "ndoc")


# -- streams ------------------------------------------------------------------------------------------------------


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}/*.parquet")


def _run(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run to the end of what there is; the current table."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").foreachBatch(jobs.upsert_to(f"{place}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return jobs.latest(spark.read.parquet(f"{place}/out"))


@query("""SELECT user_id AS conversation_id, min(ts) AS started_at, max(ts) AS last_seen_at, arg_min(props, ts) AS source_url, arg_min(event_type, ts) AS user_agent FROM events GROUP BY user_id""")
def x3_stream_conversations(spark, sf_dir):
    r = _events_stream(spark, sf_dir).select(F.col("user_id").alias("conversation_id"), "ts", F.col("props").alias("source_url"), F.col("event_type").alias("user_agent"))
    return _run(jobs.stream_conversations(r), spark)


@query(f"WITH {LEADS_SQL} SELECT conversation_id, name, email, company, interest, booking_route, created_at FROM leads")
def x2_stream_leads(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    kind = lambda n, v: F.when(F.col("event_type") == n, v)
    calls = _events_stream(spark, sf_dir).select(
        F.col("user_id").alias("conversation_id"), F.col("event_id").alias("seq"), "ts", kind("signup", F.concat(F.lit("  name "), k)).alias("name"), kind("click", F.concat(k, F.when(F.col("value") > 20, "@mail.example").otherwise(" at mail"))).alias("email"),
        kind("view", F.when(F.col("value") > 20, k).otherwise(F.lit("  "))).alias("company"), kind("purchase", k).alias("interest"), kind("error", F.lit("talk")).alias("booking_route"), F.lit(None).cast("string").alias("source_url"),
    )
    return _run(jobs.stream_leads(calls), spark).drop("source_url")


@query(f"""WITH d AS (SELECT DISTINCT text, sha256(text) AS sha256, length(text) % 9 = 0 AS exe, {sql.trim_all('text')} = '' AS bare, strlen(text) AS n, len(regexp_extract_all({sql.collapsed('text')}, '[^{sql.SPACE}]+'))::bigint AS w FROM documents),
s AS (SELECT *, CASE WHEN exe THEN 'unsupported type exe' WHEN n > 26214400 THEN 'larger than 25 MB' WHEN n <= 0 THEN 'empty' WHEN bare THEN 'no text' END AS reason FROM d)
SELECT sha256, CASE WHEN reason IS NULL THEN 'live' ELSE 'failed' END AS status, reason, CASE WHEN reason IS NULL OR (bare AND NOT exe AND n > 0) THEN w END AS words,
CASE WHEN reason IS NULL THEN 'queued>extracting>chunking>embedding>live' WHEN reason = 'no text' THEN 'queued>extracting>failed' ELSE 'queued>failed' END AS stages, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS embedded FROM s""")
def x1_stream_uploads(spark, sf_dir):
    """Every document an upload: equal bytes are taken once, whole or not at all, through all stages."""
    schema = table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/[d]ocuments.parquet")  # a pattern, as a stream takes no single file by its name; it finds a folder, too
    ext = F.when(F.length("text") % 9 == 0, ".exe").otherwise(".txt")
    uploads = docs.select(F.concat(F.col("doc_id").cast("string"), ext).alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"), F.current_timestamp().alias("arrived"))
    place = _place(spark, "uploads")
    jobs.stream_uploads(uploads, place, f"{place}/state", lambda bodies: [[float(len(b))] for b in bodies]).awaitTermination()
    found = jobs.upload_statuses(jobs.upload_log(spark, place))
    # whether all chunks of a live document have their vector
    whole = jobs.live_chunks(spark, place).groupBy("doc_id").agg(F.min(F.col("embedding").isNotNull().cast("int")).alias("embedded"))
    whole = whole.join(spark.read.parquet(f"{place}/documents").select("doc_id", "sha256"), "doc_id").select("sha256", "embedded")
    return found.join(whole, "sha256", "left").select("sha256", "status", "reason", "words", "stages", F.coalesce("embedded", F.lit(0)).alias("embedded"))


# -- one job ------------------------------------------------------------------------------------------------------

ENTRY_SQL = f"""WITH keep AS (SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1),
{sql.BM25.replace('FROM documents)', 'FROM keep)')} SELECT item_id AS query_id, coalesce(max(raw) < 1, true) AS thin, round(max(raw), 6) AS best FROM benchmark LEFT JOIN bm ON item_id = query_id GROUP BY item_id"""


@query(ENTRY_SQL)
def w1_answerable_questions(spark, sf_dir):
    """Exact dedup, analysis, postings, statistics, BM25 and the thin-retrieval test as one plan."""
    docs = table(spark, sf_dir, "documents").withColumn("sha256", t.text_md5("text")).withColumn("label", F.col("doc_id").cast("string"))
    kept, _ = dedup.drop_exact_duplicates(docs, "sha256", ["doc_id"], "label")
    found = staged(retrieval.bm25(questions(spark, sf_dir), index.build_index(kept, id_col="doc_id")))
    q = questions(spark, sf_dir)
    thin = retrieval.is_thin(q, found.select("query_id", F.col("raw").alias("lex_score"), F.lit(0.0).alias("sem_score")))
    return thin.join(found.groupBy("query_id").agg(F.round(F.max("raw"), 6).alias("best")), "query_id", "left")
