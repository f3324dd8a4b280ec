"""Verdicts on answers by their citations, conflicts between sources, audits.

Input: ``blocks(response_id, block_idx, text, citations)`` and ``hits(response_id,
document_index, id, doc_id, text, ...)``. Everything is grouped by response, whose
blocks are few, so lists per response are bounded by one answer's length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.analysis import pieces
from lectern.functions.text import SPACE, trim_all

MIN_CITED_RATIO = 0.2
CLOSING_LINE_LIMIT = 320
#: What marks a claim, an assertion and a hard fact in an uncited span.
CLAIM = r"(?i)[0-9]|\$|%|\b(?:covers?|costs?|includes?|requires?|qualif|eligib|grant|hours?|modules?|weeks?|employees?|cohort|starts?|deadline|price|fee|funded)\b"
ASSERTION = r"(?i)\b(?:will|won't|would|shall|must|guarantee[ds]?|definitely|certainly|absolutely|approved?|approval|always|never|ensures?|entitled)\b"
HARD_FACT = r"[0-9]|\$|%"
#: Fixed value: seasons with a year.
COHORT = r"(?i)\b(winter|spring|summer|fall|autumn)[ \t\n\r\f\x0B\xA0]+(20[0-9]{2})\b"
#: Fixed value: phrases that promise a link.
PROMISES_LINK = r"(?i)\b(here'?s? (?:a|the) link|link to book|book (?:a|fifteen|15)|booking link|link below|link above|schedule a call|book that call)\b"
#: Names that may stand in a conversational span; a deployment adds its own.
ALLOWED_NAMES = ("I", "I'm", "I'll")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_conversational(c: Column | str, allowed: tuple[str, ...] = ALLOWED_NAMES) -> Column:
    """Whether a span asserts nothing: it fails closed."""
    t = trim_all(c)
    names = "|".join(sorted(allowed, key=len, reverse=True))
    rest = F.regexp_replace(t, rf"\b(?:{names})\b", "") if allowed else t
    named = rest.rlike(rf"(?<!^)(?<![.!?][{SPACE}])\b[A-Z][a-z]{{2,}}")
    return (
        F.when(t == "", True).when(F.length(t) > 180, False).when(t.rlike(HARD_FACT), False).when(t.endswith("?"), True)
        .when(t.rlike(ASSERTION) | t.rlike(CLAIM), False).when(F.length(t) > 90, False).otherwise(~named)
    )


def should_show_block(text: Column | str, has_citations: Column | str, **options) -> Column:
    return _col(has_citations) | is_conversational(text, **options)


def source_label(label: Column | str, locator: Column | str, title: Column | str) -> Column:
    """``label, locator``, or the label, or the fallback title."""
    label, locator = _col(label), _col(locator)
    return F.coalesce(F.when(locator != "", F.concat(label, F.lit(", "), locator)), label, _col(title))


def enforce_grounding(blocks: DataFrame, hits: DataFrame, min_ratio: float = MIN_CITED_RATIO, responses: DataFrame | None = None, allowed: tuple[str, ...] = ALLOWED_NAMES) -> DataFrame:
    """response_id, text, sources, uncited, cited_ratio, reason, grounded.

    ``responses`` adds answers without any block, which are ``empty``.
    """
    cited = F.coalesce(F.size("citations"), F.lit(0)) > 0
    flat = blocks.select("response_id", "block_idx", "text", cited.alias("cited"), is_conversational("text", allowed).alias("small_talk"))
    one = F.struct("block_idx", "text", "cited", "small_talk")
    joined = flat.groupBy("response_id").agg(F.sort_array(F.collect_list(one)).alias("b"))
    if responses is not None:
        joined = responses.select("response_id").distinct().join(joined, "response_id", "left").withColumn("b", F.coalesce("b", F.array().cast(joined.schema["b"].dataType)))
    raw = F.array_join(F.transform("b", lambda x: x["text"]), "")
    uncited = F.transform(F.filter("b", lambda x: ~x["cited"] & ~x["small_talk"]), lambda x: trim_all(x["text"]))
    cited_chars = F.aggregate(F.filter("b", lambda x: x["cited"]), F.lit(0), lambda a, x: a + F.length(x["text"]))
    verdict = joined.select("response_id", trim_all(raw).alias("text"), uncited.alias("uncited"), cited_chars.alias("n_cited"), F.exists("b", lambda x: x["cited"]).alias("any_cited"))
    ratio = F.when(F.length("text") > 0, F.col("n_cited") / F.length("text")).otherwise(0.0)
    open_ = F.size("uncited") > 0
    reason = F.when(F.col("text") == "", "empty").when(~F.col("any_cited") & open_, "no_citation").when(F.col("any_cited") & open_ & (ratio < min_ratio), "thinly_cited").otherwise("ok")
    verdict = verdict.select("response_id", "text", "uncited", ratio.alias("cited_ratio"), reason.alias("reason"))
    out = verdict.join(cited_sources(blocks, hits), "response_id", "left")
    shown = ~F.col("reason").isin("empty", "no_citation") & F.col("sources").isNotNull()
    empty = F.array().cast(out.schema["sources"].dataType)
    return out.select("response_id", "text", F.when(shown, F.col("sources")).otherwise(empty).alias("sources"), "uncited", "cited_ratio", "reason", (F.col("reason") == "ok").alias("grounded"))


def cited_sources(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    """response_id, sources: one per cited chunk, in the order of first citation."""
    cites = blocks.select("response_id", "block_idx", F.posexplode("citations").alias("at", "c")).where("c.document_index is not null")
    index = F.col("c.document_index").alias("document_index")
    h = hits.select("response_id", "document_index", "id", "doc_id", F.col("source_label").alias("_label"), "locator", "origin")
    met = cites.select("response_id", "block_idx", "at", index, F.col("c.document_title").alias("title"), F.col("c.cited_text").alias("quote")).join(h, ["response_id", "document_index"], "left")
    row = F.struct(
        "block_idx", "at", F.when(F.col("id").isNull(), F.coalesce("title", F.lit("Knowledge base"))).otherwise(source_label("_label", "locator", "title")).alias("label"),
        F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("id", F.lit("")).alias("chunk_id"), F.coalesce("quote", F.lit("")).alias("quote"), F.coalesce("origin", F.lit("")).alias("origin"),
    )
    first = met.groupBy("response_id", F.coalesce("id", F.col("document_index").cast("string")).alias("k")).agg(F.min(row).alias("s"))
    return first.groupBy("response_id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: F.struct(s["label"].alias("label"), s["doc_id"].alias("doc_id"), s["chunk_id"].alias("chunk_id"), s["quote"].alias("quote"), s["origin"].alias("origin"))).alias("sources"))


def cohort_labels(text: Column | str, pattern: str = COHORT) -> Column:
    """Distinct ``Season Year`` labels of a text, sorted."""
    seasons, years = F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(1)), F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(2))
    return F.array_sort(F.array_distinct(F.zip_with(seasons, years, lambda s, y: F.concat(F.initcap(F.lower(s)), F.lit(" "), y))))


def detect_cohort_conflict(hits: DataFrame, pattern: str = COHORT) -> DataFrame:
    """query_id, labels: empty unless a question's hits disagree, or if a correction is among them."""
    found = hits.select("query_id", "source_type", cohort_labels("text", pattern).alias("l"))
    per = found.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("l")))).alias("labels"), F.bool_or(F.col("source_type") == "correction").alias("settled"))
    return per.select("query_id", F.when((F.size("labels") > 1) & ~F.coalesce("settled", F.lit(False)), F.col("labels")).otherwise(F.array().cast("array<string>")).alias("labels"))


def find_cohort_mentions(docs: DataFrame, pattern: str = COHORT, before: int = 60, after: int = 90, label: str = "source") -> DataFrame:
    """source, cohort, excerpt: one row per mention, in the text's order."""
    import re

    compiled = re.compile(pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            found = [(i, m) for i, t in enumerate(texts) for m in compiled.finditer(t or "")]
            cohorts = [" ".join([m[1].capitalize(), *[g for g in m.groups()[1:] if g]]) for _, m in found]
            excerpts = [" ".join(texts[i][max(0, m.start() - before) : m.start() + after].split()) for i, m in found]
            yield pa.RecordBatch.from_arrays([b.column("source").take(pa.array([i for i, _ in found], pa.int64())), pa.array(cohorts, pa.string()), pa.array(excerpts, pa.string())], names=["source", "cohort", "excerpt"])

    rows = docs.select(F.col(label).alias("source"), "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["source"], T.StructField("cohort", T.StringType()), T.StructField("excerpt", T.StringType())]))


def audit_cohorts(mentions: DataFrame) -> DataFrame:
    """One row: the distinct labels, and whether there is more than one."""
    return mentions.select("cohort").distinct().agg(F.sort_array(F.collect_list("cohort")).alias("labels")).select("labels", (F.size("labels") > 1).alias("conflict"))


def response_disposition(rounds: DataFrame) -> DataFrame:
    """What becomes of each round of a response: ``rounds(response_id, round, text, reason, grounded, has_tools, thin, refused)``."""
    earlier = Window.partitionBy("response_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    grounded, acted = F.coalesce(F.max("grounded").over(earlier), F.lit(False)), F.coalesce(F.max("has_tools").over(earlier), F.lit(False))
    excused = grounded | acted | F.col("has_tools")
    out = (
        F.when(F.col("thin"), "escalate_thin").when(F.col("refused"), "escalate_refusal").when(F.length("text") == 0, "nothing").when(F.col("grounded"), "shown")
        .when(excused & (F.length("text") <= CLOSING_LINE_LIMIT), "short_follow_up").when(excused, "dropped_follow_up").otherwise("escalate_no_citation")
    )
    return rounds.withColumn("disposition", out)


def missing_booking_link(answers: DataFrame) -> DataFrame:
    """Answers that promise a link of which none was sent."""
    return answers.where(F.col("text").rlike(PROMISES_LINK) & ~F.col("booking_offered"))


def audit_runs(events: DataFrame) -> DataFrame:
    """q, text, sources, escalated, grounded, words from ``events(q, seq, kind, text, sources, grounded)``."""
    row = F.struct("seq", "text", "sources")
    per = events.groupBy("q").agg(F.sort_array(F.collect_list(row)).alias("e"), F.bool_or(F.col("kind") == "escalated").alias("escalated"), F.bool_or(F.coalesce("grounded", F.lit(False))).alias("grounded"))
    text = trim_all(F.array_join(F.transform("e", lambda x: F.coalesce(x["text"], F.lit(""))), ""))
    sources = F.array_distinct(F.flatten(F.filter(F.transform("e", lambda x: x["sources"]), lambda s: s.isNotNull())))
    return per.select("q", text.alias("text"), sources.alias("sources"), "escalated", "grounded", F.when(text == "", 0).otherwise(F.size(F.split(text, f"[{SPACE}]+"))).alias("words"))


def compare_audits(before: DataFrame, after: DataFrame, order: str = "seq") -> DataFrame:
    """q, change (FIXED, REGRESSED, unchanged) of every earlier question that was asked again; the last later row of a question counts."""
    last = after.groupBy("q").agg(F.max_by("escalated", order).alias("now"))
    change = F.when(F.col("escalated") & ~F.col("now"), "FIXED").when(~F.col("escalated") & F.col("now"), "REGRESSED").otherwise("unchanged")
    return before.join(last, "q").select("q", change.alias("change"))


def audit_summary(before: DataFrame, after: DataFrame, order: str = "seq") -> DataFrame:
    """One row: fixed, regressed, unchanged, escalations before and after (all rows of either)."""
    n = lambda k: F.coalesce(F.sum((F.col("change") == k).cast("long")), F.lit(0)).alias(k.lower())
    changes = compare_audits(before, after, order).agg(n("FIXED"), n("REGRESSED"), n("unchanged"))
    count = lambda df, name: df.agg(F.coalesce(F.sum(F.col("escalated").cast("long")), F.lit(0)).alias(name))
    return changes.crossJoin(count(before, "escalations_before")).crossJoin(count(after, "escalations_after"))


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Token counters per request, and whether the prompt cache was missed on a large input."""
    names = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]
    total = usage.groupBy("request_id").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return total.withColumn("cache_missed", (F.col("cache_read_input_tokens") == 0) & (F.col("input_tokens") > 1000))


def scan_document_risks(docs: DataFrame, rules: DataFrame, key: str = "doc_id", shown: int = 4) -> DataFrame:
    """doc_id, label, why, n_hits, quotes: the rules (label, pattern, why; few) that a document meets,
    with the first hits in their surroundings."""
    pairs = docs.select(key, "text").crossJoin(F.broadcast(rules))
    hits = pairs.withColumn("hits", F.array_distinct(F.expr("regexp_extract_all(text, pattern, 0)"))).where(F.size("hits") > 0)

    def quote(h: Column) -> Column:
        at = F.instr(F.col("text"), h) - 1
        start = F.greatest(at - 55, F.lit(0))
        return trim_all(F.regexp_replace(F.substring(F.col("text"), start + 1, at + 75 - start), f"[{SPACE}]+", " "))

    return hits.select(key, "label", "why", F.size("hits").alias("n_hits"), F.transform(F.slice("hits", 1, shown), quote).alias("quotes"))


def risk_summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.groupBy(key).agg(F.count("*").alias("flagged"))
