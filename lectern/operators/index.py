"""Term index: postings, document frequencies, corpus statistics and their refresh.

A chunk's term counts are made within its row, before any row is exploded, so
postings need no shuffle: by a helper that counts the analyzer's plain function, if
it has one, else by built-in expressions. Document frequencies are one map-side combined
aggregation. Postings carry their chunk's length, which saves scoring a join. Positions lie
beside the counts, as distances, in a column that only phrases and cover density read.
``impact_blocks`` deals postings to ranges of chunks, with the best weight of each, for scoring that skips.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.analysis import counted, tokenize
from lectern.sources.staging import staged

Analyzer = Callable[[Column], Column]


def analyzed(chunks: DataFrame, analyzer: Analyzer = tokenize, id_col: str = "id", text_col: str = "text") -> DataFrame:
    return chunks.select(F.col(id_col).alias("chunk_id"), analyzer(F.col(text_col)).alias("tokens"))


def term_counts(chunks: DataFrame, analyzer: Analyzer = tokenize, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """chunk_id, token_count, terms array<struct<word, tf>>, gaps (each term's first position and the distances between its positions) of every chunk, without a shuffle.

    An analyzer of built-in expressions: the tokens of a chunk are sorted with their places; a term's count is the distance between the
    places where it starts and where the next one does. Arrays that are needed
    more than once are bound as the element of a one-element array.
    """

    words = getattr(analyzer, "words", None)
    if words is not None:
        return counted(chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text")), words, getattr(analyzer, "placed", None))

    bind = lambda value, body: F.flatten(F.transform(F.array(value), body))

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["w"] != F.get(t, i - 1)["w"]))

        def run(s: Column, i: Column, k: Column) -> Column:
            n = F.coalesce(F.get(s, k + 1), F.size(t)) - i
            gaps = F.transform(F.sequence(i, i + n - 1), lambda x: F.get(t, x)["i"] - F.when(x == i, 0).otherwise(F.get(t, x - 1)["i"]))
            return F.struct(F.get(t, i)["w"].alias("word"), n.alias("tf"), gaps.alias("gaps"))

        return bind(starts, lambda s: F.transform(s, lambda i, k: run(s, i, k)))

    rows = analyzed(chunks, analyzer, id_col, text_col).select("chunk_id", F.array_sort(F.transform("tokens", lambda w, i: F.struct(w.alias("w"), i.alias("i")))).alias("t"))
    none = F.array().cast("array<struct<word:string,tf:int,gaps:array<int>>>")
    found = rows.select("chunk_id", F.greatest(F.size("t"), F.lit(0)).alias("token_count"), F.when(F.size("t") > 0, bind(F.col("t"), runs)).otherwise(none).alias("r"))
    return found.select("chunk_id", "token_count", F.transform("r", lambda x: F.struct(x["word"].alias("word"), x["tf"].alias("tf"))).alias("terms"), F.col("r.gaps").alias("gaps"))


def chunk_terms(chunks: DataFrame, analyzer: Analyzer = tokenize, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """chunk_id, word, tf, token_count."""
    return _postings(term_counts(chunks, analyzer, id_col, text_col))


def _postings(counted: DataFrame) -> DataFrame:
    return counted.select("chunk_id", F.inline("terms"), "token_count").select("chunk_id", "word", "tf", "token_count")


def _places(counted: DataFrame) -> DataFrame:
    """chunk_id, word, gaps."""
    return counted.select("chunk_id", F.inline(F.arrays_zip("terms", "gaps"))).select("chunk_id", "terms.word", "gaps")


def impact_blocks(index: dict[str, DataFrame], size: int = 128, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """word, range, best, postings array<struct<chunk_id, tf, token_count>>: the postings of a word in a range of chunks, with the best of their weights.

    A range is about ``size`` chunks, by a hash of their id, so a row holds few postings, and one of a word that all chunks hold no more than others.
    Postings move once, by range, chunk behind chunk. Each file is written in the order of words, so that a scan for some words skips the others' row groups.
    """
    stats = F.broadcast(index["stats"].select(F.col("chunk_count").alias("n"), F.greatest("avg_len", F.lit(1.0)).alias("avg_len")))
    ranged = index["terms"].crossJoin(stats).select("word", F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("n") / size)).alias("range"), "chunk_id", "tf", "token_count")
    # a word and its ranges lie in the partitions of the ranges, so grouping moves nothing
    rows = ranged.repartition("range").crossJoin(stats)
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("token_count") / F.col("avg_len")))
    blocks = rows.groupBy("word", "range").agg(F.max(weight).alias("best"), F.collect_list(F.struct("chunk_id", "tf", "token_count")).alias("postings"))
    return staged(blocks.sortWithinPartitions("word", "range"))


def token_count(chunks: DataFrame, analyzer: Analyzer = tokenize, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """chunk_id, token_count; 0 for a chunk without terms. No shuffle."""
    if getattr(analyzer, "words", None) is not None:
        return term_counts(chunks, analyzer, id_col, text_col).select("chunk_id", "token_count")
    return analyzed(chunks, analyzer, id_col, text_col).select("chunk_id", F.greatest(F.size("tokens"), F.lit(0)).alias("token_count"))


def lexeme_stats(terms: DataFrame) -> DataFrame:
    """word, ndoc."""
    return terms.groupBy("word").agg(F.count("*").alias("ndoc"))


def corpus_stats(counts: DataFrame) -> DataFrame:
    """One row: chunk_count, avg_len (0 for no chunks), from ``token_count``'s rows."""
    return counts.agg(F.count("*").alias("chunk_count"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("avg_len"))


def build_index(chunks: DataFrame, analyzer: Analyzer = tokenize, id_col: str = "id", text_col: str = "text") -> dict[str, DataFrame]:
    """terms, places, lexemes, stats. The analysis is written to the shared folder once; the tables are read from it."""
    counted = staged(term_counts(chunks, analyzer, id_col, text_col))
    terms = _postings(counted)
    return {"terms": terms, "places": _places(counted), "lexemes": lexeme_stats(terms), "stats": corpus_stats(counted.select("chunk_id", "token_count"))}


def refresh_stats(old_terms: DataFrame, old_lexemes: DataFrame, old_counts: DataFrame, new_chunks: DataFrame, replaced: DataFrame, analyzer: Analyzer = tokenize) -> dict[str, DataFrame]:
    """Index tables after the chunks of some documents were replaced.

    ``replaced(chunk_id)`` are the old chunks of these documents. Only they and the
    new ones are analysed; document frequencies change by signed counts. Equal to
    a full rebuild.
    """
    gone = old_terms.join(replaced, "chunk_id", "left_semi")
    added = chunk_terms(new_chunks, analyzer)
    terms = old_terms.join(replaced, "chunk_id", "left_anti").unionByName(added)
    delta = gone.select("word", F.lit(-1).cast("long").alias("ndoc")).unionByName(added.select("word", F.lit(1).cast("long").alias("ndoc")))
    lexemes = old_lexemes.unionByName(delta).groupBy("word").agg(F.sum("ndoc").alias("ndoc")).where("ndoc > 0")
    counts = old_counts.join(replaced, "chunk_id", "left_anti").unionByName(token_count(new_chunks, analyzer))
    return {"terms": terms, "lexemes": lexemes, "counts": counts, "stats": corpus_stats(counts)}


def corpus_report(documents: DataFrame) -> DataFrame:
    """Documents, chunks and words of each source type, and of all (null)."""
    return documents.rollup("source_type").agg(F.count("*").alias("docs"), F.sum("chunk_count").alias("chunks"), F.sum("words").alias("words"))


def chunks_per_document(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "title", "chunk_count").orderBy(F.desc("chunk_count"), "doc_id")


def skip_report(skipped: DataFrame) -> DataFrame:
    """reason, n: the reasons that name another file count as one."""
    reason = F.regexp_replace("reason", r"^(duplicate content) of .*$", "$1")
    return skipped.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def index_inventory(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, chunks, embedded of every document, zeros included."""
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.select("doc_id").join(per, "doc_id", "left").select("doc_id", zero("chunks"), zero("embedded"))


def index_health(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    docs = documents.agg(F.count("*").alias("documents"), F.max("ingested_at").alias("last_ingest"))
    have = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    return docs.crossJoin(F.broadcast(have)).select("documents", "chunks", "embedded", "last_ingest", F.when(F.col("embedded") > 0, "hybrid").otherwise("lexical-only").alias("mode"), (F.col("chunks") > 0).alias("ok"))
