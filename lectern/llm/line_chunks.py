"""Line dedup by content-defined chunks of lines, DataFrame operations only.

Each line is hashed, and a rolling hash is taken over the last ``window`` line hashes of
every line (before the first line, zeros). A boundary stands behind a line whose rolling hash is the least among its
neighbours, ``least_lines`` - 1 on each side, and that is not nearer than ``least_lines`` to
either end of the text. So boundaries depend on the lines around them only, a passage that
moves within or between documents is cut alike, and no chunk has fewer lines than ``least_lines`` unless the text has.
Of chunks of ``least_lines`` lines or more that occur again anywhere, the first (by doc_id,
then text hash, then place) stays, and the others are removed.

Chunks are equal only if all their bytes are: they are grouped by hash and bytes, with
partial aggregation, so that a chunk of many copies is summed where it is read. A hash that one chunk alone has, as this
grouping of all chunks shows, then stands for its bytes; chunks that share a hash are looked up by hash and bytes.

Time is linear in the lines of a text: hashes, boundaries and chunks are each made once, and
what remains is a difference of two sets of places.

Cases: a null or empty text, and any of one line, is never removed; lines end at
newlines; repeated rows keep their chunks in one of them; all rows of a repeated
id and text are counted by their other columns, and the first by these keeps the text;
an empty table gives an empty table; other columns are kept, but for those with the names
of results, which are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import columns_of, row_of, staged, with_class


def _bind(value: Column, body) -> Column:
    """An array expression ``body`` of a value that is computed once: the value is the element of a one-element array."""
    return F.flatten(F.transform(F.array(value), body))


def chunks_of(text: Column, window: int = 2, least_lines: int = 2) -> Column:
    """array<struct<n_lines, chunk>> of a text; the chunks joined by newlines are the text."""
    near = range(1, max(2, least_lines))

    def cut(rolling: Column, n: Column, i: Column) -> Column:
        """Whether a boundary stands behind the i-th line, from 1."""
        own = F.get(rolling, i - 1)
        less = [own < F.get(rolling, i - 1 - d) for d in near] + [own <= F.get(rolling, i - 1 + d) for d in near]
        return (i >= least_lines) & (i <= n - least_lines) & reduce(Column.__and__, [F.coalesce(x, F.lit(True)) for x in less])

    def from_ends(lines: Column, ends: Column) -> Column:
        def chunk(e: Column, k: Column) -> Column:
            before = F.when(k == 0, 0).otherwise(F.get(ends, k - 1))
            return F.struct((e - before).alias("n_lines"), F.array_join(F.slice(lines, before + 1, e - before), "\n").alias("chunk"))

        return F.transform(ends, chunk)

    def from_rolling(lines: Column, rolling: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == F.size(lines)) | cut(rolling, F.size(lines), i))
        return _bind(ends, lambda e: from_ends(lines, e))

    def from_hashes(lines: Column, hashes: Column) -> Column:
        last = lambda i: F.xxhash64(*[F.coalesce(F.get(hashes, i - d), F.lit(0).cast("long")) for d in reversed(range(window))])
        return _bind(F.transform(hashes, lambda _, i: last(i)), lambda rolling: from_rolling(lines, rolling))

    return _bind(F.split(text, "\n"), lambda lines: _bind(F.transform(lines, lambda x: F.xxhash64(x)), lambda hashes: from_hashes(lines, hashes)))


def hash_of(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def repeats(docs: DataFrame, window: int = 2, least_lines: int = 2) -> DataFrame:
    """doc_id, text_hash, at, rows, is_first: the repeated chunks, with how many equal rows hold them, and whether this occurrence stays."""
    key = ["doc_id", "text_hash"]
    cut = chunks_of(F.coalesce("text", F.lit("")), window, least_lines)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(cut).alias("at", "c")).where(F.col("c.n_lines") >= max(2, least_lines))
    rows = rows.select(*key, "at", hash_of(F.col("c.chunk")).alias("h"), F.col("c.chunk").alias("chunk"))
    # grouped by bytes: equal hashes of unequal chunks stay apart
    classes = rows.groupBy("h", "chunk").agg(F.count("*").alias("n"), F.min(F.struct(*key, "at")).alias("first"))
    hashes = staged(classes.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1"))
    # a chunk that a thousandth of all repeated ones are copies of meets them by broadcast
    marked = with_class(rows.select(*key, "at", "h"), hashes.where("kinds = 1").select("h", "n", "first"), ["h"], "n").select(*key, "at", "first")
    shared = hashes.where("kinds > 1").select("h")
    if not shared.isEmpty():
        apart = classes.where("n > 1").join(shared, "h", "left_semi").select("h", "chunk", "first")
        marked = marked.unionByName(rows.join(shared, "h", "left_semi").join(apart, ["h", "chunk"]).select(*key, "at", "first"))
    return marked.select(*key, "at", F.col("first").eqNullSafe(F.struct(*key, "at")).alias("is_first")).groupBy(*key, "at").agg(F.count("*").alias("rows"), F.max("is_first").alias("is_first"))


def drop_repeated_chunks(docs: DataFrame, window: int = 2, least_lines: int = 2) -> DataFrame:
    """``docs`` with the remaining text in ``text``, and n_lines, n_chunks, removed_chunks, removed_lines.

    A text of which nothing remains becomes empty.
    """
    added = ["n_lines", "n_chunks", "removed_chunks", "removed_lines"]
    docs = docs.drop(*added)
    found = repeats(docs, window, least_lines).groupBy("doc_id", "text_hash").agg(F.collect_list(F.when(~F.col("is_first"), F.col("at"))).alias("gone"), F.collect_list(F.when(F.col("is_first"), F.col("at"))).alias("once"), F.max("rows").alias("rows"))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "gone", "once", "rows")
    # the text moves once, in its row
    given, given_text = docs.select(row_of(docs), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")), F.col("given.text")
    match = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("hash") == F.col("f_hash"))
    alone = given.join(found, match, "left").where("rows is null or rows = 1").select("given", F.coalesce("gone", F.array().cast("array<int>")).alias("drop"))
    # rows of one id and text: equal ones are counted, and one of the first by all columns keeps the first occurrences
    twins = given.join(found.where("rows > 1"), match).withColumn("order", F.sha2(F.to_json("given").cast("binary"), 256))
    twins = twins.groupBy("id", "hash", "order").agg(F.first("given").alias("given"), F.first("gone").alias("gone"), F.first("once").alias("once"), F.count("*").alias("copies"))
    least = twins.groupBy(F.col("id").alias("l_id"), F.col("hash").alias("l_hash")).agg(F.min("order").alias("least"))
    twins = twins.join(least, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("hash") == F.col("l_hash")))
    twins = twins.select("given", "gone", "once", (F.col("order") == F.col("least")).alias("leads"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"))
    again = twins.select("given", F.when(F.col("leads") & (F.col("nth") == 1), F.col("gone")).otherwise(F.concat("gone", "once")).alias("drop"))
    chunked = alone.unionByName(again).select("given", "drop", chunks_of(F.coalesce(given_text, F.lit("")), window, least_lines).alias("chunks"))
    places = F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), F.col("drop"))
    kept = F.when(F.size("drop") == 0, F.col("chunks")).otherwise(F.transform(places, lambda i: F.get(F.col("chunks"), i)))
    chunked = chunked.select("given", "drop", "chunks", kept.alias("kept"))
    lines = lambda chunks: F.aggregate(chunks, F.lit(0), lambda a, c: a + c["n_lines"]).cast("long")
    text = F.when(F.size("drop") == 0, given_text).otherwise(F.array_join(F.transform("kept", lambda c: c["chunk"]), "\n"))
    made = chunked.select(
        "given", text.alias("remaining"), lines(F.col("chunks")).alias("n_lines"), F.size("chunks").cast("long").alias("n_chunks"), (F.size("chunks") - F.size("kept")).cast("long").alias("removed_chunks"),
        (lines(F.col("chunks")) - lines(F.col("kept"))).alias("removed_lines"),
    )
    return made.select(*columns_of(docs, text=F.col("remaining")), *added)


def digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
