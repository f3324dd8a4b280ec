"""Chat formatting by quotation linking, DataFrame operations only.

A line's quote level is the number of ``>`` marks in front of it. Neighbouring
lines of one level are a passage; a passage of level 1 or more is a quotation. A
message's own words are its lines of level 0: as a whole, and in paragraphs.
Quotations and own words are normalised (marks off, A-Z lower-cased, white space
collapsed), meet by hash, and count as linked only if the normalised texts are
equal. The original is the first message of the same conversation that says so
before the quoting one, else the first message of the other conversations.

A quotation that no message holds as a whole is linked by its parts: paragraphs
(parted by blank quoted lines), lines, and runs of two lines. Each part proposes its
first earlier message of the same conversation and the first one of the others;
the original is the message with the most linked lines, of equals one of the same
conversation, then the first.

Quotations are cut up first. Then all messages are cut up once, where they are
read, and only what has the hash of some quotation, or part of one, moves on.

A message replies to the original of its shallowest linked quotation (the first
of these). Replies are followed to the message that starts the thread by pointer
jumping, in rounds that double the distance; a round is a join by message. Messages
of several conversations may quote each other in a cycle: each message carries the
smallest one on its way, so after rounds for as many steps as there are messages the
smallest of a cycle has met itself, and it starts the thread (depth 0; its reply
stays named). The result is ordered by thread, then depth, then turn, with all
quoted lines removed.

Hot quotations and hot originals: originals are grouped by text with partial
aggregation, so a join always meets one row per text or per message, and no group
of equal texts is ever gathered; the many rows that meet one of these are the left
side of a left join, which adaptive execution splits.

Cases: a null or empty text is an empty message without quotes; a message of
quotes alone has an empty clean text; a quotation without an original stays
unlinked and is removed, too; a message never replies to itself or to a later
one of its conversation; a message with a null conversation or turn neither replies
nor is replied to; repeated rows of a message are each returned, and share
the first one's reply; an empty table gives an empty table; other columns are kept,
but for those with the names of results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import columns_of, drop_staged, row_of, staged

MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def _lines(text: Column) -> Column:
    """array<struct<level, words>> of a message."""
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[^>]", ""))
    marked = lambda line: F.struct(level(line).alias("level"), F.regexp_replace(line, MARKS, "").alias("words"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: F.when(F.contains(line, F.lit(">")), marked(line)).otherwise(F.struct(F.lit(0).alias("level"), line.alias("words"))))


def _bind(value: Column, body) -> Column:
    """An array expression ``body`` of a value that is computed once: the value is the element of a one-element array."""
    return F.flatten(F.transform(F.array(value), body))


def normalised(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lowered, r"[\x20\x09-\x0D]+", " "))


def _passages(text: Column) -> Column:
    """array<struct<level, words>>: neighbouring lines of one level, joined; an empty line of level 0 parts paragraphs."""
    blank = lambda line: (line["level"] == 0) & (F.trim(line["words"]) == "")

    def joined(lines: Column, starts: Column) -> Column:
        def passage(at: Column, k: Column) -> Column:
            size = F.coalesce(F.get(starts, k + 1), F.size(lines)) - at
            return F.struct(F.get(lines, at)["level"].alias("level"), F.array_join(F.transform(F.slice(lines, at + 1, size), lambda x: x["words"]), "\n").alias("words"))

        return F.filter(F.transform(starts, passage), lambda p: F.trim(p["words"]) != "")

    def parted(lines: Column) -> Column:
        begins = lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]) | blank(F.get(lines, i)) | blank(F.get(lines, i - 1))
        return _bind(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), begins), lambda starts: joined(lines, starts))

    return _bind(_lines(text), parted)


def _own_words(text: Column) -> Column:
    """The lines of level 0."""
    text = F.coalesce(text, F.lit(""))
    kept = F.array_join(F.transform(F.filter(_lines(text), lambda x: x["level"] == 0), lambda x: x["words"]), "\n")
    return F.when(F.contains(text, F.lit(">")), kept).otherwise(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def _own_places(text: Column) -> Column:
    """The text with every quoted line blank, so that quotations part paragraphs."""
    kept = F.array_join(F.transform(_lines(text), lambda x: F.when(x["level"] == 0, x["words"]).otherwise("")), "\n")
    return F.when(F.contains(text, F.lit(">")), kept).otherwise(text)


def _quotations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, at, level, raw: the passages of level 1 and more."""
    found = messages.where(F.contains("text", F.lit(">"))).select("conv_id", "turn", F.posexplode(_passages(F.col("text"))).alias("at", "p"))
    return found.select("conv_id", "turn", "at", F.col("p.level").alias("level"), F.col("p.words").alias("raw")).where("level > 0")


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, at, level, words: the passages of every message, in order."""
    found = messages.select("conv_id", "turn", F.posexplode(_passages(F.col("text"))).alias("at", "p"))
    return found.select("conv_id", "turn", "at", F.col("p.level").alias("level"), normalised(F.col("p.words")).alias("words")).where("words != ''")


#: Kinds of what a text is cut into. Wholes and paragraphs are said as wholes; lines, runs of two and longer paragraphs are parts.
WHOLE, PARAGRAPH, PART = 0, 1, 2


def _units(text: Column) -> Column:
    """array<struct<words, kind, lines>>: the whole, the paragraphs, lines and runs of two lines of a text, normalised; ``lines`` are the places of its lines."""
    lowered = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    folded = F.regexp_replace(lowered, r"[\x20\x09\x0B-\x0D]+", " ")

    def unit(words: Column, kind: int, lines: Column) -> Column:
        return F.struct(words.alias("words"), F.lit(kind).alias("kind"), lines.alias("lines"))

    def of(lines: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        blank = lambda i: F.coalesce(F.get(lines, i), F.lit("")) == ""
        starts = F.filter(places, lambda i: ~blank(i) & ((i == 0) | blank(i - 1)))
        ends = F.filter(places, lambda i: ~blank(i) & blank(i + 1))

        def paragraph(start: Column, end: Column) -> Column:
            return unit(F.array_join(F.slice(lines, start + 1, end - start + 1), " "), PARAGRAPH, F.sequence(start, end))

        def of_said(said: Column) -> Column:
            at = lambda k: F.get(lines, F.get(said, k))
            whole = F.array(unit(F.array_join(F.filter(lines, lambda w: w != ""), " "), WHOLE, said))
            single = F.transform(said, lambda i: unit(F.get(lines, i), PART, F.array(i)))
            pair = F.transform(F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0))), lambda i, k: unit(F.concat_ws(" ", F.get(lines, i), at(k + 1)), PART, F.array(i, F.get(said, k + 1))))
            return F.concat(whole, single, pair)

        return F.concat(_bind(F.filter(places, lambda i: ~blank(i)), of_said), F.zip_with(starts, ends, paragraph))

    return F.filter(_bind(F.transform(F.split(folded, "\n"), lambda x: F.trim(x)), of), lambda u: u["words"] != "")


def _met(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """``quoted`` with ``here``, the first earlier message of the same conversation that has the words, and ``there``, the first one of the others."""
    first_here = own.groupBy("h", "words", "conv_id").agg(F.min("turn").alias("first_turn"))
    first = first_here.groupBy("h", "words").agg(F.min(F.struct("conv_id", F.col("first_turn").alias("turn"))).alias("first"))
    # the first message outside the first one's conversation
    second = first_here.join(first, ["h", "words"]).where(F.col("conv_id") != F.col("first.conv_id")).groupBy("h", "words").agg(F.min(F.struct("conv_id", F.col("first_turn").alias("turn"))).alias("second"))
    met = quoted.join(first_here, ["h", "words", "conv_id"], "left").join(first, ["h", "words"], "left").join(second, ["h", "words"], "left")
    here = F.when(F.col("first_turn") < F.col("turn"), F.struct("conv_id", F.col("first_turn").alias("turn")))
    there = F.when(F.col("first.conv_id") == F.col("conv_id"), F.col("second")).otherwise(F.col("first"))
    return met.withColumns({"here": here, "there": there}).drop("first_turn", "first", "second")


def links(messages: DataFrame, broadcast_hashes: int = 1_000_000) -> DataFrame:
    """conv_id, turn, at, level, to_conv, to_turn: every linked quotation.

    Up to ``broadcast_hashes`` distinct hashes of quotations and their parts are broadcast; more are joined by shuffle.
    """
    messages = messages.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null and turn is not null")
    key, parts = ["conv_id", "turn", "at", "level"], (F.col("kind") == PART) | (F.col("kind") == PARAGRAPH) & (F.size("lines") > 2)
    quoted = staged(_quotations(messages).select(*key, F.inline(_units(F.col("raw")))).withColumn("h", F.xxhash64("words")))
    wanted = quoted.select("h").distinct()
    wanted = F.broadcast(wanted) if wanted.limit(broadcast_hashes + 1).count() <= broadcast_hashes else wanted
    own = messages.select("conv_id", "turn", F.inline(_units(_own_places(F.col("text"))))).withColumn("h", F.xxhash64("words")).join(wanted, "h", "left_semi")
    own = staged(own.select("conv_id", "turn", "h", "words", (F.col("kind") != PART).alias("as_whole"), parts.alias("as_part")))
    whole = staged(_met(quoted.where(F.col("kind") == WHOLE).drop("kind", "lines"), own.where("as_whole")).select(*key, F.coalesce("here", "there").alias("to")))
    # by parts: what has no whole match
    open_ = whole.where("to is null").select(*key).distinct()
    in_parts = quoted.where(parts).join(open_, key, "left_semi")
    proposed = _met(in_parts, own.where("as_part")).select(*key, "lines", F.explode(F.array("here", "there")).alias("to")).where("to is not null")
    lines = proposed.select(*key, "to", F.explode("lines").alias("line")).distinct().groupBy(*key, "to").agg(F.count("*").alias("n"))
    best = lines.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("n"), (F.col("to.conv_id") != F.col("conv_id")).alias("elsewhere"), "to")).alias("m")).select(*key, F.col("m.to").alias("to"))
    found = whole.where("to is not null").select(*key, "to").unionByName(best)
    return found.select(*key, F.col("to.conv_id").alias("to_conv"), F.col("to.turn").alias("to_turn"))


def _jump(replies: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """(me, to, depth, least, moved of every replying message after ``rounds`` at most, whether any still moves).

    ``to`` is up to 2 ** rounds replies away, and ``least`` the smallest message on the way there.
    """
    now, moving = staged(replies.select("me", "to", F.lit(1).cast("long").alias("depth"), F.col("to").alias("least"), F.lit(True).alias("moved"))), False
    for _ in range(rounds):
        up = now.select(F.col("me").alias("up"), F.col("to").alias("up_to"), F.col("depth").alias("up_depth"), F.col("least").alias("up_least"))
        on = F.col("up").isNotNull()
        lower = on & (F.col("up_least") < F.col("least"))
        new = staged(now.join(up, F.col("to") == F.col("up"), "left").select("me", F.when(on, F.col("up_to")).otherwise(F.col("to")).alias("to"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"), F.when(lower, F.col("up_least")).otherwise(F.col("least")).alias("least"), on.alias("moved")))
        drop_staged(now)
        now, moving = new, new.where("moved").limit(1).count() > 0
        if not moving:
            break
    return now, moving


def thread_starts(replies: DataFrame) -> DataFrame:
    """me, root, depth of every message that replies; ``replies(me, to)`` has one row of a message at most."""
    replies = staged(replies)
    rounds = replies.count().bit_length() + 1
    found, moving = _jump(replies, rounds)
    if not moving:
        return found.select("me", F.col("to").alias("root"), "depth")
    # only ways into cycles are still going
    smallest = staged(found.where("moved and me = least").select("me"))
    found, moving = _jump(replies.join(smallest, "me", "left_anti"), rounds)
    if moving:
        raise RuntimeError(f"replies without an end after {rounds} rounds")
    return found.select("me", F.col("to").alias("root"), "depth").unionByName(smallest.select("me", F.col("me").alias("root"), F.lit(0).cast("long").alias("depth")))


def conversations(messages: DataFrame) -> DataFrame:
    """The messages with n_quotes, max_level, reply_conv, reply_turn, root_conv, root_turn, depth, clean."""
    added = ["n_quotes", "max_level", "reply_conv", "reply_turn", "root_conv", "root_turn", "depth", "clean"]
    messages = messages.drop(*added)
    first = links(messages).groupBy("conv_id", "turn").agg(F.min(F.struct("level", "at", "to_conv", "to_turn")).alias("m"))
    replies = staged(first.select(F.struct("conv_id", "turn").alias("me"), F.struct(F.col("m.to_conv").alias("conv_id"), F.col("m.to_turn").alias("turn")).alias("to")).where("me != to"))
    reply = replies.join(thread_starts(replies), "me").select(F.col("me.conv_id").alias("conv"), F.col("me.turn").alias("no"), "to", "root", F.col("depth").alias("n"))
    levels = F.filter(F.transform(_passages(F.col("text")), lambda p: p["level"]), lambda n: n > 0)
    levels = F.when(F.contains("text", F.lit(">")), levels).otherwise(F.array().cast("array<int>"))
    given = messages.select(row_of(messages), F.col("conv_id").alias("c"), F.col("turn").alias("t"), levels.alias("levels"), F.trim(_own_words(F.col("text"))).alias("own"))
    out = given.join(reply, (F.col("c") == F.col("conv")) & (F.col("t") == F.col("no")), "left")
    return out.select(
        *columns_of(messages), F.size("levels").alias("n_quotes"), F.coalesce(F.array_max("levels"), F.lit(0)).alias("max_level"), F.col("to.conv_id").alias("reply_conv"), F.col("to.turn").alias("reply_turn"),
        F.coalesce("root.conv_id", "c").alias("root_conv"), F.coalesce("root.turn", "t").alias("root_turn"), F.coalesce("n", F.lit(0)).alias("depth"), F.col("own").alias("clean"),
    )


def reply_order(linked: DataFrame) -> DataFrame:
    """Threads in the order of their roots; in a thread by depth, then by conversation and turn."""
    return linked.orderBy("root_conv", "root_turn", "depth", "conv_id", "turn")


def digests(linked: DataFrame) -> DataFrame:
    return linked.select("conv_id", "turn", "role", "n_quotes", "max_level", "reply_conv", "reply_turn", "root_conv", "root_turn", "depth", F.octet_length("clean").cast("long").alias("clean_bytes"), F.sha2(F.col("clean").cast("binary"), 256).alias("clean_sha256"))
