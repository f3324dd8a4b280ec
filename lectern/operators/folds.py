"""Event logs folded into current tables: leads, escalations, conversations,
versions, uploads. Folds are combining aggregates (max_by on the event's
sequence), so a key of very many events is folded where it is read and no key
is buffered; the same aggregates run as streams. What looks back is a segmented scan over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import trim_all
from lectern.sources.staging import staged

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
LEAD_FIELDS = ["name", "email", "company", "interest", "booking_route", "source_url"]


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(trim_all(c), F.lit(""))


def clean_lead_fields(calls: DataFrame) -> DataFrame:
    """Trimmed fields, blanks as nulls; an invalid address is null, with a message."""
    out = calls.withColumns({f: blank_to_null(f) for f in LEAD_FIELDS if f in calls.columns})
    valid = F.col("email").rlike(EMAIL)
    note = F.when(F.col("email").isNotNull() & ~valid, F.concat(F.lit('Saved, but "'), "email", F.lit('" is not a valid email address'))).otherwise("Saved.")
    return out.withColumn("message", note).withColumn("email", F.when(valid, F.col("email")))


def lead_aggregates(seq: str = "seq") -> list[Column]:
    """Each field's latest value that is not null; shared by batch and stream."""
    return [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in LEAD_FIELDS] + [F.min("ts").alias("created_at")]


def merge_leads(calls: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per conversation; the id is a hash of it."""
    return calls.groupBy("conversation_id").agg(*lead_aggregates(seq)).withColumn("id", F.sha2(F.col("conversation_id").cast("string").cast("binary"), 256))


def mirror_state(lead_events: DataFrame, mirror_events: DataFrame) -> DataFrame:
    """conversation_id, mirror_status, mirror_error, mirrored_at.

    The last outcome counts; a save after a success asks for another mirroring, one
    after a failure leaves it failed.
    """
    saves = lead_events.groupBy("conversation_id").agg(F.max("seq").alias("saved"))
    outcome = mirror_events.groupBy("conversation_id").agg(F.max("seq").alias("done"), F.max_by("ok", "seq").alias("ok"), F.max_by("error", "seq").alias("error"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("mirrored_at"))
    j = saves.join(outcome, "conversation_id", "left")
    status = F.when(F.col("done").isNull(), "pending").when(~F.col("ok"), "failed").when(F.col("saved") > F.col("done"), "pending").otherwise("synced")
    return j.select("conversation_id", status.alias("mirror_status"), F.when(F.col("ok") == F.lit(False), F.coalesce("error", F.lit("unknown"))).alias("mirror_error"), "mirrored_at")


def mirror_backlog(leads: DataFrame) -> DataFrame:
    """What is not mirrored yet, oldest first, in the sheet's eight columns."""
    shown = ["created_at", "name", "email", "company", "interest", "booking_route", "source_url", "conversation_id"]
    return leads.where("mirror_status <> 'synced'").orderBy("created_at", "conversation_id").select(*shown)


def build_escalations(requests: DataFrame, leads: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per ``requests(conversation_id, seq, question, context, reason)`` with transcript and lead.

    A missing question is the conversation's last user turn, else ``(not stated)``.
    """
    said = turns.groupBy("conversation_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "role", "content"))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("transcript"), F.max_by("content", F.when(F.col("role") == "user", F.col("seq"))).alias("last_user"))
    known = leads.where("email is not null or name is not null").select("conversation_id", F.col("id").alias("lead_id"))
    j = requests.join(said, "conversation_id", "left").join(known, "conversation_id", "left")
    question = F.coalesce(blank_to_null("question"), "last_user", F.lit("(not stated)"))
    return j.select(F.sha2(F.concat_ws("#", F.col("conversation_id").cast("string"), F.col("seq").cast("string")).cast("binary"), 256).alias("id"), "conversation_id", question.alias("question"), "context", "reason", "transcript", "lead_id")


def escalation_backlog(escalations: DataFrame, leads: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest escalations not sent, with their lead or a null one."""
    lead = leads.select(F.col("id").alias("lead_id"), F.struct("name", "email", "company", "interest").alias("lead"))
    oldest = escalations.where("email_status <> 'sent'").orderBy("created_at", "id").limit(limit)
    return oldest.join(lead, "lead_id", "left").orderBy("created_at", "id")


def render_escalation(escalations: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """id, subject, body: a plain-text digest."""
    why = F.coalesce(F.element_at(F.create_map(*[x for k, v in reasons.items() for x in (F.lit(k), F.lit(v))]), F.col("reason")), "reason")
    contact = F.coalesce(F.nullif(F.concat_ws(", ", "lead.name", "lead.email", "lead.company"), F.lit("")), F.lit("not given"))
    said = F.array_join(F.transform("transcript", lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    body = F.concat_ws("\n", F.concat(F.lit("Why: "), why), F.concat(F.lit("Question: "), "question"), F.concat(F.lit("Contact: "), contact), F.concat(F.lit("Context: "), "context"), F.lit(""), F.lit("Transcript"), said)
    return escalations.select("id", F.concat(F.lit("Question: "), F.substring(F.regexp_replace("question", "[\r\n]+", " "), 1, 60)).alias("subject"), body.alias("body"))


def conversation_aggregates() -> list[Column]:
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    return [F.min("ts").alias("started_at"), F.max("ts").alias("last_seen_at"), first("source_url"), first("user_agent")]


def upsert_conversations(requests: DataFrame) -> DataFrame:
    return requests.groupBy("conversation_id").agg(*conversation_aggregates())


def append_turns(exchanges: DataFrame) -> DataFrame:
    """A user row and an assistant row per exchange; only the latter has a verdict."""
    user = F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(None).cast("boolean").alias("grounded"))
    reply = F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("grounded").alias("grounded"))
    return exchanges.select("conversation_id", "seq", F.inline(F.array(user, reply))).select("conversation_id", (F.col("seq") * 2 + F.col("k")).alias("seq"), "role", "content", "grounded")


def resolve_route(df: DataFrame, routes: DataFrame, fallback: str = "general") -> DataFrame:
    """route and url of each row; an unknown route is the fallback."""
    known = routes.select("route", "url")
    other = known.where(F.col("route") == fallback).select(F.col("url").alias("_url"))
    # the fallback is one row
    j = df.withColumn("route", F.coalesce(blank_to_null("route"), F.lit(fallback))).join(known, "route", "left").join(F.broadcast(other.limit(1)), F.lit(True), "left")
    return j.withColumn("route", F.when(F.col("url").isNull(), fallback).otherwise(F.col("route"))).withColumn("url", F.coalesce("url", "_url")).drop("_url")


def previous_values(events: DataFrame, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """``events`` with ``_previous``, the value of the key's row before (null for its first, or if that is null).

    A segmented scan: rows are ranged by key and place, and written, so a key of very many rows spreads over ranges; each
    range looks back within itself, and its first row to the last one of the range before, of which there is one row a range.
    """
    ranged = staged(events.repartitionByRange(key, seq).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range").orderBy(key, seq)
    last = ranged.groupBy("_range").agg(F.max(F.struct(F.col(key).alias("k"), F.col(seq).alias("s"), F.col(value).alias("v"))).alias("last"))
    # one row a range
    border = last.select("_range", F.lag("last").over(Window.orderBy("_range")).alias("_before"))
    back = F.lag(F.struct(F.col(key).alias("k"), F.col(seq).alias("s"), F.col(value).alias("v"))).over(own)
    seen = ranged.withColumn("_back", back).join(F.broadcast(border), "_range")
    before = F.coalesce("_back", "_before")
    return seen.withColumn("_previous", F.when(before["k"] == F.col(key), before["v"])).select(*[F.col(f"`{c}`") for c in events.columns], "_previous")


def version_trail(edits: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """key, seq, ts, value, who: the value that each edit replaced, of edits that change it.

    A null value is a reset: the default is back and no version is written.
    """
    default = F.lit("")
    seen = previous_values(edits.select("key", "seq", "ts", "value", "who"))
    if defaults is not None:
        seen = seen.join(defaults.select("key", F.col("value").alias("_default")), "key", "left")
        default = F.coalesce("_default", F.lit(""))
    seen = seen.withColumn("_previous", F.coalesce("_previous", default))
    out = seen.where(F.col("value").isNotNull() & (F.col("value") != F.col("_previous")))
    return out.select("key", "seq", "ts", F.col("_previous").alias("value"), "who")


def newest_versions(versions: DataFrame, n: int, at: str = "ts", ident: str = "seq") -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc(at), F.desc(ident))
    return versions.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def prune_versions(versions: DataFrame, keep: int = 50, **columns) -> DataFrame:
    return newest_versions(versions, keep, **columns)


def list_versions(versions: DataFrame, limit: int = 20, **columns) -> DataFrame:
    return newest_versions(versions, limit, **columns).orderBy("key", F.desc(columns.get("at", "ts")))


def restore_versions(edits: DataFrame, versions: DataFrame, restores: DataFrame) -> DataFrame:
    """``edits`` with an edit per ``restores(version_seq, key, seq, ts, who)`` that brings an old value back."""
    old = versions.select("key", F.col("seq").alias("version_seq"), "value")
    new = restores.join(old, ["key", "version_seq"]).select("key", "seq", "ts", "value", "who", F.col("version_seq").alias("restored_from"))
    return edits.unionByName(new, allowMissingColumns=True)


def current_settings(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """key, value, is_default of the known keys."""
    stored = settings.select("key", F.col("value").alias("_v"))
    return defaults.join(stored, "key", "left").select("key", F.coalesce("_v", "value").alias("value"), F.col("_v").isNull().alias("is_default"))


def upload_status(events: DataFrame) -> DataFrame:
    """upload_id, status, error, doc_id after the last event of each upload."""
    last = events.groupBy("upload_id").agg(F.max_by(F.struct("status", "error", "doc_id"), "seq").alias("s"))
    return last.select("upload_id", "s.*")


def list_materials(uploads: DataFrame) -> DataFrame:
    """Live downloads by display name, else by file name without its extension."""
    name = F.coalesce(blank_to_null("display_name"), F.regexp_replace("filename", r"\.[^.]+$", ""))
    return uploads.where("downloadable and status = 'live'").select("id", name.alias("name"), "media_type", "size_bytes", F.coalesce("display_name", "filename").alias("_o")).orderBy("_o", "id").drop("_o")


def download_counts(downloads: DataFrame, uploads: DataFrame) -> DataFrame:
    live = uploads.where("downloadable and status = 'live'").select(F.col("id").alias("upload_id"))
    return downloads.join(live, "upload_id", "left_semi").groupBy("upload_id").agg(F.count("*").alias("downloads"))
