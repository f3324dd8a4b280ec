"""The folds as Structured Streaming jobs. Order comes from the events' sequence,
so an event that arrives late never overwrites a newer value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions.text import word_count
from lectern.operators import chunking, corpus, folds, pages
from lectern.sources.staging import staged


def stream_leads(calls: DataFrame, watermark: str | None = None) -> DataFrame:
    """``merge_leads`` on a stream (update mode); state is one row per conversation, dropped behind the watermark if one is given."""
    cleaned = folds.clean_lead_fields(calls)
    if watermark:
        cleaned = cleaned.withWatermark("ts", watermark)
    return cleaned.groupBy("conversation_id").agg(*folds.lead_aggregates())


def stream_conversations(requests: DataFrame) -> DataFrame:
    return requests.groupBy("conversation_id").agg(*folds.conversation_aggregates())


def upsert_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for update mode: every micro-batch in a folder of its own, written again if the batch is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(rows: DataFrame, key: str = "conversation_id") -> DataFrame:
    """The current table of what ``upsert_to`` wrote."""
    value = F.struct(*[F.col(c) for c in rows.columns if c not in (key, "batch")])
    return rows.groupBy(key).agg(F.max_by(value, "batch").alias("v")).select(key, "v.*")


#: What an upload goes through; each is written before its work begins, so a crash leaves what was being done. It may end as failed or refused.
STAGES = ("queued", "extracting", "chunking", "embedding", "live")
ENDS = ("live", "failed", "refused")


def ingest_uploads(files: DataFrame, note: Callable[[DataFrame, str], None] = lambda rows, stage: None, embed: Callable[[list[str]], list[list[float]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of one batch of ``files(path, content, size_bytes, sha256)``: a document is taken whole or not at all.

    ``note`` is given the rows (sha256, path, and words or reason) that reach a stage, before its work. With ``embed``, chunks get vectors in batches.
    """
    named = files.withColumn("filename", F.regexp_replace("path", "^.*/", ""))
    good, bad = corpus.validate_upload(named)
    note(named, "queued")
    note(bad, "failed")
    note(good, "extracting")
    text = pages.extract_text(good.select("path", "content")).join(good.select("path", "sha256"), "path")
    ids = F.concat(F.lit("upload-"), F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 16))
    words = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + word_count(s["text"]))
    text = staged(text.withColumns({"doc_id": ids, "words": words}))
    note(text.where("error is not null").withColumn("reason", F.col("error")), "failed")
    read = text.where("error is null")
    note(read, "chunking")
    chunks = staged(chunking.chunk_documents(read.select("doc_id", "segments")))
    counted = read.drop("segments", "error").join(chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count")), "doc_id", "left")
    note(counted.where("chunk_count is null").withColumn("reason", F.lit("no chunks")), "failed")
    documents = counted.where("chunk_count is not null")
    note(documents, "embedding")
    chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    if embed is not None:
        pending = corpus.pending_embeddings(chunks).select("id", "body", "tokens")
        vectors = corpus.embed_batches(chunking.token_batches(pending), embed)
        chunks = chunks.drop("embedding").join(vectors, "id", "left")
    return documents, chunks


def stream_uploads(files: DataFrame, place: str, checkpoint: str, embed: Callable[[list[str]], list[list[float]]] | None = None, arrived: str = "arrived", remember: str = "30 days"):
    """Uploads from bytes to live documents. Below ``place``: ``documents`` and ``chunks`` of each micro-batch and ``log``, what reached which stage.

    Equal bytes that arrive within ``remember`` of each other, by the time in ``arrived``, are taken once, and no longer remembered for that; later ones are refused
    if their document is live. A micro-batch that is run again replaces its own output, and its documents count from
    when its last stage is written, so a restart in the middle gives each upload once.
    """
    unique = files.withColumn("sha256", F.sha2("content", 256)).withWatermark(arrived, remember).dropDuplicatesWithinWatermark(["sha256"])

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        step = 0

        def note(rows: DataFrame, stage: str) -> None:
            nonlocal step
            kinds = {"sha256": "string", "path": "string", "reason": "string", "words": "long", "chunk_count": "long"}
            own = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
            rows.select(*own, F.lit(stage).alias("status"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{place}/log/batch={number}/step={step}")
            step += 1

        batch = staged(batch)
        known = live_uploads(spark, place)
        if known is not None:
            known = known.where(F.col("batch") != number).select("sha256").distinct()
            note(batch.join(known, "sha256", "left_semi").withColumn("reason", F.lit("already uploaded")), "refused")
            batch = batch.join(known, "sha256", "left_anti")
        documents, chunks = ingest_uploads(batch, note, embed)
        documents.write.mode("overwrite").parquet(f"{place}/documents/batch={number}")
        chunks.write.mode("overwrite").parquet(f"{place}/chunks/batch={number}")
        note(documents, "live")

    return unique.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upload_log(spark: SparkSession, place: str) -> DataFrame | None:
    """sha256, path, reason, words, chunk_count, status, step, at, batch of every stage that was reached; None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/log")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(f"{place}/log")


def live_uploads(spark: SparkSession, place: str) -> DataFrame | None:
    """The log's rows of uploads that are live."""
    log = upload_log(spark, place)
    return None if log is None else log.where("status = 'live'")


def live_chunks(spark: SparkSession, place: str) -> DataFrame:
    """The chunks of the documents that are live; those of a batch that has not ended are not shown."""
    documents = spark.read.parquet(f"{place}/documents").join(live_uploads(spark, place).select("sha256", "batch"), ["sha256", "batch"], "left_semi")
    return spark.read.parquet(f"{place}/chunks").join(documents.select("doc_id", "batch"), ["doc_id", "batch"], "left_semi")


def upload_statuses(log: DataFrame) -> DataFrame:
    """sha256, status, reason, words, chunk_count, path, stages (all, in order) of every upload, as its last batch left it."""
    last = log.groupBy("sha256", "batch").agg(F.max_by(F.struct("status", "reason", "path"), "step").alias("v"), F.max("words").alias("words"), F.max("chunk_count").alias("chunk_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "status"))), lambda x: x["status"]), ">").alias("stages"))
    return last.groupBy("sha256").agg(F.max_by(F.struct("v", "words", "chunk_count", "stages"), "batch").alias("w")).select("sha256", "w.v.*", "w.words", "w.chunk_count", "w.stages")


WATCHED = "status string, since timestamp, stuck boolean"


def watch_uploads(log: DataFrame, patience_ms: int = 600_000) -> DataFrame:
    """sha256, status, since, stuck of a stream of the log: where each upload is, and, by a timer, those that have not moved for ``patience_ms``.

    State is the last stage of the uploads that are under way; one that ended or was reported stuck is forgotten.
    """

    def follow(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, since = state.get
            state.remove()
            yield pd.DataFrame({"sha256": [key[0]], "status": [status], "since": [pd.Timestamp(since, unit="us")], "stuck": [True]})
            return
        status, since = state.get if state.exists else ("", 0)
        rank = lambda s: len(STAGES) if s in ENDS else STAGES.index(s) if s in STAGES else -1
        for part in rows:
            for s, at in zip(part["status"], part["at"], strict=True):
                if rank(s) >= rank(status):
                    status, since = s, int(pd.Timestamp(at).value // 1000)
        if status in ENDS:
            if state.exists:
                state.remove()
        else:
            state.update((status, since))
            state.setTimeoutDuration(patience_ms)
        yield pd.DataFrame({"sha256": [key[0]], "status": [status], "since": [pd.Timestamp(since, unit="us")], "stuck": [False]})

    return log.select("sha256", "status", "at").groupBy("sha256").applyInPandasWithState(follow, f"sha256 string, {WATCHED}", "status string, since long", "update", GroupStateTimeout.ProcessingTimeTimeout)
