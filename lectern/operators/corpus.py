"""Corpus policy, exclusions, embedding upkeep, set operations and website sync."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import any_of, estimate_tokens, text_md5, word_count
from lectern.operators import chunking, grounding, index, pages
from lectern.operators.dedup import THRESHOLD, drop_exact_duplicates, drop_near_duplicates
from lectern.sources.staging import staged

EXTENSIONS = ("pdf", "docx", "pptx", "txt", "md")
LARGEST = 25 * 1024 * 1024


def drop_confidential(files: DataFrame, patterns: Iterable[str], col: str = "path") -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): paths that meet a deny-list never reach extraction."""
    hit = F.coalesce(F.col(col).rlike(f"(?i){any_of(patterns)}"), F.lit(False))
    return files.where(~hit), files.where(hit).withColumn("reason", F.lit("confidential"))


def apply_source_policy(files: DataFrame, allow: DataFrame, excluded_archives: DataFrame, confidential: Iterable[str], unsupported: Iterable[str] = (".xlsx", ".doc", ".png", ".jpg", ".jpeg"), root_duplicates: DataFrame | None = None) -> DataFrame:
    """``files(stage, archive_no, archive, path, sha256)`` with disposition and reason.

    ``allow(path)`` lists files that are read in full, ``excluded_archives(archive,
    why)`` archives that are left out whole, ``root_duplicates(archive, folder)``
    archives whose members outside the folder are copies. The steps in order:
    excluded archive, confidential path, copy at an archive's root, exact copy of a
    file before, full text, unsupported (named in the catalog), catalog. A
    top-level file that is not listed is ignored.
    """
    j = files.join(allow.select("path").distinct().withColumn("_listed", F.lit(True)), "path", "left").join(excluded_archives.select("archive", F.col("why").alias("_why")), "archive", "left")
    if root_duplicates is not None:
        j = j.join(root_duplicates.select("archive", F.col("folder").alias("_folder")), "archive", "left")
    else:
        j = j.withColumn("_folder", F.lit(None).cast("string"))
    secret = F.coalesce(F.col("path").rlike(f"(?i){any_of(confidential)}"), F.lit(False))
    early = (
        F.when(F.col("_why").isNotNull(), F.struct(F.lit("excluded_archive").alias("d"), F.col("_why").alias("r"))).when(secret, F.struct(F.lit("confidential").alias("d"), F.lit("confidential").alias("r")))
        .when(F.col("_folder").isNotNull() & ~F.col("path").startswith(F.col("_folder")), F.struct(F.lit("root_duplicate").alias("d"), F.lit("duplicate at the archive's root").alias("r")))
        .when(F.col("archive").isNull() & F.col("_listed").isNull(), F.struct(F.lit("ignored").alias("d"), F.lit(None).cast("string").alias("r")))
    )
    j = j.withColumn("_early", early)
    order = ["stage", "archive_no", "path"]
    live = j.where("_early is null")
    kept, copies = drop_exact_duplicates(live, "sha256", order, "path")
    ext = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    late = F.when(F.col("_listed"), F.lit("full_text")).when(ext.isin([*unsupported]), F.lit("unsupported")).otherwise(F.lit("catalog"))
    base = files.columns
    return (
        j.where("_early is not null").select(*base, F.col("_early.d").alias("disposition"), F.col("_early.r").alias("reason"))
        .unionByName(copies.select(*base, F.lit("exact_duplicate").alias("disposition"), "reason"))
        .unionByName(kept.select(*base, late.alias("disposition"), F.when(late == "unsupported", F.concat(F.lit("unsupported format "), ext)).alias("reason")))
    )


def apply_draft_policy(files: DataFrame, confidential: Iterable[str], threshold: float = THRESHOLD, seen: DataFrame | None = None) -> DataFrame:
    """``files(archive, archive_no, path, sha256, text, error)`` of archives that hold drafts, with disposition and reason.

    The steps in order: confidential path, exact copy (of ``seen(sha256, label)``, what stands in the corpus
    already, or of a file before), failed extraction, draft of a longer or earlier text of its archive, full text.
    A file's label is its archive and path.
    """
    label = F.concat_ws(":", "archive", "path")
    base = files.columns
    open_, secret = drop_confidential(files, confidential)
    known = seen.groupBy("sha256").agg(F.min("label").alias("_seen")) if seen is not None else files.select("sha256", F.lit(None).cast("string").alias("_seen")).limit(0)
    named = open_.withColumn("_label", label).join(known, "sha256", "left")
    kept, copies = drop_exact_duplicates(named.where("_seen is null"), "sha256", ["archive_no", "path"], "_label")
    readable = staged(kept.where("error is null"))
    _, drafts = drop_near_duplicates(readable, threshold, key="_label", by=["archive"])
    drafts = drafts.select(F.col("kept").alias("_kept"), F.col("dropped").alias("_label"), F.regexp_replace(F.col("similarity").cast("string"), "[.]0$", "").alias("_alike"))
    marked = readable.join(drafts, "_label", "left")
    draft = F.concat(F.lit('near-duplicate draft of "'), F.regexp_replace("_kept", "^.*[:/]", ""), F.lit('" (jaccard '), "_alike", F.lit(")"))
    row = lambda rows, what, why: rows.select(*base, F.lit(what).alias("disposition") if isinstance(what, str) else what.alias("disposition"), why.alias("reason"))
    return (
        row(secret, "confidential", F.lit("confidential"))
        .unionByName(row(named.where("_seen is not null"), "exact_duplicate", F.concat(F.lit("duplicate content of "), "_seen")))
        .unionByName(row(copies, "exact_duplicate", F.col("reason")))
        .unionByName(row(kept.where("error is not null"), "extraction_failed", F.concat(F.lit("extraction failed: "), "error")))
        .unionByName(row(marked, F.when(F.col("_kept").isNull(), "full_text").otherwise("near_duplicate"), draft))
    )


def drop_excluded(documents: DataFrame, chunks: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removed documents stay removed, and their chunks go, too."""
    kept = documents.join(excluded.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept, chunks.join(kept.select("doc_id"), "doc_id", "left_semi")


def fold_exclusions(excluded: DataFrame, commands: DataFrame) -> DataFrame:
    """The exclusion list after ``commands(doc_id, seq, action, title, reason)``: the last one per document counts; a title once known stays."""
    before = excluded.select("doc_id", F.lit(-1).cast("long").alias("seq"), F.lit("exclude").alias("action"), "title", "reason")
    rows = before.unionByName(commands.select("doc_id", F.col("seq").cast("long").alias("seq"), "action", "title", "reason"))
    last = rows.groupBy("doc_id").agg(F.max_by("action", "seq").alias("action"), F.max_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("title"), F.max_by("reason", "seq").alias("reason"))
    return last.where("action = 'exclude'").select("doc_id", "title", "reason")


def validate_upload(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    ext = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    reason = F.when(~ext.isin(*EXTENSIONS), F.concat(F.lit("unsupported type "), ext)).when(F.col("size_bytes") > LARGEST, "larger than 25 MB").when(F.col("size_bytes") <= 0, "empty")
    marked = uploads.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def validate_messages(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad with reason) of ``requests(conversation_id, message, history, source_url)``."""
    uuid = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    size = F.coalesce(F.length("message"), F.lit(0))
    item_ok = F.forall("history", lambda h: h["role"].isin("user", "assistant") & (F.length(h["content"]) <= 8000))
    reason = (
        F.when((size < 1) | (size > 2000), "message length").when(F.size("history") > 40, "history length").when(~F.coalesce(item_ok, F.lit(True)), "history item")
        .when(~F.coalesce(F.col("conversation_id").rlike(uuid), F.lit(False)), "conversation id").when(F.length("source_url") > 500, "source url")
    )
    marked = requests.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def carry_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new(id, text, ...)`` with the old vector where id and text are unchanged.

    Vectors are wide, so ids and digests are joined first and only the vectors that
    are carried over move.
    """
    same = new.select("id", text_md5("text").alias("m")).join(old.where("embedding is not null").select("id", text_md5("text").alias("m")), ["id", "m"]).select("id").distinct()
    vectors = old.select("id", "embedding").join(same, "id", "left_semi").dropDuplicates(["id"])
    return new.drop("embedding").join(vectors, "id", "left")


def pending_embeddings(chunks: DataFrame) -> DataFrame:
    """id, body, tokens of the chunks without a vector."""
    body = F.concat_ws("\n\n", F.nullif("heading", F.lit("")), "text")
    return chunks.where("embedding is null").select("id", body.alias("body")).withColumn("tokens", estimate_tokens("body"))


def embed_batches(batched: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """id, embedding: the caller's function is applied to each batch of ``batched(id, body, batch)``, whose rows one task gets in the order of their ids."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        at = None

        def flush():
            vectors = embed([b for _, b in held])
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.string()), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "embedding"])

        for b in rows:
            for i, body, n in zip(*(b.column(c).to_pylist() for c in ("id", "body", "batch")), strict=True):
                if held and n != at:
                    yield flush()
                    held = []
                at = n
                held.append((i, body))
        if held:
            yield flush()

    rows = batched.select(F.col("id").cast("string").alias("id"), "body", "batch").repartition("batch").sortWithinPartitions("batch", "id")
    return rows.mapInArrow(run, "id string, embedding array<float>")


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def missing_pages(expected: DataFrame, got: DataFrame, path: str = "path") -> DataFrame:
    return expected.select(path).join(got.select(path), path, "left_anti")


def scoped_replace(old: DataFrame, new: DataFrame, keep: str = "upload-%", also: Iterable[str] = ()) -> DataFrame:
    """Replace all documents but uploads and the listed ones."""
    own = F.col("doc_id").like(keep) | F.col("doc_id").isin([*also])
    return old.where(own).unionByName(new, allowMissingColumns=True)


def chunk_pages(cleaned: DataFrame, doc_id: str) -> DataFrame:
    return chunking.chunk_documents(cleaned.select(F.col(doc_id).cast("string").alias("doc_id"), chunking.flat_segments("text").alias("segments")))


def sync_website(old_chunks: DataFrame, new_pages: DataFrame, site: str = "site", doc_id: str = "doc_id", expected: DataFrame | None = None, note: DataFrame | None = None) -> dict[str, DataFrame]:
    """Replace the website slice, and the documents of ``note(doc_id, title, text)`` if it could be read.

    Pages to text, boilerplate off, chunks, vectors carried over where id and text are unchanged, statistics
    rebuilt. Returns chunks, documents (one row of each page or note that has chunks), the index's tables, cohorts,
    counts(pages, chunks, carried, pending, note) and, with ``expected``, the pages that are missing. Refuses a crawl without pages.
    """
    if new_pages.isEmpty():
        raise ValueError("no pages: the index stays as it is")
    cleaned = pages.strip_shared_boilerplate(pages.html_to_text(new_pages), site)
    url = F.col("url") if "url" in cleaned.columns else F.col(doc_id).cast("string")
    sources = cleaned.select(F.col(doc_id).cast("string").alias("doc_id"), "title", url.alias("origin"), F.lit("website").alias("source_type"), F.lit("html").alias("format"), "text")
    rest = old_chunks.where("source_type <> 'website'")
    if note is not None:
        sources = sources.unionByName(note.select(F.col("doc_id").cast("string").alias("doc_id"), "title", F.col("title").alias("origin"), F.lit("correction").alias("source_type"), F.lit("note").alias("format"), "text"))
        rest = rest.join(note.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_anti")
    sources = staged(sources)
    fresh = carry_embeddings(old_chunks, chunk_pages(sources, "doc_id")).join(sources.select("doc_id", "source_type"), "doc_id")
    fresh = staged(fresh)
    chunks = staged(rest.unionByName(fresh, allowMissingColumns=True))
    documents = sources.join(fresh.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "title", "origin", "source_type", "format", word_count("text").alias("words"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    mentions = grounding.find_cohort_mentions(sources.withColumn("source", F.col("origin")))
    n_pages = sources.agg(F.count(F.when(F.col("source_type") == "website", 1)).alias("pages"), F.max(F.when(F.col("source_type") == "correction", F.col("title"))).alias("note"))
    n_chunks = fresh.agg(F.count("*").alias("chunks"), F.count("embedding").alias("carried"))
    pending = chunks.agg(F.count(F.when(F.col("embedding").isNull(), 1)).alias("pending"))
    counts = union_sources(n_pages, n_chunks, pending).agg(*[F.max(c).alias(c) for c in ("pages", "chunks", "carried", "pending", "note")])
    out = {"chunks": chunks, "documents": documents, "cohorts": grounding.audit_cohorts(mentions), "counts": counts, **index.build_index(chunks)}
    if expected is not None:
        out["missing"] = missing_pages(expected, cleaned)
    return out


def reindex_note(old_chunks: DataFrame, note: DataFrame) -> dict[str, DataFrame]:
    """Replace the chunks of the documents of ``note(doc_id, segments)``; statistics are refreshed, not rebuilt."""
    if note.where(F.exists("segments", lambda s: F.trim(s["text"]) != "")).isEmpty():
        raise ValueError("an empty note is not indexed")
    gone = old_chunks.join(note.select("doc_id"), "doc_id", "left_semi")
    fresh = carry_embeddings(gone, chunking.chunk_documents(note))
    chunks = old_chunks.join(note.select("doc_id"), "doc_id", "left_anti").unionByName(fresh, allowMissingColumns=True)
    old = index.build_index(old_chunks)
    counts = index.token_count(old_chunks)
    stats = index.refresh_stats(old["terms"], old["lexemes"], counts, fresh, gone.select(F.col("id").alias("chunk_id")))
    return {"chunks": chunks, **stats}
