"""Documents to chunks, and catalog documents.

Chunking carries state from paragraph to paragraph of one document, so it is a
helper over Arrow batches, one document after the other; it needs no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.analysis import pieces
from lectern.functions.text import SPACE, module_of, trim_all
from lectern.sources.staging import staged

TARGET, MOST, OVERLAP, LEAST = 1800, 2600, 220, 120
SEGMENTS = "array<struct<ordinal:int,ordinal_label:string,text:string>>"
CHUNKS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("heading", T.StringType()),
    T.StructField("locator", T.StringType()), T.StructField("ordinal_start", T.IntegerType()), T.StructField("ordinal_end", T.IntegerType()), T.StructField("char_count", T.IntegerType()),
])
_WHITE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SENTENCES = re.compile(rf"[^.!?\n]+[.!?]*[{_WHITE}]*")


def heading_line(line: str) -> bool:
    t = line.strip(_WHITE)
    letters = re.sub("[^A-Za-z]", "", t)
    return 3 <= len(t) <= 90 and t[-1] not in ".!?" and len(letters) >= 3 and letters == letters.upper()


def blocks_of(segments: list[dict]) -> list[tuple[str, int | None, str | None]]:
    """(text, ordinal, heading in force) of each paragraph; a lone heading is no paragraph."""
    heading, out = None, []
    for segment in segments:
        for part in re.split("\n{2,}", segment["text"] or ""):
            body = part.strip(_WHITE)
            if not body:
                continue
            first, _, more = body.partition("\n")
            if heading_line(first):
                heading = first.strip(_WHITE)
                if not more and "\n" not in body:
                    continue
            out.append((body, segment["ordinal"], heading))
    return out


def split_oversized(text: str, most: int = MOST) -> list[str]:
    """Whole sentences, packed up to ``most``; a longer sentence stays whole."""
    packed, size = [[]], 0
    for sentence in _SENTENCES.findall(text) or [text]:
        if size and size + len(sentence) > most:
            packed.append([])
            size = 0
        packed[-1].append(sentence)
        size += len(sentence)
    joined = ["".join(p).strip(_WHITE) for p in packed]
    return joined[:-1] + [x for x in joined[-1:] if x]


def locator(label: str | None, start: int | None, end: int | None) -> str | None:
    if label is None or start is None:
        return None
    if end is None or end == start:
        return f"{label}{start}"
    return f"{'pp.' if label == 'p.' else 'slides'} {start}–{end}"


def chunk_document(doc_id: str, segments: list[dict], target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> list[dict]:
    """Pack paragraphs up to ``target``. A full buffer's last paragraphs (``overlap``
    characters or more) start the next chunk, unless they are all of it; a tail
    under ``least`` goes to the chunk before. The fill level counts two more for
    each paragraph put in, none for those carried over."""
    label = next((s["ordinal_label"] for s in segments if s["ordinal_label"]), None)
    work = []
    for body, ordinal, heading in blocks_of(segments):
        work += [(x, ordinal, heading) for x in (split_oversized(body, most) if len(body) > most else [body])]
    chunks: list[dict] = []

    def close(held: list) -> list:
        """Emit what is held; what the next chunk starts with."""
        text = "\n\n".join(b[0] for b in held)
        if chunks and len(text) < least:
            last = chunks[-1]
            last["text"] += "\n\n" + text
            last["char_count"] = len(last["text"])
            if held[-1][1] is not None:
                last["ordinal_end"] = held[-1][1]
            last["locator"] = locator(label, last["ordinal_start"], last["ordinal_end"])
            return []
        numbers = [b[1] for b in held if b[1] is not None]
        low, high = (min(numbers), max(numbers)) if numbers else (None, None)
        chunks.append({
            "id": f"{doc_id}#{len(chunks)}", "doc_id": doc_id, "chunk_index": len(chunks), "text": text, "heading": next((b[2] for b in held if b[2]), None), "locator": locator(label, low, high),
            "ordinal_start": low, "ordinal_end": high, "char_count": len(text),
        })
        carried = 0
        for k in range(len(held) - 1, -1, -1):
            carried += len(held[k][0])
            if carried >= overlap:
                return held[k:] if k else []
        return []

    held: list = []
    level = 0
    for block in work:
        if level and level + len(block[0]) > target:
            held = close(held)
            level = sum(len(b[0]) for b in held)
        held.append(block)
        level += len(block[0]) + 2
    if held:
        close(held)
    return chunks


def chunk_documents(docs: DataFrame, **sizes) -> DataFrame:
    """``docs(doc_id, segments)`` to chunk rows. Document-local, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = CHUNKS.names
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for b in pieces(batches):
            rows: list[dict] = []
            for doc_id, segments in zip(b.column("doc_id").to_pylist(), b.column("segments").to_pylist(), strict=True):
                rows += chunk_document(doc_id, segments or [], **sizes)
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "segments").mapInArrow(run, CHUNKS)


def flat_segments(text: Column | str) -> Column:
    """One segment without a number."""
    return F.array(F.struct(F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("ordinal_label"), (F.col(text) if isinstance(text, str) else text).alias("text"))).cast(SEGMENTS)


def catalog_purpose(text: Column | str, blank: str = r"(_{3,}|\.{5,}|\[[\s]*\]|^\s*[-–—]\s*$)", brand: str | None = None) -> Column:
    """The first line that describes a worksheet: prose of 25 to 240 characters, cut to its first sentence."""
    lines = F.transform(F.split(F.col(text) if isinstance(text, str) else text, "\n"), lambda x: trim_all(x))

    def prose(x: Column) -> Column:
        ok = F.length(x).between(25, 240) & ~x.rlike(blank) & (x != F.upper(x)) & ~x.rlike(r"(?i)^(your|list|write|enter|describe|fill)\b")
        return ok & ~x.rlike(brand) if brand else ok

    def sentence(x: Column) -> Column:
        found = F.regexp_extract(x, "^[^.!?]+[.!?]", 0)
        return F.when(found == "", x).otherwise(found)

    return trim_all(F.get(F.filter(F.transform(F.filter(lines, prose), sentence), lambda x: F.length(x) >= 25), F.lit(0)))


def catalog_title(path: Column | str, prefix: str | None = None) -> Column:
    """File name without extension and programme prefix, underscores as spaces."""
    out = F.regexp_replace(F.regexp_replace(F.col(path) if isinstance(path, str) else path, "^.*/", ""), r"(?i)\.[a-z0-9]+$", "")
    if prefix:
        out = F.regexp_replace(out, f"(?i)^(?:{prefix})", "")
    return trim_all(F.regexp_replace(F.regexp_replace(out, "_+", " "), f"[{SPACE}]{{2,}}", " "))


def catalog_entries(files: DataFrame, prefix: str | None = None, brand: str | None = None, programme: str = "the program") -> DataFrame:
    """``files(archive, path, text)`` to name, module, purpose."""
    name = catalog_title("path", prefix)
    module = F.coalesce(module_of("archive"), module_of("path"), F.lit("Unassigned"))
    default = F.concat(F.col("name"), F.lit(" worksheet used during "), F.col("module"), F.lit(f" of {programme}."))
    return files.select(name.alias("name"), module.alias("module"), catalog_purpose("text", brand=brand).alias("purpose")).withColumn("purpose", F.coalesce("purpose", default))


def render_catalog(entries: DataFrame, title: str = "worksheet and template catalog") -> DataFrame:
    """module, text: one document per module, entries in the order of their names."""
    line = F.concat(F.lit("- "), "name", F.lit(" — "), "module", F.lit(" — "), "purpose")
    rows = entries.withColumn("k", F.struct(F.collate("name", "UNICODE").alias("n"), line.alias("line")))
    grouped = rows.groupBy("module").agg(F.transform(F.array_sort(F.collect_list("k")), lambda x: x["line"]).alias("lines"))
    head = F.concat("module", F.lit(f" — {title}\n\nThe following "), F.size("lines").cast("string"), F.lit(" fill-in worksheets are provided to participants in "), "module", F.lit(".\n\n"))
    return grouped.select("module", F.concat(head, F.array_join("lines", "\n")).alias("text"))


def build_manifest(docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with chunk_count, skipped): documents without chunks are skipped with a reason."""
    counted = docs.join(chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count")), "doc_id", "left")
    return counted.where("chunk_count is not null"), counted.where("chunk_count is null").select("doc_id", F.lit("no extractable text").alias("reason"))


def slug_collisions(docs: DataFrame) -> DataFrame:
    """doc_id, n, titles: ids that more than one document got."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("title")).alias("titles")).where("n > 1")


def _openings(tokens: np.ndarray, budget: int) -> dict[str, list]:
    """What a range of rows makes of the batch that is open before it.

    From each row that may begin the range's first batch of its own, pointers to the next batch's first row are followed by doubling.
    An entry holds for openings that leave room for ``limit`` tokens and not for the next entry's; the first one, for openings that take no row at all.
    ``begins``: whether the range begins a batch; ``more``: batches behind the first such; ``filled``: the tokens of the last one so far, or of the whole range.
    """
    n = len(tokens)
    before = np.concatenate(([0], np.cumsum(tokens)))
    # the first row behind the batch that begins at each row; a row over the budget is a batch of its own
    jump = np.maximum(np.searchsorted(before, before[:-1] + budget, "right") - 1, np.arange(1, n + 1))
    count = (jump < n).astype(np.int64)
    jump = np.where(jump < n, jump, np.arange(n))
    while (jump[jump] != jump).any():
        count, jump = count + count[jump], jump[jump]
    fits = np.arange(np.searchsorted(before, budget, "right"))
    fits = fits[np.append(before[fits][1:] != before[fits][:-1], True)]  # rows without tokens fit, too
    first = np.append(0, fits)
    begins, at = first < n, np.minimum(first, n - 1)
    filled = np.where(begins, before[n] - before[jump[at]], before[n])
    more = np.where(begins, count[at], 0)
    # most openings soon fall together
    new = np.ones(len(first), bool)
    new[2:] = (filled[2:] != filled[1:-1]) | (more[2:] != more[1:-1]) | (begins[2:] != begins[1:-1])
    return {"limit": np.append(-1, before[fits])[new].tolist(), "begins": begins[new].tolist(), "more": more[new].tolist(), "filled": filled[new].tolist()}


def token_batches(pending: DataFrame, budget: int = 8000) -> DataFrame:
    """batch added to ``pending(id, tokens)``: in the one order of ids, a new batch begins where the sum would pass the budget; null tokens count as none.

    Rows are ranged by id, and written. Each range says what it makes of any batch that is open before it, in a few numbers;
    the driver follows these from range to range, and then each range numbers its rows. Rows equal in id and tokens come in any one order.
    """
    own, schema = pending.columns, T.StructType([*pending.schema.fields, T.StructField("batch", T.LongType())])
    rows = pending.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("_tokens"), F.rand(1).alias("_tie"))
    ranged = staged(rows.repartitionByRange("id", "_tokens", "_tie").withColumn("_range", F.spark_partition_id()))
    dealt = lambda *more: ranged.select("_range", "_tokens", "_tie", *more).repartition("_range").sortWithinPartitions("_range", "id", "_tokens", "_tie")

    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            number = b.column("_range").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            yield from ((int(number[x]), b.slice(x, y - x)) for x, y in zip(cuts, cuts[1:], strict=False) if y > x)

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in groupby(slices(batches), lambda x: x[0]):
            found = _openings(np.concatenate([b.column("_tokens").to_numpy() for _, b in held]), budget)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([v], pa.list_(pa.bool_() if c == "begins" else pa.int64())) for c, v in found.items())], names=["_range", *found])

    known = dealt("id").mapInArrow(describe, "_range int, limit array<long>, begins array<boolean>, more array<long>, filled array<long>").collect()
    opened, batch, filled = {}, -1, budget + 1  # before each range: the open batch and its tokens; none is as a full one
    for r in sorted(known, key=lambda r: r["_range"]):
        opened[r["_range"]] = (batch, filled)
        k = max(0, bisect_right(r.limit, budget - filled) - 1)
        batch, filled = (batch + 1 + r.more[k], r.filled[k]) if r.begins[k] else (batch, filled + r.filled[k])
    shared = pending.sparkSession.sparkContext.broadcast(opened)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, batch, filled = None, 0, 0
        for of, b in slices(batches):
            if of != at:
                at, (batch, filled) = of, shared.value[of]
            tokens = b.column("_tokens").to_numpy()
            before = np.concatenate(([0], np.cumsum(tokens)))
            out, i = np.empty(len(tokens), np.int64), 0
            while i < len(tokens):
                to = max(i, int(np.searchsorted(before, before[i] + budget - filled, "right")) - 1)
                out[i:to] = batch
                filled += int(before[to] - before[i])
                if to < len(tokens):
                    batch, filled, out[to] = batch + 1, int(tokens[to]), batch + 1
                i = to + 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(out)], names=[*own, "batch"])

    return dealt(*[F.col(f"`{c}`") for c in own]).mapInArrow(number, schema)
