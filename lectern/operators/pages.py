"""Web pages to text, shared boilerplate, and extraction from office files and archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.analysis import pieces
from lectern.functions.text import normalize_whitespace, trim_all

#: Elements without content for a reader, those that end a line, and those that have no end tag.
DROPPED = {"script", "style", "noscript", "svg", "iframe", "nav", "header", "footer"}
BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "th", "section", "article", "blockquote"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Start tags that end an open paragraph, and siblings that end each other.
ENDS_P = BLOCK - {"br", "td", "th", "tr"} | {"ul", "ol", "dl", "table", "pre", "form", "main", "aside", "figure", "hr", "address", "fieldset", "nav", "header", "footer"}
ENDS_SAME = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_WHITE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


class PageText(HTMLParser):
    """Text of ``main``, else of ``body``, and the first title. Unclosed tags are
    closed as browsers close them, far enough for text and lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.skip = 0  # depth of the outermost dropped element that is open, or 0
        self.main, self.body, self.title, self.has_main = [], [], None, False

    def text(self, data: str) -> None:
        if self.open and self.open[-1] == "title" and "svg" not in self.open:
            self.title = (self.title or "") + data if self.title is None or self.in_title else self.title
            return
        if self.skip or (self.open and self.open[0] == "head") or "head" in self.open:
            return
        self.body.append(data)
        if "main" in self.open:
            self.main.append(data)

    in_title = False

    def handle_data(self, data: str) -> None:
        self.text(data)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ENDS_P and "p" in self.open:
            self.close("p")
        if tag in ENDS_SAME and (same := [t for t in self.open if t in ENDS_SAME[tag]]):
            lists = max((i for i, t in enumerate(self.open) if t in ("ul", "ol", "table", "select", "dl")), default=-1)
            inner = [i for i, t in enumerate(self.open) if t in same and i > lists]
            if inner:
                while len(self.open) > inner[0]:
                    self.pop()
        if tag == "body" and "head" in self.open:
            self.close("head")
        if tag == "title":
            self.in_title = self.title is None
        if tag == "main" and not self.skip:
            self.has_main = True
        if tag in VOID:
            if tag in BLOCK:
                self.text("\n")
            return
        self.open.append(tag)
        given = dict(attrs)
        if not self.skip and (tag in DROPPED or given.get("role") == "navigation" or given.get("aria-hidden") == "true"):
            self.skip = len(self.open)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "g", "circle", "rect"):
            self.close(tag)

    def pop(self) -> None:
        tag = self.open.pop()
        if self.skip and len(self.open) < self.skip:
            self.skip = 0
            if tag in DROPPED:
                return
            return
        if tag == "title":
            self.in_title = False
        if tag in BLOCK:
            self.text("\n")

    def close(self, tag: str) -> None:
        while self.open and tag in self.open:
            last = self.open[-1] == tag
            self.pop()
            if last:
                break

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            self.close(tag)
        elif tag == "p":
            self.text("\n")

    def result(self) -> tuple[str, str | None]:
        while self.open:
            self.pop()
        raw = "".join(self.main if self.has_main else self.body)
        lines = (x.strip(_WHITE) for x in raw.split("\n"))
        return "\n".join(x for x in lines if x), self.title


def page_text(html: str | None) -> tuple[str, str | None]:
    parser = PageText()
    parser.feed(html or "")
    parser.close_all = True
    HTMLParser.close(parser)
    return parser.result()


def html_to_text(pages: DataFrame, html: str = "html", suffix: str | None = None, path: str = "url") -> DataFrame:
    """Add ``text`` and ``title``: the page's first title less the site's suffix, else its path."""
    kept = [c for c in pages.columns if c not in ("text", "title")]
    from pyspark.sql import types as T

    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("title", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [page_text(x) for x in b.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=[*kept, "text", "title"])

    out = pages.select(*kept).mapInArrow(run, schema)
    return out.withColumn("title", page_title("title", path, suffix))


def page_title(title: Column | str, path: Column | str, suffix: str | None = None) -> Column:
    t = F.coalesce(F.nullif(F.col(title) if isinstance(title, str) else title, F.lit("")), F.col(path) if isinstance(path, str) else path)
    if suffix:
        t = F.regexp_replace(t, f"(?i)[ ]*[|\\-–][ ]*{suffix}.*$", "")
    return F.coalesce(F.nullif(trim_all(t), F.lit("")), F.col(path) if isinstance(path, str) else path)


def strip_shared_boilerplate(pages: DataFrame, site: str, text: str = "text", share: float = 0.6, longest: int = 120) -> DataFrame:
    """Remove the short lines that stand on ``share`` of a site's pages (two at least).

    Lines are counted with partial aggregation, so a line of every page is no hot
    key; only a site's own shared lines join its pages.
    """
    rows = pages.select(F.col(site).alias("_site"), F.explode(F.array_distinct(F.split(text, "\n"))).alias("line"))
    counts = rows.where(F.length("line") < longest).groupBy("_site", "line").agg(F.count("*").alias("n"))
    total = pages.groupBy(F.col(site).alias("_site")).agg(F.count("*").alias("total"))
    chrome = counts.join(total, "_site").where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("total") * share))).groupBy("_site").agg(F.collect_set("line").alias("_chrome"))
    joined = pages.join(chrome, pages[site].eqNullSafe(chrome["_site"]), "left")
    cleaned = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("_chrome"), x)), "\n")
    return joined.withColumn(text, F.when(F.col("_chrome").isNull(), F.col(text)).otherwise(cleaned)).select(*pages.columns)


def segments_from_pages(text: Column | str) -> Column:
    """Pages parted by form feeds, numbered from 1; empty ones go, numbers stay."""
    pages = F.split(F.col(text) if isinstance(text, str) else text, "\f")
    numbered = F.transform(pages, lambda p, i: F.struct((i + 1).alias("ordinal"), F.lit("p.").alias("ordinal_label"), normalize_whitespace(p).alias("text")))
    return F.filter(numbered, lambda s: s["text"] != "")


def expand_archives(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """archive, path, content, error: a row per member of each zip file, folders left out; a broken archive is a row with its error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for name, data in zip(b.column(path).to_pylist(), b.column(content).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        rows += [(name, m.filename, z.read(m), None) for m in z.infolist() if not m.is_dir()]
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
                    rows.append((name, None, None, str(e)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], names=["archive", "path", "content", "error"])

    return files.select(path, content).mapInArrow(run, "archive string, path string, content binary, error string")


def decode_xml_entities(text: str) -> str:
    for name, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = text.replace(name, by)
    text = re.sub(r"&#(\d+);", lambda m: chr(int(m[1])), text)
    return re.sub(r"&#x([0-9a-fA-F]+);", lambda m: chr(int(m[1], 16)), text).replace("&amp;", "&")


def _office_xml(xml: str, paragraph: str) -> str:
    xml = re.sub(rf"</{paragraph}>|<[wa]:br\b[^>]*/>", "\n", xml)
    return decode_xml_entities(re.sub("<[^>]+>", "", re.sub(r"<w:tab\b[^>]*/>", " ", xml)))


def office_segments(name: str, data: bytes) -> list[tuple[int | None, str | None, str]]:
    """Raw segments of a DOCX or PPTX file; white space is left to Spark."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if name.endswith(".docx"):
            return [(None, None, _office_xml(z.read("word/document.xml").decode("utf-8", "replace"), "w:p"))] if "word/document.xml" in z.namelist() else []
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        return [(k, "slide ", _office_xml(z.read(n).decode("utf-8", "replace"), "a:p")) for k, n in slides]


def extract_text(files: DataFrame) -> DataFrame:
    """``files(path, content)`` to path, segments, error, by extension: docx and pptx by
    the helper, txt and md as text, text of pages (.pages.txt) by form feeds. Nothing raises:
    a file that can't be read has its error and no segments."""
    kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("ordinal_label", pa.string()), ("text", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out, errors = [], []
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                ext = re.search(r"\.[^.]+$", (name or "").lower())
                ext, found, error = ext[0] if ext else "", [], None
                try:
                    if ext in (".docx", ".pptx"):
                        found = office_segments(name.lower(), data or b"")
                    elif ext in (".txt", ".md"):
                        text = (data or b"").decode("utf-8", "replace")
                        found = [(i + 1, "p.", x) for i, x in enumerate(text.split("\f"))] if "\f" in text else [(None, None, text)]
                    else:
                        error = f"unsupported format {ext or '(none)'}"
                except Exception as e:  # noqa: BLE001  any broken file is a row
                    error = f"extraction failed: {e}"
                out.append([{"ordinal": o, "ordinal_label": x, "text": t} for o, x, t in found])
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, kind), pa.array(errors, pa.string())], names=["path", "segments", "error"])

    raw = files.select("path", "content").mapInArrow(run, "path string, segments array<struct<ordinal:int,ordinal_label:string,text:string>>, error string")
    clean = F.filter(F.transform("segments", lambda s: F.struct(s["ordinal"].alias("ordinal"), s["ordinal_label"].alias("ordinal_label"), normalize_whitespace(s["text"]).alias("text"))), lambda s: s["text"] != "")
    # a row of a generator: a filter on what is made of it would make it again below
    cleaned = raw.select("path", F.explode(F.array(clean)).alias("segments"), "error")
    return cleaned.withColumn("error", F.when(F.col("error").isNull() & (F.size("segments") == 0), "no text").otherwise(F.col("error")))
