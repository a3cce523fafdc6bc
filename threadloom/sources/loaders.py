"""File sources: which reader an extension gets, and reading a folder into documents.

Whatever Spark reads itself (text, JSON, CSV, XML) it reads; formats that need a
parser go through ``binaryFile`` and a batch function. Image text needs a recogniser,
which callers plug in; without one images give no text.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import col, extension

#: Reader by extension (fixed values).
READERS = {
    ".html": "html", ".htm": "html", ".mhtml": "mhtml", ".md": "text", ".json": "json", ".jsonl": "jsonl", ".csv": "csv",
    ".pdf": "pdf", ".docx": "docx", ".ppt": "pptx", ".pptx": "pptx", ".png": "image", ".jpg": "image", ".jpeg": "image", ".bmp": "image",
    ".eml": "plain", ".msg": "plain", ".rst": "plain", ".rtf": "plain", ".txt": "plain", ".xml": "plain", ".epub": "plain", ".odt": "plain", ".tsv": "plain",
    ".xlsx": "excel", ".xls": "excel", ".xlsd": "excel", ".ipynb": "notebook", ".py": "text", ".srt": "srt", ".toml": "toml", ".enex": "enex",
}


def reader_of(path: Column | str) -> Column:
    """The reader of a path's extension; null if it has none."""
    table = F.create_map(*[F.lit(x) for kv in READERS.items() for x in kv])
    return F.try_element_at(table, extension(col(path)))


class _Text(HTMLParser):
    SKIP = ("script", "style")
    BREAK = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "ul", "table", "title", "nav", "pre")

    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in self.SKIP
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skipped -= tag in self.SKIP and self.skipped > 0
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(data)


def html_text(html: str | None) -> str | None:
    """The visible text of a page, a line per block, without scripts and styles."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def pages_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``text``, the visible text of the column ``html``; all else stays."""

    def run(batches):
        for b in batches:
            text = pa.array([html_text(x) for x in b.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names} | {"text": text})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{schema}, text string")


def _plain(data: bytes) -> str:
    for encoding in ("utf-8-sig", "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8", "gb18030", "latin-1"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return ""


def _office(data: bytes, part: str, paragraph: str) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(part, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])
        lines = []
        for n in names:
            for p in ElementTree.fromstring(z.read(n)).iter():
                if p.tag.endswith(paragraph):
                    lines.append("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")))
    return "\n".join(x for x in lines if x)


def _notebook(data: bytes) -> str:
    return "\n\n".join("".join(c.get("source", [])) for c in json.loads(data).get("cells", []))


def _srt(data: bytes) -> str:
    blocks = re.split(r"\r?\n\r?\n", _plain(data))
    return "\n".join(" ".join(b.splitlines()[2:]) for b in blocks if "-->" in b)


def _excel(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n".join("".join(t.text or "" for t in s.iter() if t.tag.endswith("}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))) if "xl/sharedStrings.xml" in z.namelist() else ""


def _mhtml(data: bytes) -> str:
    import email

    parts = [p for p in email.message_from_bytes(data).walk() if p.get_content_type() == "text/html"]
    return "\n".join(html_text(_plain(p.get_payload(decode=True) or b"")) or "" for p in parts)


def _enex(data: bytes) -> str:
    notes = ElementTree.fromstring(data).iter("note")
    return "\n\n".join(f"{n.findtext('title') or ''}\n{html_text(n.findtext('content') or '') or ''}".strip() for n in notes)


PARSERS: dict[str, Callable[[bytes], str]] = {
    "html": lambda d: html_text(_plain(d)) or "", "mhtml": _mhtml, "text": _plain, "plain": _plain, "json": _plain, "jsonl": _plain, "csv": _plain, "toml": _plain,
    "docx": lambda d: _office(d, r"word/document\.xml", "}p"), "pptx": lambda d: _office(d, r"ppt/slides/slide\d+\.xml", "}p"), "excel": _excel, "notebook": _notebook, "srt": _srt, "enex": _enex,
}


def load_files(spark: SparkSession, path: str, recognise: Callable[[bytes], str] | None = None) -> DataFrame:
    """path, reader, page_content of each file with a known extension below ``path``.

    A file that its parser cannot read has null content. PDF and image content comes
    from ``recognise`` (bytes to text) and is null without it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").withColumn("reader", reader_of("path")).filter("reader is not null")

    def run(batches):
        for b in batches:
            out = []
            for reader, data in zip(b.column("reader").to_pylist(), b.column("content").to_pylist(), strict=True):
                parse = PARSERS.get(reader, recognise)
                try:
                    out.append(parse(data) if parse else None)
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    out.append(None)
            yield pa.RecordBatch.from_pydict({"path": b.column("path"), "reader": b.column("reader"), "page_content": pa.array(out, pa.string())})

    return files.mapInArrow(run, "path string, reader string, page_content string")


def images_to_read(images: DataFrame, least: float = 0.6) -> DataFrame:
    """The images (width, height, page_width, page_height) that are large enough on both sides of their page to be read."""
    return images.filter((F.try_divide("width", "page_width") >= least) & (F.try_divide("height", "page_height") >= least))


def turned_size(width: Column | str, height: Column | str, angle: Column | str) -> tuple[Column, Column]:
    """(width, height) of an image turned by ``angle`` degrees, so that all of it is seen."""
    w, h = col(width), col(height)
    c, s = F.abs(F.cos(F.radians(col(angle)))), F.abs(F.sin(F.radians(col(angle))))
    return F.floor(h * s + w * c), F.floor(h * c + w * s)


def reading_order(shapes: DataFrame) -> DataFrame:
    """slide and text of shapes (slide, top, left, text), from the top and then from the left; empty ones go."""
    line = F.trim("text")
    own = shapes.filter(F.coalesce(line, F.lit("")) != "").groupBy("slide").agg(F.array_sort(F.collect_list(F.struct("top", "left", line.alias("text")))).alias("x"))
    return own.select("slide", F.array_join(F.transform("x", lambda s: s["text"]), "\n").alias("text"))


def csv_documents(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """path, row, page_content: a document for each row of CSV files, a ``column: value`` line for each field."""
    rows = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).csv(path)
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in rows.columns])
    return rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("row"), lines.alias("page_content"))


CHUNKS = "window_id string, method string, chunks array<struct<chunk_id: string, concat_text: string, msg_ids: array<string>, messages: array<struct<`from`: string, text: string>>>>"


def read_chunks(spark: SparkSession, path: str, max_chunks: int | None = None) -> DataFrame:
    """pos, chunk_id, concat_text, msg_ids, messages of a chunk file, in file order."""
    rows = spark.read.schema(CHUNKS).option("multiLine", True).json(path).select(F.posexplode("chunks").alias("pos", "c")).select("pos", "c.*")
    return rows if max_chunks is None else rows.filter(F.col("pos") < max_chunks)


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """chunk_id and its messages as ``sender: text`` lines; messages without text go."""
    said = F.filter("messages", lambda m: F.coalesce(m["text"], F.lit("")) != "")
    return chunks.select("chunk_id", F.array_join(F.transform(said, lambda m: F.concat(F.coalesce(m["from"], F.lit("unknown")), F.lit(": "), m["text"])), "\n").alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    schema = "queries array<struct<query_id: string, query_text: string, answer_chunk_ids: array<string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("queries"))


def read_true_labels(spark: SparkSession, path: str) -> DataFrame:
    """msg_id, topic_id; of a message given twice the last."""
    schema = "content array<struct<msg_id: string, topic_id: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("content").alias("pos", "c"))
    return last_label(rows.select("c.msg_id", "c.topic_id", "pos"), "msg_id", "topic_id")


def last_label(rows: DataFrame, key: str, label: str) -> DataFrame:
    """``key`` and ``label``; of a key given twice the one of the largest ``pos``."""
    return rows.groupBy(key).agg(F.max_by(label, "pos").alias(label))


def predicted_labels(chunks: DataFrame) -> DataFrame:
    """msg_id, chunk_id; of a message in two chunks the last."""
    return chunks.select("pos", "chunk_id", F.explode("msg_ids").alias("msg_id")).groupBy("msg_id").agg(F.max_by("chunk_id", "pos").alias("chunk_id"))


def read_clustering_results(spark: SparkSession, path: str) -> DataFrame:
    """r, c, nmi, ari from result files named with R<number> and C<number> between underscores."""
    rows = spark.read.schema("nmi double, ari double").option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("f"))
    number = lambda k: F.regexp_extract("f", rf"(?:^|_){k}([0-9]+(?:\.[0-9]+)?)(?=_|\.json$)", 1).try_cast("double")
    return rows.select(number("R").alias("r"), number("C").alias("c"), "nmi", "ari").filter("r is not null and c is not null and nmi is not null and ari is not null")
