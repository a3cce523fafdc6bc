"""Text splitters: sentences by rules of punctuation, in the JVM, and pieces of a size by ever finer separators."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from threadloom.functions.text import col

# The separators of pieces from the coarsest to the finest, where sentences
# end (a break goes between the two groups), and where long ones may be cut, in this order.
SEPARATORS = ("\n\n", "\n", "。|！|？", r"\.\s|\!\s|\?\s", r"；|;\s", r"，|,\s")
ENDS = (
    r"([;；.!?。！？\?])([^”’])",
    r"(\.{6})([^\"'”」』])",
    r"(\…{2})([^\"'”」』])",
    r"([;；!?。！？\?][\"'”」』]{0,2})([^;；!?，。！？\?])",
)
FINER = (r"([,，.][\"’”」』]{0,2})([^,，.])", r"( {2,}[\"’”」』]{0,2})([^\s])", r"( [\"’”」』]{0,2})([^ ])")
QUOTED_END = r"([﹒﹔﹖﹗．。！？][\"’”」』]{0,2})(?![﹒﹔﹖﹗．。！？\"‘“「『]|$)"


def _joined_lines(c: Column) -> Column:
    """Text of a PDF: its line breaks are layout, so any white space is a space."""
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n"), r"(?U)\s", " ")


def _lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: x != "")


def sentences(text: Column | str, size: int = 250, pdf: bool = False) -> Column:
    """The sentences of a text; one longer than ``size`` is cut at commas, what is still longer at runs
    of spaces, and what is longer even so at every space. Pieces keep the spaces at their start;
    null and empty texts have none."""
    c = F.coalesce(col(text), F.lit(""))
    c = _joined_lines(c) if pdf else c
    for rule in ENDS:
        c = F.regexp_replace(c, rule, "$1\n$2")
    out = _lines(F.regexp_replace(c, r"(?U)\s+\z", ""))
    for rule in FINER:
        out = F.flatten(F.transform(out, lambda x, rule=rule: F.when(F.length(x) > size, _lines(F.regexp_replace(x, f"(?U){rule}", "$1\n$2"))).otherwise(F.array(x))))
    return out


def quoted_sentences(text: Column | str, pdf: bool = False) -> Column:
    """Sentences that end with their closing quotes; a quotation that follows belongs to the sentence before it."""
    c = F.coalesce(col(text), F.lit(""))
    marked = F.regexp_replace(_joined_lines(c) if pdf else c, QUOTED_END, "$1\u0000")
    return F.filter(F.split(marked, "\u0000"), lambda x: x != "")


def _runs(text: str, start: int, end: int, size: int, finer: list[re.Pattern]) -> Iterator[list[int]]:
    """Cut positions of the stretches of text[start:end] that are packed on their own, in order.

    The text is cut behind each match of the first separator that occurs in it. Parts
    shorter than ``size`` that follow one another are one stretch; a longer part is cut
    by the separators after that one, and is a stretch if none occurs in it.
    """
    for level, separator in enumerate(finer):
        cuts = [start, *(m.end() for m in separator.finditer(text, start, end))]
        if len(cuts) > 1:
            break
    else:
        yield [start, end]
        return
    parts = list(pairwise(cuts if cuts[-1] == end else [*cuts, end]))
    for small, group in groupby(parts, lambda p: p[1] - p[0] < size):
        own = list(group)
        if small:
            yield [own[0][0], *(b for _, b in own)]
        else:
            for a, b in own:
                yield from _runs(text, a, b, size, finer[level + 1 :])


def _packed(at: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of pieces of a stretch cut at ``at``: as long as ``size`` allows, each beginning so
    far back that at most ``overlap`` of the one before is repeated."""
    first = 0
    for last in range(1, len(at) - 1):
        if at[last + 1] - at[first] > size:
            yield at[first], at[last]
            first = min(last, max(bisect_left(at, at[last] - overlap), bisect_left(at, at[last + 1] - size)))
    yield at[first], at[-1]


def recursive(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` where separators allow it, stripped and without blank lines."""
    patterns = [re.compile(s) for s in separators]
    spans = (span for run in _runs(text, 0, len(text), size, patterns) for span in _packed(run, size, overlap))
    pieces = (re.sub(r"\n{2,}", "\n", text[a:b].strip()) for a, b in spans)
    return [p for p in pieces if p]


#: Splitters by name: columns of pieces, or functions of one text.
SPLITTERS: dict[str, Callable] = {
    "sentences": lambda c, size, overlap: sentences(c, size),
    "pdf_sentences": lambda c, size, overlap: sentences(c, size, pdf=True),
    "quoted_sentences": lambda c, size, overlap: quoted_sentences(c),
    "recursive": recursive,
}
PYTHON = {"recursive"}


def splitter(name: str | None) -> str:
    """The name of a known splitter; the recursive one for an unknown or empty name."""
    return name if name in SPLITTERS else "recursive"


def split_rows(documents: DataFrame, name: str | Callable[[str, int, int], list[str]], size: int = 750, overlap: int = 150) -> DataFrame:
    """doc_id, pos, piece: the pieces of each text by a splitter's name, or a function (text, size, overlap)
    of the caller's, such as a model that finds topic bounds; null texts have none."""
    known = splitter(name) if isinstance(name, str) else None
    if known and known not in PYTHON:
        return documents.select("doc_id", F.posexplode(SPLITTERS[known]("text", size, overlap)).alias("pos", "piece"))
    split = SPLITTERS[known] if known else name

    def run(batches):
        for b in batches:
            at, pos, pieces = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                got = split(t, size, overlap) if t else []
                at += [i] * len(got)
                pos += range(len(got))
                pieces += got
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(pa.array(at, pa.int64())), "pos": pa.array(pos, pa.int32()), "piece": pa.array(pieces, pa.string())})

    schema = StructType([documents.schema["doc_id"], StructField("pos", IntegerType()), StructField("piece", StringType())])
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def documents_to_texts(documents: DataFrame, name: str | None = None, size: int = 750, overlap: int = 150, titles: bool = False) -> DataFrame:
    """doc_id, pos, content of loaded documents (doc_id, text, path): rows of CSV files as they are, others
    split; with ``titles`` each piece after a title is told what it is about."""
    from pyspark.sql import Window

    from threadloom.functions.text import extension, is_title

    table = F.coalesce(extension("path") == ".csv", F.lit(False))
    whole = documents.filter(table & (F.coalesce("text", F.lit("")) != "")).select("doc_id", F.lit(0).alias("pos"), F.col("text").alias("piece"))
    pieces = whole.unionByName(split_rows(documents.filter(~table), name or "recursive", size, overlap))
    if titles:
        title = F.last(F.when(is_title("piece"), F.col("piece")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        pieces = pieces.withColumn("title", title).withColumn("piece", F.when(~is_title("piece") & F.col("title").isNotNull(), F.concat_ws(" ", "title", "piece")).otherwise(F.col("piece")))
    return pieces.select("doc_id", "pos", F.col("piece").alias("content"))
