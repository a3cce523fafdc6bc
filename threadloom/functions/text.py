"""Text expressions: stripping, tokens, JSON and record parsing, titles. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
#: Join of relation descriptions, and the label of an edge without one (fixed values).
SEPARATOR, COOCCURRENCE = "；", "co-occurrence"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space, of any script, at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(col(c), EDGE, "")


def normalize_entity(c: Column | str) -> Column:
    """Stripped and lower-cased; null becomes empty."""
    return F.lower(strip(F.coalesce(col(c), F.lit(""))))


def node_id(c: Column | str) -> Column:
    return F.concat(F.lit("entity::"), normalize_entity(c))


def tokens(c: Column | str) -> Column:
    """Lower-cased words between white space; none of an empty or null text."""
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"\s+"), lambda x: x != "")


def json_slice(c: Column | str) -> Column:
    """From the first ``{`` to the last ``}``; null if there is none."""
    found = F.regexp_extract(col(c), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def without_fences(c: Column | str) -> Column:
    """Without the lines that open and close a fenced block."""
    return strip(F.regexp_replace(col(c), r"(?m)^```json\s*|```$", ""))


def fenced_json(c: Column | str, schema: str) -> Column:
    """The text as JSON, or else its first fenced block; null if neither parses."""
    block = F.regexp_extract(col(c), r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    return F.coalesce(F.from_json(F.when(strip(col(c)).startswith("{"), col(c)), schema), F.from_json(F.when(block != "", block), schema))


def keywords(c: Column | str) -> Column:
    """Keywords of a reply ``{"keywords": [...]}``, fenced or not; the raw text alone if it has none."""
    return F.coalesce(F.from_json(without_fences(c), "keywords array<string>")["keywords"], F.array(col(c)))


def tuple_records(c: Column | str) -> Column:
    """Records of a delimited extraction reply: ``array<array<string>>``, fields unquoted.

    Records are parted by ``##`` and fields by ``<|>``; the end mark and anything not
    in parentheses go.
    """
    body = F.split_part(col(c), F.lit("<|COMPLETE|>"), F.lit(1))
    records = F.filter(F.transform(F.split(body, "##"), strip), lambda r: r.startswith("(") & r.endswith(")"))
    return F.transform(records, lambda r: F.transform(F.split(F.substring(r, 2, F.length(r) - 2), r"<\|>"), lambda f: F.regexp_replace(strip(f), '^"|"$', "")))


def is_title(c: Column | str, longest: int = 20, least_letters: float = 0.5) -> Column:
    """Whether a line may be a title: short, mostly letters, a digit near its start,
    no closing punctuation, not a number."""
    t = col(c)
    size, letters, solid = F.length(t), F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"\S"))
    return F.coalesce(
        (size > 0) & ~t.rlike(r"[^\p{L}\p{N}_\s]\z") & (size <= longest) & ~t.rlike(r"^\p{N}+$") & (F.try_divide(letters, solid) >= least_letters) & F.substring(t, 1, 5).rlike(r"\p{N}"),
        F.lit(False),
    )


def extension(c: Column | str) -> Column:
    """The lower-cased ending of a path with its dot, without query and fragment; empty if none."""
    path = F.regexp_replace(col(c), r"[?#].*$", "")
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two arrays, in double precision."""
    terms = F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
