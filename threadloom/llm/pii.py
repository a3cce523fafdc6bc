"""Personal data: identifiers by pattern, and the terms of their documents that give them away.

Every e-mail, address, card or phone number is a protected entity. All words of the
documents that hold an entity are candidates; how strongly one reveals the entity is
their pointwise mutual information over the corpus, divided by the entity's own
information: PMI(c, t) / IC(c) with PMI = log2(N n_ct / (n_c n_t)) and
IC = log2(N / n_c), all counts of documents (n_ct: t stands with c; n_t: t stands
anywhere). From ``REMOVE`` on a term is removed, from ``GENERALISE`` on replaced by
its class, in every document that holds an identifier. A term that stands with the entity
in at least half of its documents (2 n_ct >= n_t) goes elsewhere too: it tells of the
entity also where that is not named. Others are left alone in documents without one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from threadloom.llm import textkernel
from threadloom.llm.jaccard_join import IdFilter, id_filter
from threadloom.llm.textkernel import LETTER
from threadloom.session import settle

KINDS = ("email", "ip", "card", "phone", "term")
MIN_LETTERS = 3
GENERALISE, REMOVE = 0.8, 0.95
MASKS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")

# The base patterns; look-behinds and possessive repeats only save retries that fail.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base identifiers, by start and then kind."""
    out = []
    at = text.find("@")
    taken = 0
    while at >= 0:
        a = at
        while a > taken and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            taken = m.end()
        at = text.find("@", max(at + 1, taken))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> int:
    """A protected entity's id: its kind and value, without the form it is written in."""
    value = value.lower() if kind < 2 else re.sub("[^0-9]", "", value)
    return xxhash.xxh64_intdigest(f"{kind}:{value}") - (1 << 63)


def _terms(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, id) of the runs of at least MIN_LETTERS letters, lower-cased for the id."""
    low = textkernel.lowered(cps)
    letter = textkernel.look(textkernel.unicode_tables()[0], cps) == LETTER
    edge = np.zeros(len(cps) + 1, bool)
    edge[bounds] = True
    first = np.flatnonzero(letter & (edge[:-1] | np.concatenate([[True], ~letter[:-1]])))
    last = np.flatnonzero(letter & (edge[1:] | np.concatenate([~letter[1:], [True]]))) + 1
    keep = last - first >= MIN_LETTERS
    first, last = first[keep], last[keep]
    return first, last, textkernel.span_hashes(low, first, last).view(np.int64)


BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
NEAR = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
IDS = pa.list_(pa.int64())
TERMS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("removed", pa.bool_())]))
ROW_NO = StructField("row_no", LongType())
NAMED = StructField("named", BooleanType())
SPANS = StructField("base", ArrayType(StructType([StructField(c, IntegerType()) for c in ("start", "kind", "end")])))
CHOSEN = StructField("terms", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("removed", BooleanType())])))
PLACES = StructField("near", ArrayType(StructType([StructField("term", LongType()), StructField("start", IntegerType()), StructField("end", IntegerType())])))


def _outside(own: list[tuple[int, int, int]], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which terms of a row lie outside its identifiers: letters inside one are part of it."""
    ok = np.ones(len(first), bool)
    for s, _, e in own:
        ok[int(np.searchsorted(last, s, side="right")) : int(np.searchsorted(first, e))] = False
    return ok


@textkernel.tidied
def _mentions(batches):
    """Each row with its base spans, the entities they are and, if there are any, its distinct terms."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        for a, b, cps, bounds in textkernel.chunks(textkernel.texts_of(batch)):
            flat = textkernel.to_text(cps)
            spans = [base_spans(flat[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            entities: list[list[int]] = [[] for _ in spans]
            terms: list[list[int]] = [[] for _ in spans]
            if any(spans):
                first, last, term = _terms(cps, bounds)
                cut = np.searchsorted(first, bounds)
                for r, own in enumerate(spans):
                    if own:
                        lo, hi, at = int(cut[r]), int(cut[r + 1]), int(bounds[r])
                        entities[r] = sorted({entity(kind, flat[s + at : e + at]) for s, kind, e in own})
                        terms[r] = np.unique(term[lo:hi][_outside(own, first[lo:hi] - at, last[lo:hi] - at)]).tolist()
            n = b - a
            columns = {c: batch.column(c).slice(a, n) for c in batch.schema.names}
            base = [[{"start": s, "kind": k, "end": e} for s, k, e in own] for own in spans]
            found = {"row_no": pa.array(np.arange(n) + number + a), "base": pa.array(base, BASE), "entities": pa.array(entities, IDS), "terms": pa.array(terms, IDS)}
            yield pa.RecordBatch.from_pydict(columns | found)
        number += batch.num_rows


def _candidates(wanted, anywhere):
    """The places of the terms that may be disclosing ones, of the rows that have any, and
    whether such a row is ``named``, that is, has an identifier.

    In rows without an identifier only those that go anywhere count.
    """

    @textkernel.tidied
    def run(batches):
        keep, few = IdFilter(wanted.value), IdFilter(anywhere.value)
        for batch in batches:
            for a, b, cps, bounds in textkernel.chunks(textkernel.texts_of(batch)):
                first, last, term = _terms(cps, bounds)
                base = batch.column("base").slice(a, b - a).to_pylist()
                row = np.searchsorted(bounds, first, side="right") - 1
                held = np.array([bool(x) for x in base], bool)[row] if len(row) else np.zeros(0, bool)
                ok = few.has(term)
                ok[held] |= keep.has(term[held])
                first, last, term, row = first[ok], last[ok], term[ok], row[ok]
                cut = np.searchsorted(row, np.arange(b - a + 1))
                rows, named, near = [], [], []
                for r in np.unique(row).tolist():
                    lo, hi, at = int(cut[r]), int(cut[r + 1]), int(bounds[r])
                    f, l, t = first[lo:hi] - at, last[lo:hi] - at, term[lo:hi]
                    out = _outside([(x["start"], x["kind"], x["end"]) for x in base[r]], f, l)
                    rows.append(a + r)
                    named.append(bool(base[r]))
                    near.append([{"term": x, "start": y, "end": z} for x, y, z in zip(t[out].tolist(), f[out].tolist(), l[out].tolist(), strict=True)])
                if rows:
                    yield pa.RecordBatch.from_pydict({"row_no": batch.column("row_no").take(pa.array(rows)), "named": pa.array(named), "near": pa.array(near, NEAR)})

    return run


def _split(held, maybe: bool):
    """The rows whose number may be in the filter, or the others, which have no terms."""

    def run(batches):
        keep = IdFilter(held.value)
        for batch in batches:
            at = np.flatnonzero(keep.has(batch.column("row_no").to_numpy()) == maybe)
            batch = batch.take(pa.array(at))
            yield batch if maybe else batch.append_column("terms", pa.array([[]] * len(at), TERMS))

    return run


def _term_counts(wanted):
    """In how many of a task's documents each wanted term stands."""

    @textkernel.tidied
    def run(batches):
        keep = IdFilter(wanted.value)
        got, n = [], 0
        for batch in batches:
            for _, _, cps, bounds in textkernel.chunks(batch.column("text")):
                first, _, term = _terms(cps, bounds)
                ok = keep.has(term)
                pairs = np.unique(np.stack([term[ok], np.searchsorted(bounds, first[ok], side="right")]), axis=1)
                got.append(pairs[0])
                n += len(pairs[0])
            if n > 1_000_000:
                yield _counted(got)
                got, n = [], 0
        if n:
            yield _counted(got)

    return run


def _counted(got: list[np.ndarray]) -> pa.RecordBatch:
    terms, n = np.unique(np.concatenate(got), return_counts=True)
    return pa.RecordBatch.from_pydict({"term": pa.array(terms), "n": pa.array(n.astype(np.int64))})


def disclosing_terms(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, removed, anywhere) of the terms that disclose some entity enough."""
    spark = found.sparkSession
    held = found.filter(F.size("entities") > 0)
    total = float(texts.count())
    owns = held.select("row_no", F.explode("entities").alias("entity"))
    n_c = owns.groupBy("entity").agg(F.count("*").alias("n_c"))
    terms = held.select("row_no", F.explode("terms").alias("term"))
    wanted = spark.sparkContext.broadcast(id_filter(terms.select(F.col("term").alias("id")).distinct()).bits)
    n_t = settle(texts.mapInArrow(_term_counts(wanted), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t")), "terms")

    # PMI is log2(N / max(n_c, n_t)) at most, so a more frequent term cannot reach GENERALISE, whatever n_ct.
    def most(n):
        return F.lit(1.0001) * F.pow(F.lit(total), F.lit(1 - GENERALISE)) * F.pow(n, F.lit(GENERALISE))

    owns = owns.join(n_c, "entity")
    bound = owns.groupBy("row_no").agg(most(F.max("n_c")).alias("most"))
    rare = terms.join(n_t, "term").join(bound, "row_no").filter(F.col("n_t") <= F.col("most")).select("row_no", "term", "n_t")
    pairs = rare.join(owns, "row_no").filter(F.col("n_t") <= most(F.col("n_c")))
    pairs = pairs.groupBy("entity", "term", "n_c", "n_t").agg(F.count("*").alias("n_ct"))
    pmi = F.log2(F.lit(total) * F.col("n_ct") / (F.col("n_c").cast("double") * F.col("n_t")))
    scored = pairs.withColumn("share", F.try_divide(pmi, F.log2(F.lit(total) / F.col("n_c")))).filter(F.col("share") >= GENERALISE)
    return scored.groupBy("term").agg((F.max("share") >= REMOVE).alias("removed"), F.max(2 * F.col("n_ct") >= F.col("n_t")).alias("anywhere"))


def _located(documents: DataFrame, carry: list[str], finish: Callable[[Iterator], Iterator], out: list[StructField]) -> DataFrame:
    """What ``finish`` makes of batches of (row, base, terms), as columns ``out``; ``row`` holds the
    columns ``carry`` as one, so that no name of theirs can clash."""
    spark = documents.sparkSession
    own = [] if "text" in carry else ["text"]
    rows = documents.select(*own, F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"))
    held = [StructField(c, ArrayType(LongType())) for c in ("entities", "terms")]
    # The text is kept for the terms' places, once.
    found = settle(rows.mapInArrow(_mentions, StructType([*rows.schema, ROW_NO, SPANS, *held])), "found")
    flagged = settle(disclosing_terms(found, documents.select("text")), "disclosing")
    filters = [spark.sparkContext.broadcast(id_filter(x.select(F.col("term").alias("id"))).bits) for x in (flagged, flagged.filter("anywhere"))]
    near = found.select(*(own or ["row"]), "row_no", "base").mapInArrow(_candidates(*filters), StructType([ROW_NO, NAMED, PLACES]))
    each = near.select("row_no", "named", F.explode("near").alias("x")).select("row_no", "named", "x.*").join(flagged, "term").filter("anywhere or named")
    terms = settle(each.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("start", "end", "removed"))).alias("terms")), "terms")
    some = spark.sparkContext.broadcast(id_filter(terms.select(F.col("row_no").alias("id"))).bits)
    # Only rows that may have terms meet them in a join; the others pass in one step.
    read = found.select("row", "row_no", "base")
    doubt = read.mapInArrow(_split(some, True), read.schema).join(terms, "row_no", "left").select("row", "base", F.coalesce("terms", F.array().cast(CHOSEN.dataType)).alias("terms"))
    passed = _split(some, False)
    return read.mapInArrow(lambda batches: finish(passed(batches)), StructType(out)).unionByName(doubt.mapInArrow(finish, StructType(out)))


def _kept(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("row", "base", "terms")})


def find_personal_data(documents: DataFrame, carry: list[str]) -> DataFrame:
    """Columns ``carry`` of each row, base spans, and terms: the places of those that disclose an entity.

    base is array<struct<start, kind, end>> by start and kind, terms is
    array<struct<start, end, removed>>; positions are code points, ends exclusive.
    A null text counts as empty and has neither. Repeated rows are found alike and
    each count as a document. Columns that are not carried are not read. An empty table
    gives no rows.
    """
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")).schema["row"]
    return _located(documents, carry, _kept, [row, SPANS, CHOSEN]).select("row.*", "base", "terms")


def _redact(batches):
    for batch in batches:
        out = []
        for text, base, terms in zip(batch.column("row").field("text").to_pylist(), batch.column("base").to_pylist(), batch.column("terms").to_pylist(), strict=True):
            if text is None or not (base or terms):
                out.append(text)
                continue
            cuts = [(x["start"], x["end"], MASKS[x["kind"]]) for x in base]
            for x in terms:
                word = text[x["start"] : x["end"]]
                cuts.append((x["start"], x["end"], "<TERM>" if x["removed"] else "<NAME>" if word[:1].isupper() else "<WORD>"))
            parts, at = [], 0
            for s, e, mask in sorted(cuts):
                if s >= at:
                    parts += [text[at:s], mask]
                at = max(at, e)
            out.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "clean": pa.array(out, pa.string())})


def sanitise(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` with identifiers masked and disclosing terms removed or
    generalised in ``text``; all columns stay.

    Null and empty texts stay as they are; repeated rows are changed alike. An empty
    table gives no rows.
    """
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")).schema["row"]
    clean = _located(documents, documents.columns, textkernel.tidied(_redact), [row, StructField("clean", StringType())])
    return clean.select(*[F.col("clean").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in documents.columns])


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``find_personal_data`` in all of ``documents``, as counts, digest and spans; odd rows as stated there."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"])
    count = [_count(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    terms = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), x["end"].alias("end")))
    spans = F.array_sort(F.concat("base", terms))
    return found.select("doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"))
