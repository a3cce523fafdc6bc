"""Repeated passages by sparse suffix arrays.

Of all suffixes of a text (in words, A-Z folded) only those at minimisers stay: the
positions whose hash of ``GRAM`` words is the least in some window of ``WINDOW``
positions. Equal passages choose equal positions, and every passage of ``LEAST`` words
has one in its first ``WINDOW``. Suffixes whose first ``KEY`` words stand nowhere else
go. Around each of the others every stretch of ``LEAST`` words that holds its key is
counted by its hash, so all repeated stretches are found, whatever else shares their
key; those that stand twice or more are the passages.

Counts are combined before they are dealt out, and no group of equal stretches is ever
gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textkernel
from threadloom.llm.jaccard_join import IdFilter, id_filter
from threadloom.session import settle

LEAST = 50
GRAM, WINDOW, KEY = 8, 32, 16


def minimisers(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions that are the last least of some window; texts with fewer positions than a window have one window."""
    out = []
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    # Windows that cross a text's end are left out.
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    full = np.flatnonzero(room >= WINDOW)
    if len(full):
        order = np.argsort(grams, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        key = rank.copy()
        width = 1
        while width * 2 <= WINDOW:
            key[: n - width] = np.minimum(key[: n - width], key[width:])
            width *= 2
        out.append(order[np.unique(key[full])])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if 0 < b - a < WINDOW:
            out.append(np.array([a + int(np.argmin(grams[a:b]))]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _anchors(texts: pa.Array):
    """Per chunk: (first row, row bounds, word hashes, anchor positions, their rows, their keys)."""
    for a, b, cps, bounds in textkernel.chunks(texts):
        h, _, _, rb = textkernel.word_hashes(cps, bounds)
        grams = textkernel.gram_hashes(h, GRAM)
        counts = np.maximum(np.diff(rb) - GRAM + 1, 0)
        row, pos = textkernel.positions_in_rows(rb, GRAM)
        at = pos[minimisers(grams[pos], np.concatenate([[0], np.cumsum(counts)]))]
        row = np.searchsorted(rb, at, side="right") - 1
        keep = at + KEY <= rb[row + 1]
        at, row = at[keep], row[keep]
        yield a, b, rb, h, at, row, textkernel.gram_hashes(h, KEY)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)


@textkernel.tidied
def _keys(batches):
    for batch in batches:
        for *_, key in _anchors(batch.column("text")):
            yield pa.RecordBatch.from_pydict({"id": pa.array(key)})


def _stretches(texts: pa.Array, keep: IdFilter):
    """Per chunk: (first row, row bounds, start, row and hash of each stretch of LEAST words that holds a wanted key)."""
    for a, _, rb, h, at, row, key in _anchors(texts):
        ok = keep.has(key)
        at, row = at[ok], row[ok]
        low, high = np.maximum(at - (LEAST - KEY), rb[row]), np.minimum(at, rb[row + 1] - LEAST) + 1
        some = low < high
        change = np.zeros(len(h) + 1, np.int64)
        np.add.at(change, low[some], 1)
        np.add.at(change, high[some], -1)
        start = np.flatnonzero(np.cumsum(change)[:-1])
        yield a, rb, start, np.searchsorted(rb, start, side="right") - 1, textkernel.gram_hashes(h, LEAST)[start].view(np.int64)


def _counts(wanted):
    @textkernel.tidied
    def run(batches):
        keep = IdFilter(wanted.value)
        held, size = [], 0
        for batch in batches:
            for *_, hashes in _stretches(batch.column("text"), keep):
                held.append(hashes)
                size += len(hashes)
                if size > 2_000_000:
                    yield from _counted(held)
                    held, size = [], 0
        yield from _counted(held)

    return run


def _counted(held: list[np.ndarray]):
    if held:
        ids, n = np.unique(np.concatenate(held), return_counts=True)
        for i in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[i : i + 100_000]), "n": pa.array(n[i : i + 100_000].astype(np.int64))})


PLACE = "id long, row_no long, doc_id long, pos int"


def _places(wanted, repeated):
    @textkernel.tidied
    def run(batches):
        keep, again = IdFilter(wanted.value), IdFilter(repeated.value)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id")
            for a, rb, start, row, hashes in _stretches(batch.column("text"), keep):
                ok = again.has(hashes)
                start, row, hashes = start[ok], row[ok], hashes[ok]
                out = pa.RecordBatch.from_pydict({"id": pa.array(hashes), "row_no": pa.array(row + a + number), "doc_id": ids.take(pa.array(row + a)), "pos": pa.array((start - rb[row]).astype(np.int32))})
                for i in range(0, len(start), 100_000):
                    yield out.slice(i, 100_000)
            number += batch.num_rows

    return run


def _spans(batches):
    """Places of each row, joined where they touch."""
    for batch in batches:
        spans = []
        for at in batch.column("at").to_pylist():
            at = np.sort(np.array(at, np.int64))
            new = np.flatnonzero(np.diff(at, prepend=at[0] - LEAST - 1) > LEAST)
            spans.append([{"start": x, "end": y} for x, y in zip(at[new].tolist(), (at[np.append(new[1:], len(at)) - 1] + LEAST).tolist(), strict=True)])
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array([sum(x["end"] - x["start"] for x in own) for own in spans], pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})


def repeated_passages(documents: DataFrame) -> DataFrame:
    """doc_id, n_words (repeated ones) and spans of each document row that has any.

    spans is array<struct<start, end>> of word positions, ends exclusive: the passages of
    at least LEAST words that stand elsewhere too, in another row or in the same one
    (two places that overlap count as well). Texts that are null, empty or shorter have none.
    Repeated rows repeat each other; a null doc_id stays null. Other columns are not
    read. An empty table gives no rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = settle(docs.select("text").mapInArrow(_keys, "id long").groupBy("id").count().filter("count > 1").select("id"), "keys")
    wanted = spark.sparkContext.broadcast(id_filter(repeated).bits)
    counts = docs.select("text").mapInArrow(_counts(wanted), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    twice = settle(counts.filter("n > 1").select("id"), "stretches")
    again = spark.sparkContext.broadcast(id_filter(twice).bits)
    # The filter lets some others through; the join does not.
    places = docs.mapInArrow(_places(wanted, again), PLACE).join(twice.hint("merge"), "id")
    rows = places.groupBy("row_no", "doc_id").agg(F.collect_list("pos").alias("at"))
    return rows.mapInArrow(_spans, "doc_id long, n_words long, spans array<struct<start: int, end: int>>")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repeated_passages`` of all of ``documents``; odd rows as stated there."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
