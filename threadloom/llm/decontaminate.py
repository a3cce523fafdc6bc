"""Benchmark decontamination by spaced seeds.

Tokens are runs of letters and digits in lower case. A seed is the hash of the
tokens that a fixed mask keeps of a window of tokens, so a substitution at an ignored
position leaves it as it is. The masks together meet every stretch that can be a leak
(tested). Where a document's seed equals one of a benchmark item, the two are laid side
by side at that offset; of the overlap's stretches with at least ``IDENTITY`` of their
tokens equal the one with most equal tokens is taken, and it is a leak if at least
``MIN_MATCH`` are, or ``IDENTITY`` of a short item's. Short items have masks of their own.

The benchmark is joined from memory in slices of at most ``SLICE_TOKENS`` tokens; a
larger one takes a pass over the documents for each slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textkernel
from threadloom.llm.textkernel import LETTER, NUMBER

#: 1 keeps a token, 0 ignores it (fixed values).
SEED_MASKS = ("11101011", "110100111", "1100110101", "10100001111")
#: Masks of items of fewer tokens than MIN_MATCH, by the least number of tokens (fixed values).
SHORT_MASKS = {5: ("1101", "1011"), 6: ("11101", "10111"), 10: ("111101", "111011", "10100111")}
MIN_MATCH = 12
IDENTITY = 0.8
#: Shorter items match far too much to say anything; they are left out.
MIN_ITEM = 5
SLICE_TOKENS = 2_000_000
#: A match's and a mismatch's share of a sum that is at least 0 from IDENTITY on.
MATCHED, OTHERWISE = 100 - round(100 * IDENTITY), -round(100 * IDENTITY)
_ROLL = np.array([pow(0x9FB21C651E98DF25, k + 1, 1 << 64) for k in range(64)], np.uint64)


def tokens(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row bounds) of the tokens of each text."""
    kind = textkernel.look(textkernel.unicode_tables()[0], cps)
    word = (kind == LETTER) | (kind == NUMBER)
    edge = np.zeros(len(cps) + 1, bool)
    edge[bounds] = True
    first = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    last = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
    return textkernel.span_hashes(textkernel.lowered(cps), first, last), first, last, np.searchsorted(first, bounds)


def masks_of(size: int) -> tuple[str, ...]:
    """The masks that meet every leak of an item of so many tokens."""
    return SEED_MASKS if size >= MIN_MATCH else SHORT_MASKS[max(k for k in SHORT_MASKS if k <= size)]


def least_match(size: int) -> int:
    """Equal tokens that make a leak of an item of so many."""
    return min(MIN_MATCH, -(-round(100 * IDENTITY) * size // 100))


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """A seed for each position from which the whole mask fits into ``h``."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, sum(1 << i for i, c in enumerate(mask) if c == "1"), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out += h[i : i + m] * _ROLL[i]
    return textkernel.mix(out)


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the stretch with most matches of all whose identity is at least IDENTITY; of several the shortest."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    # Stretches go from match to match: up to each match with it, and without it.
    total = np.cumsum(np.where(same, MATCHED, OTHERWISE))[at]
    # For each first match, the last one from which the sum is still not negative.
    high = np.maximum.accumulate(total[::-1])
    last = len(at) - 1 - np.searchsorted(high, total - MATCHED)
    n = last - np.arange(len(at)) + 1
    k = int(np.lexsort((at[last] - at, -n))[0])
    return int(at[k]), int(at[last[k]]) + 1, int(n[k])


class Index:
    """Seeds of some benchmark items, sorted, with the item and offset of each."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.tokens = [], []
        seed, item, offset, masks = [], [], [], set()
        for id_, text in items:
            cps = textkernel.code_points(text)
            h = tokens(cps, np.array([0, len(cps)]))[0]
            if len(h) < MIN_ITEM:
                continue
            for m in masks_of(len(h)):
                masks.add(m)
                s = seeds(h, m)
                seed.append(s)
                item.append(np.full(len(s), len(self.ids)))
                offset.append(np.arange(len(s)))
            self.ids.append(id_)
            self.tokens.append(h)
        self.masks = sorted(masks, key=lambda m: (len(m), m))
        self.seed = np.concatenate(seed) if seed else np.zeros(0, np.uint64)
        order = np.argsort(self.seed, kind="stable")
        self.seed = self.seed[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int64))[order]
        self.offset = (np.concatenate(offset) if offset else np.zeros(0, np.int64))[order]
        size = 1 << int(np.clip(np.ceil(np.log2(64 * max(len(self.seed), 16))), 16, 28))
        self.mask = np.uint64(size - 1)
        flags = np.zeros(size, bool)
        flags[(self.seed & self.mask).astype(np.int64)] = True
        self.bits = np.packbits(flags, bitorder="little")

    def may_hold(self, s: np.ndarray) -> np.ndarray:
        """Whether each seed may be one of the index."""
        at = (s & self.mask).astype(np.int64)
        return (self.bits.take(at >> 3) >> (at & 7).astype(np.uint8)) & 1 > 0

    def leaks(self, cps: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(row, item, start, end, matching tokens, identity) of each row and item with a leak; positions are characters of the row."""
        if not self.ids:
            return
        h, first, last, rb = tokens(cps, bounds)
        found = []
        for m in self.masks:
            s = seeds(h, m)
            at = np.flatnonzero(self.may_hold(s))
            if not len(at):
                continue
            row = np.searchsorted(rb, at, side="right") - 1
            ok = at + len(m) <= rb[row + 1]
            at, row = at[ok], row[ok]
            lo, hi = np.searchsorted(self.seed, s[at], side="left"), np.searchsorted(self.seed, s[at], side="right")
            n = hi - lo
            k = textkernel.ragged(lo, n)
            found.append(np.stack([np.repeat(row, n), self.item[k], np.repeat(at - rb[row], n) - self.offset[k]], 1))
        if not found:
            return
        best: dict[tuple[int, int], tuple[int, int, int, float]] = {}
        for row, item, diagonal in np.unique(np.concatenate(found), axis=0).tolist():
            a, b = int(rb[row]), int(rb[row + 1])
            own = self.tokens[item]
            x, y = max(0, -diagonal), min(len(own), b - a - diagonal)
            if y <= x:
                continue
            same = h[a + diagonal + x : a + diagonal + y] == own[x:y]
            start, end, match = best_stretch(same)
            if match >= least_match(len(own)):
                i, j = a + diagonal + x + start, a + diagonal + x + end - 1
                got = (match, int(first[i] - bounds[row]), int(last[j] - bounds[row]), match / (end - start))
                if got > best.get((row, item), (0, 0, 0, 0.0)):
                    best[row, item] = got
        for (row, item), (match, s, e, identity) in sorted(best.items()):
            yield row, self.ids[item], s, e, match, identity


def slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in slices whose texts fit into the bound."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        if held and size + len(r.text) > 2 * SLICE_TOKENS:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    if held:
        yield held


def _find(shared):
    @textkernel.tidied
    def run(batches):
        index = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for a, _, cps, bounds in textkernel.chunks(batch.column("text")):
                rows = [(ids[a + r].as_py(), *rest) for r, *rest in index.leaks(cps, bounds)]
                if rows:
                    names = ("doc_id", "item_id", "start", "end", "n_match", "identity")
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, t, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})

    return run


LEAK = "doc_id long, item_id long, start long, end long, n_match long, identity double"


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, n_match and identity: the best stretch of each document row and item that leaks.

    Positions are code points, ends exclusive. Null or empty texts leak nothing; items
    with a null text or fewer than ``MIN_ITEM`` tokens are left out. Repeated rows and
    items give repeated rows; a null doc_id stays null. No leaks, or an empty table on
    either side, give no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], LEAK)
    for items in slices(benchmark):
        out = out.union(docs.mapInArrow(_find(spark.sparkContext.broadcast(Index(items))), LEAK))
    return out


def _clean(shared):
    @textkernel.tidied
    def run(batches):
        index = shared.value
        for batch in batches:
            bad: set[int] = set()
            for a, _, cps, bounds in textkernel.chunks(batch.column("text")):
                bad.update(a + r for r, *_ in index.leaks(cps, bounds))
            yield batch.take(pa.array([r for r in range(batch.num_rows) if r not in bad], pa.int64())) if bad else batch

    return run


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` (all columns) in which no benchmark item leaks.

    Null and empty texts stay; rows are judged one by one, so repeated rows go or stay
    together. An empty table on either side changes nothing.
    """
    spark = documents.sparkSession
    for items in slices(benchmark):
        documents = documents.mapInArrow(_clean(spark.sparkContext.broadcast(Index(items))), documents.schema)
    return documents


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``find_leaks`` of all of ``benchmark`` in all of ``documents``; odd rows as stated there."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
