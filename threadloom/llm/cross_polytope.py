"""Approximate nearest neighbours by cross-polytope hashing with multiprobe.

A unit vector is rotated by sign flips and fast Hadamard transforms, three of each,
and hashed to the nearest signed axis; two rotations together give a vector its bucket
in one of ``tables`` tables. A query looks into the buckets of each table whose axes are
nearest to it, and all vectors found there are ranked by exact Euclidean distance on
the original vectors. The number of buckets does not depend on how many vectors there
are: whether they meet is up to a query and a vector alone, and rows added elsewhere
hide no neighbour of a query that finds k.

The index holds every vector with its bucket in each table. Queries meet it in blocks
of ``BLOCK``: a block's probes are sorted by bucket in each table, and each vector of a
task's part of the index looks up its own buckets there. What is found is ranked, and a
task gives at most k rows per query to the final ranking. Equal vectors are one entry
with its smallest ids (one more than the answers asked for), as no other copy can be
among the answers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.textkernel import ragged, tidied
from threadloom.session import settle

TABLES = 64
#: Buckets of a table that a query looks into.
PROBES = 64
BLOCK = 2048
#: Vectors that are rotated, and that meet a block, at a time.
ROTATED, MET = 256, 1024
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the last axis, in place; its width is a power of two."""
    d, h = x.shape[-1], 1
    while h < d:
        y = x.reshape(-1, d // (2 * h), 2, h)
        a, b = y[:, :, 0], y[:, :, 1]
        low = a - b
        a += b
        b[...] = low
        h *= 2
    return x


def rotations(x: np.ndarray, count: int):
    """Pseudo-random rotations of the rows, scaled to unit length before: (row, rotation, signed axis) in pieces of rows."""
    d = 1 << max(1, int(np.ceil(np.log2(max(2, x.shape[1])))))
    signs = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (3, count, d))
    for k in range(0, len(x), ROTATED):
        part = x[k : k + ROTATED]
        unit = part / np.abs(part).max(1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        unit = np.pad(unit, ((0, 0), (0, d - x.shape[1]))).astype(np.float32)
        y = np.repeat(unit[:, None, :], count, 1)
        for own in signs:
            y *= own
            y = hadamard(y)
        y /= np.float32(d**1.5)
        yield np.concatenate([y, -y], axis=2)


def codes(x: np.ndarray, tables: int) -> np.ndarray:
    """(row, table): the bucket of each vector."""
    out = [np.zeros((0, tables), np.int32)]
    for y in rotations(x, 2 * tables):
        axes = y.argmax(2).reshape(len(y), tables, 2)
        out.append((axes[..., 0] * y.shape[2] + axes[..., 1]).astype(np.int32))
    return np.concatenate(out)


def probe_codes(x: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """(row, table, probe): the buckets whose two axes are nearest to each query."""
    out = []
    for y in rotations(x, 2 * tables):
        n, width = len(y), y.shape[2]
        m = min(width, probes)
        k = min(probes, m * m)
        # (i + 1) * (j + 1) pairs are at least as near as the pair of the i-th and the j-th nearest axis.
        first, second = np.nonzero(np.outer(np.arange(1, m + 1), np.arange(1, m + 1)) <= probes)
        axes = np.argsort(-y, 2)[..., :m].reshape(n, tables, 2, m)
        value = np.take_along_axis(y, axes.reshape(n, 2 * tables, m), 2).reshape(n, tables, 2, m)
        both = value[:, :, 0, first] + value[:, :, 1, second]
        best = np.argpartition(-both, k - 1, axis=2)[..., :k]
        out.append((np.take_along_axis(axes[:, :, 0], first[best], 2) * width + np.take_along_axis(axes[:, :, 1], second[best], 2)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros((0, tables, probes), np.int32)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _indexed(tables: int):
    @tidied
    def run(batches):
        for batch in batches:
            widths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths).tolist():
                same = batch.take(pa.array(np.flatnonzero(widths == width)))
                for a in range(0, same.num_rows, 2048):
                    part = same.slice(a, 2048)
                    c = codes(matrix(part.column("v")), tables)
                    offsets = pa.array(np.arange(0, c.size + 1, tables, dtype=np.int32))
                    yield pa.RecordBatch.from_pydict({"v": part.column("v"), "ids": part.column("ids"), "codes": pa.ListArray.from_arrays(offsets, pa.array(c.ravel()))})

    return run


class Best:
    """The k nearest found of each of n queries: distances and ids, nearest first."""

    def __init__(self, n: int, k: int):
        self.k, self.d, self.ids = k, np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(query)
        at = np.searchsorted(rows, query)
        held = np.repeat(np.arange(len(rows)), self.k)
        at, d, ids = np.concatenate([held, at]), np.concatenate([self.d[rows].ravel(), d]), np.concatenate([self.ids[rows].ravel(), ids])
        order = np.lexsort((ids, d, at))
        at, d, ids = at[order], d[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, np.arange(len(rows)))[at]
        keep = place < self.k
        self.d[rows], self.ids[rows] = d[keep].reshape(-1, self.k), ids[keep].reshape(-1, self.k)


def _found(shared, k: int, everything: bool):
    """Per task and query of the block: the k nearest of the candidates."""

    @tidied
    def run(batches):
        qid, q, probes = shared.value
        n, tables, per = probes.shape
        best, length = Best(n, k), (q * q).sum(1)
        owner, buckets, owners = np.repeat(np.arange(n, dtype=np.int32), per), [], []
        for t in range(tables):
            order = np.argsort(probes[:, t].ravel(), kind="stable")
            buckets.append(probes[:, t].ravel()[order])
            owners.append(owner[order])
        for batch in batches:
            x, lists = matrix(batch.column("v")), batch.column("ids")
            c = batch.column("codes").flatten().to_numpy().reshape(-1, tables)
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            ids = lists.flatten().to_numpy()
            for a in range(0, len(x), MET):
                part = x[a : a + MET]
                hit = np.full((n, len(part)), everything)
                for t in range(0 if everything else tables):
                    own = c[a : a + MET, t]
                    lo, hi = np.searchsorted(buckets[t], own, "left"), np.searchsorted(buckets[t], own, "right")
                    hit[owners[t][ragged(lo, hi - lo)], np.repeat(np.arange(len(own)), hi - lo)] = True
                # A quick estimate leaves out what cannot be among the k nearest; distances themselves are exact.
                near = length[:, None] + (part * part).sum(1)[None, :] - 2 * (q @ part.T)
                limit = best.d[:, -1] ** 2
                slack = 1e-9 * (1 + length[:, None] + (part * part).sum(1)[None, :])
                p, v = np.nonzero(hit & (near <= limit[:, None] + slack))
                for i in range(0, len(p), 50_000):
                    query, row = p[i : i + 50_000], v[i : i + 50_000] + a
                    d = np.sqrt(((q[query] - x[row]) ** 2).sum(1))
                    size = starts[row + 1] - starts[row]
                    query, d, id_ = np.repeat(query, size), np.repeat(d, size), ids[ragged(starts[row], size)]
                    ok = id_ != qid[query]
                    if ok.any():
                        best.add(query[ok], d[ok], id_[ok])
        query, rank = np.nonzero(np.isfinite(best.d))
        if len(query):
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(qid[query], pa.int64()), "vec_id": pa.array(best.ids[query, rank], pa.int64()), "score": pa.array(best.d[query, rank])})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: neither null nor zero, all components finite."""
    got = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return got.filter("vec_id is not null and v is not null").filter(ok & F.exists("v", lambda x: x != 0))


def build_index(vectors: DataFrame, k: int, tables: int) -> DataFrame:
    """(v, ids, codes): every distinct vector with its k + 1 smallest ids and its buckets."""
    got = usable(vectors).distinct()
    # An entry's ids are ranked within hash classes first, so that no task gathers all ids of one vector.
    dealt = got.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    ranked = dealt.groupBy("v", "part").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("some"))
    entries = ranked.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, k + 1).alias("ids"))
    return settle(entries.mapInArrow(_indexed(tables), "v array<double>, ids array<long>, codes array<int>"), "index")


ROW = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest candidates found of each query, by exact distance.

    ``probes`` buckets of each of the index's ``tables`` are looked into. Both tables have vec_id and embedding; a query meets vectors of its own width only.
    A vector that shares the query's vec_id is no candidate. Ties go to the smaller
    vec_id. Null, zero and non-finite vectors, or those without a vec_id, take no part on
    either side. Repeated rows count once; of a vec_id with several vectors each counts,
    a candidate with its nearest. A query that finds fewer than k is compared with every
    vector. Empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    index = build_index(vectors, k, tables)
    asked = usable(queries).distinct().orderBy("vec_id")

    def search(rows: list, everything: bool) -> DataFrame:
        out = spark.createDataFrame([], ROW)
        for width in sorted({len(r.v) for r in rows}):
            own = [r for r in rows if len(r.v) == width]
            same = index.filter(F.size("v") == width)
            for a in range(0, len(own), BLOCK):
                q = np.array([r.v for r in own[a : a + BLOCK]])
                block = (np.array([r.vec_id for r in own[a : a + BLOCK]], np.int64), q, probe_codes(q, tables, 1 if everything else probes))
                out = out.union(same.mapInArrow(_found(spark.sparkContext.broadcast(block), k, everything), ROW))
        return settle(out, "found")

    results, held = [], []

    def flush():
        found = search(held, False)
        counts = {r.query_id: r.n for r in found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).collect()}
        lacking = [r for r in held if counts.get(r.vec_id, 0) < k]
        results.append(found)
        if lacking:
            results.append(search(lacking, True))

    for r in asked.toLocalIterator():
        held.append(r)
        if len(held) == 8 * BLOCK:
            flush()
            held = []
    if held:
        flush()
    out = spark.createDataFrame([], ROW)
    for r in results:
        out = out.union(r)
    out = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nearest`` of the vectors whose id is divisible by 100 among all of ``embeddings``; odd rows as stated there."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
