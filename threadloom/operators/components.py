"""Connected components of a link table, as DataFrame rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import settle


#: Links that one task contracts at a time.
BATCH = 500_000


def _stars(batches):
    """The same components in fewer links: each batch's groups as stars around their smallest id."""

    def contract(a, b):
        ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = ends[: len(a)], ends[len(a) :]
        root = np.arange(len(ids))
        while True:
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            np.minimum.at(root, before, root)
            root = root[root]
            if (root == before).all():
                break
        other = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_pydict({"a": pa.array(ids[other]), "b": pa.array(ids[root[other]])})

    held, n = [], 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n >= BATCH:
            yield contract(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield contract(*map(np.concatenate, zip(*held, strict=True)))


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (columns a, b): root is the smallest id that links reach.

    Alternates the large-star and small-star steps: every id points its larger
    neighbours, then itself and its smaller ones, at its smallest neighbour. Each
    step keeps at most as many links as it got, is written to the shared folder, and
    the number of rounds grows with the logarithm of the longest path. Neighbour
    minima come from map-side combined aggregates, so no group is ever gathered.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = settle(links.mapInArrow(_stars, "a long, b long").distinct().repartition("a").mapInArrow(_stars, "a long, b long"), "links")
    before = None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        least = least.select("k", F.least("k", "m").alias("m"))
        large = both.join(least, both.a == least.k).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(low, large.a == low.k).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")
        )
        links = settle(small.select("x.a", "x.b").filter("a <> b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).union(links.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
