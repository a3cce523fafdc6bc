"""Scores of retrieval and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(results: DataFrame) -> DataFrame:
    """Adds precision and recall over the arrays ``retrieved`` and ``truth``; 0 where a side is empty."""
    hit = F.size(F.array_intersect("retrieved", "truth")).cast("double")
    ratio = lambda n: F.when(F.size(n) > 0, hit / F.size(n)).otherwise(0.0)
    return results.withColumn("precision", ratio("retrieved")).withColumn("recall", ratio("truth"))


def macro(scores: DataFrame) -> DataFrame:
    """avg_precision, avg_recall and f1, the harmonic mean of the two averages."""
    p, r = F.avg("precision"), F.avg("recall")
    f1 = F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(0.0)
    return scores.agg(F.round(p, 6).alias("avg_precision"), F.round(r, 6).alias("avg_recall"), F.round(f1, 6).alias("f1"))


def sweep(ranked: DataFrame, truth: DataFrame, n_queries: DataFrame, longest: int) -> DataFrame:
    """k, avg_precision, avg_recall, f1 for k = 1 .. ``longest`` from one ranked list.

    ``ranked`` has (query_id, doc_id, rank), ``truth`` (query_id, doc_id). Precision is
    over k itself; queries without truth add nothing but count in the averages.
    """
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("n_truth"))
    hits = ranked.join(truth, ["query_id", "doc_id"]).select("query_id", "rank")
    ks = ranked.sparkSession.range(1, longest + 1).select(F.col("id").cast("int").alias("k"))
    each = F.broadcast(ks).join(hits, F.col("rank") <= F.col("k"), "left").groupBy("k", "query_id").agg(F.count("rank").alias("hits"))
    part = each.join(sizes, "query_id", "left").groupBy("k").agg(F.sum(F.col("hits") / F.col("k")).alias("p"), F.sum(F.col("hits") / F.col("n_truth")).alias("r"))
    part = part.crossJoin(F.broadcast(n_queries)).select("k", (F.coalesce("p", F.lit(0.0)) / F.col("n")).alias("p"), (F.coalesce("r", F.lit(0.0)) / F.col("n")).alias("r"))
    f1 = F.when((F.col("p") > 0) & (F.col("r") > 0), 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return part.select("k", F.round("p", 6).alias("avg_precision"), F.round("r", 6).alias("avg_recall"), F.round(f1, 6).alias("f1"))


def contingency(pairs: DataFrame) -> DataFrame:
    """(u, v, n, a, b, total): joint and marginal counts of two labels."""
    n = pairs.groupBy("u", "v").agg(F.count("*").alias("n"))
    a, b = n.groupBy("u").agg(F.sum("n").alias("a")), n.groupBy("v").agg(F.sum("n").alias("b"))
    return n.join(a, "u").join(b, "v").crossJoin(F.broadcast(n.agg(F.sum("n").alias("total"))))


def nmi(pairs: DataFrame) -> DataFrame:
    """Normalised mutual information of labels u and v, over the mean of their entropies; 1 if both are constant."""
    c = contingency(pairs)
    t = F.col("total").cast("double")
    mi = c.agg(F.sum(F.col("n") / t * F.ln(F.col("n") * t / (F.col("a") * F.col("b")))).alias("mi"))
    h = lambda k, m: c.select(k, m, "total").distinct().agg(F.sum(-F.col(m) / t * F.ln(F.col(m) / t)).alias(f"h{k}"))
    one = mi.crossJoin(h("u", "a")).crossJoin(h("v", "b"))
    mean = (F.col("hu") + F.col("hv")) / 2
    return one.select(F.round(F.when(mean == 0, 1.0).otherwise(F.try_divide(F.col("mi"), mean)), 6).alias("nmi"))


def ari(pairs: DataFrame) -> DataFrame:
    """Adjusted Rand index of labels u and v; 1 if both put all rows alike."""
    c = contingency(pairs)
    two = lambda x: F.col(x).cast("double") * (F.col(x) - 1) / 2
    joint = c.agg(F.sum(two("n")).alias("i"), F.max(two("total")).alias("t"))
    left, right = c.select("u", "a").distinct().agg(F.sum(two("a")).alias("x")), c.select("v", "b").distinct().agg(F.sum(two("b")).alias("y"))
    one = joint.crossJoin(left).crossJoin(right)
    expected = F.try_divide(F.col("x") * F.col("y"), F.col("t"))
    spread = (F.col("x") + F.col("y")) / 2 - expected
    return one.select(F.round(F.when(spread == 0, 1.0).otherwise(F.try_divide(F.col("i") - expected, spread)), 6).alias("ari"))
