"""Writers of graphs, communities, knowledge bases and run results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import settle


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def write_communities(communities: DataFrame, members: DataFrame, path: str, resolution: float, threshold: float) -> None:
    """One folder per run of parameters; a run that is repeated replaces its own folder only."""
    for name, df in (("communities", communities), ("members", members)):
        df.write.mode("overwrite").parquet(f"{path}/{name}/resolution={resolution}/threshold={threshold}")


def read_communities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(communities, members) of all runs, with the columns resolution and threshold."""
    return spark.read.parquet(f"{path}/communities"), spark.read.parquet(f"{path}/members")


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Summaries of communities as Parquet and, beside it, as JSON."""
    summaries.write.mode("overwrite").parquet(f"{path}/parquet")
    summaries.write.mode("overwrite").json(f"{path}/json")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/parquet")


def write_metrics(metrics: DataFrame, path: str, resolution: float, threshold: float) -> None:
    """Scores of a clustering run as one JSON folder per run of parameters, replaced when repeated."""
    metrics.write.mode("overwrite").json(f"{path}/resolution={resolution}/threshold={threshold}")


def write_text_units(units: DataFrame, path: str) -> None:
    units.write.mode("overwrite").parquet(path)


def upsert_kb(docs: DataFrame, path: str, kb: str, refresh: bool = False, key: str | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Adds documents to a knowledge base, after emptying it if ``refresh``.

    ``embed`` adds the embeddings. With a ``key``, documents take the place of those that have
    the same one: what stays and what is new is written beside the old folder first.
    """
    docs = embed(docs) if embed else docs
    folder = f"{path}/kb={kb}"
    if refresh or not key:
        docs.write.mode("overwrite" if refresh else "append").parquet(folder)
        return
    spark = docs.sparkSession
    known = open_kb(spark, path, kb)
    if known is not None:
        docs = settle(known.join(docs.select(key), key, "left_anti").unionByName(docs, allowMissingColumns=True), "kb")
    docs.write.mode("overwrite").parquet(folder)


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def open_kb(spark: SparkSession, path: str, kb: str) -> DataFrame | None:
    """The documents of a knowledge base by name; None if there is none."""
    files, target = _folder(spark, f"{path}/kb={kb}")
    return spark.read.parquet(f"{path}/kb={kb}") if files.exists(target) else None


def drop_kb(spark: SparkSession, path: str, kb: str) -> bool:
    """Removes a knowledge base; whether there was one."""
    files, target = _folder(spark, f"{path}/kb={kb}")
    return bool(files.delete(target, True))


def kb_stats(spark: SparkSession, path: str) -> DataFrame:
    """kb and its number of documents, with the total under a null kb."""
    return spark.read.parquet(path).rollup("kb").agg(F.count("*").alias("n"))


def write_runs(results: DataFrame, path: str) -> None:
    results.write.mode("append").partitionBy("top_k").json(path)


def write_chunk_texts(chunks: DataFrame, path: str) -> None:
    """A text folder per chunk; chunks without id or text are left out."""
    rows = chunks.filter("chunk_id is not null and concat_text is not null").select("chunk_id", F.col("concat_text").alias("value"))
    rows.write.mode("overwrite").partitionBy("chunk_id").text(path)
