"""Whole paths through the engine: settings, extraction to graph, summaries, answers and sweeps."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.functions.providers import Completion, complete
from threadloom.operators import communities, graph


@dataclass(frozen=True)
class Settings:
    """What a run depends on; credentials come from the environment only."""

    top_k: int = 5
    top_k_communities: int = 3
    score_threshold: float = 0.5
    chunk_size: int = 750
    chunk_overlap: int = 150
    resolution: float = 1.0
    conductance_threshold: float = 0.3
    max_iterations: int = 7
    key_variable: str = "MODEL_API_KEY"
    extra: dict[str, str] = field(default_factory=dict)

    def merged(self, values: dict) -> Settings:
        """These settings with those of ``values`` that have a field; others go to ``extra``."""
        known = {k: v for k, v in values.items() if k in self.__dataclass_fields__}
        rest = {k: str(v) for k, v in values.items() if k not in known}
        return replace(self, **known, extra=self.extra | rest)

    @property
    def api_key(self) -> str | None:
        return os.environ.get(self.key_variable)


def safe_path(root: str, name: str) -> str:
    """``name`` below ``root``; ValueError if it leads outside."""
    root = os.path.realpath(root)
    path = os.path.realpath(os.path.join(root, name))
    if os.path.commonpath([root, path]) != root:
        raise ValueError(f"{name!r} leads out of {root!r}")
    return path


STAGES: dict[str, Callable[..., DataFrame]] = {}


def stage(name: str):
    """Registers a stage of an index under its name."""

    def add(f):
        STAGES[name] = f
        return f

    return add


REPLY = "entities array<string>, relations array<struct<source: string, target: string, description: string>>"
EXTRACT_PROMPT = "List the entities of the text and the relations between them as one JSON object with the keys entities and relations.\n\nText:\n"
SUMMARY_PROMPT = "Summarise what the following messages say about these entities.\n"


@stage("extract_graph")
def extract(chunks: DataFrame, call: Completion, replay: DataFrame | None = None) -> DataFrame:
    """chunk_id, pos, entities and relations of each chunk (chunk_id, pos, concat_text); a failed or
    unreadable reply gives none."""
    asked = chunks.select("chunk_id", "pos", F.concat(F.lit(EXTRACT_PROMPT), F.coalesce("concat_text", F.lit(""))).alias("prompt"))
    parsed = F.from_json(text.json_slice("reply"), REPLY)
    names = F.array().cast("array<string>")
    pairs = F.array().cast("array<struct<source: string, target: string, description: string>>")
    return complete(asked, call, replay).select("chunk_id", "pos", F.coalesce(parsed["entities"], names).alias("entities"), F.coalesce(parsed["relations"], pairs).alias("relations"))


@stage("create_text_units")
def text_units(documents: DataFrame) -> DataFrame:
    """One unit per document (id, text): its hash, text, document ids and number of tokens."""
    return documents.select(F.sha2("text", 512).alias("id"), "text", F.array("id").alias("document_ids"), F.size(text.tokens("text")).alias("n_tokens"))


@stage("create_community_reports")
def summary_prompts(members: DataFrame, vertices: DataFrame, edges: DataFrame, chunk_texts: DataFrame, most: tuple[int, int, int] = (30, 5, 10)) -> DataFrame:
    """community, entities, source_chunk_ids and prompt of each community (members: community, node).

    The prompt names at most ``most`` entities, snippets and relations, the first in
    order of name, chunk and label; each is ranked before it is brought together.
    """
    from pyspark.sql import Window

    def first(df: DataFrame, column: str, n: int) -> DataFrame:
        ranked = df.select("community", column).distinct().withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy(column))).filter(F.col("k") <= n)
        return ranked.groupBy("community").agg(F.array_sort(F.collect_list(column)).alias(column))

    own = members.join(vertices.withColumnRenamed("node_id", "node"), "node")
    sources = own.select("community", F.explode("source_ids").alias("chunk_id")).distinct()
    name = vertices.select(F.col("node_id").alias("node"), "name")
    inner = graph.with_communities(edges, members).filter("cu = cv").join(name.toDF("src", "a"), "src").join(name.toDF("dst", "b"), "dst")
    labels = inner.select(F.col("cu").alias("community"), F.concat(F.least("a", "b"), F.lit(" -> "), F.greatest("a", "b"), F.lit(": "), "relation").alias("relation"))
    out = own.groupBy("community").agg(F.array_sort(F.collect_set("name")).alias("entities")).join(sources.groupBy("community").agg(F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids")), "community")
    out = out.join(first(sources.join(chunk_texts, "chunk_id"), "text", most[1]), "community", "left").join(first(labels, "relation", most[2]), "community", "left")
    part = lambda title, c: F.concat(F.lit(f"\n{title}:\n"), F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\n"))
    prompt = F.concat(F.lit(SUMMARY_PROMPT), part("Entities", F.slice("entities", 1, most[0])), part("Messages", F.col("text")), part("Relations", F.col("relation")))
    return out.select("community", "entities", "source_chunk_ids", prompt.alias("prompt"))


def summaries(prompts: DataFrame, call: Completion, replay: DataFrame | None = None) -> DataFrame:
    """community, summary, entity_count, entities, source_chunk_ids."""
    return complete(prompts, call, replay).select("community", F.col("reply").alias("summary"), F.size("entities").alias("entity_count"), "entities", "source_chunk_ids")


def query_keywords(queries: DataFrame, call: Completion | None = None) -> DataFrame:
    """(query_id, keyword): those a provider names, or without one the query's own tokens."""
    if call is None:
        return queries.select("query_id", F.explode(F.array_distinct(text.tokens("text"))).alias("keyword"))
    asked = queries.select("query_id", F.col("text").alias("prompt"))
    return complete(asked, call).select("query_id", F.explode(text.keywords("reply")).alias("keyword"))


def answers(queries: DataFrame, ranked: DataFrame, chunk_texts: DataFrame, call: Completion | None = None) -> DataFrame:
    """query_id, context, sources and reply; the context is ``empty`` if nothing was found.

    Without a provider the retrieved context itself is returned, with a null reply.
    """
    hits = ranked.join(chunk_texts, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("x"))
    out = queries.join(hits, "query_id", "left")
    context = F.coalesce(F.array_join(F.transform("x", lambda r: r["text"]), "\n\n"), F.lit("empty"))
    cites = F.transform("x", lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r["chunk_id"]))
    out = out.select("query_id", "text", context.alias("context"), F.coalesce(cites, F.array(F.lit("no source found"))).alias("sources"))
    if call is None:
        return out.select("query_id", "context", "sources", F.lit(None).cast("string").alias("reply"))
    prompt = F.concat(F.lit("Answer from the context.\n\nContext:\n"), "context", F.lit("\n\nQuestion: "), "text")
    return complete(out.select("query_id", "context", "sources", prompt.alias("prompt")), call).select("query_id", "context", "sources", "reply")


def local_search(entity_hits: DataFrame, entity_units: DataFrame, unit_chunks: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, rank: the units of the nearest entities (query_id, rank, entity), cut to k before
    they are looked up, so that units without a chunk shorten the list."""
    from pyspark.sql import Window

    units = entity_hits.join(entity_units, "entity").groupBy("query_id", "unit").agg(F.min("rank").alias("best"), F.count("*").alias("n"))
    ranked = units.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best", F.desc("n"), "unit"))).filter(F.col("rank") <= k)
    return ranked.join(unit_chunks, "unit").select("query_id", "chunk_id", "rank")


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """created, total_tokens and reply of each response file of a model cache; keys of prompts are the caller's."""
    schema = "result struct<response: struct<created: bigint, usage: struct<total_tokens: bigint>, choices: array<struct<message: struct<content: string>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("result.response.*")
    return rows.select("created", F.col("usage.total_tokens").alias("total_tokens"), F.try_element_at("choices", F.lit(1))["message"]["content"].alias("reply"))


def sweep_hierarchy(edge: DataFrame, nodes: DataFrame, resolutions: list[float], thresholds: list[float], max_iterations: int = 7) -> DataFrame:
    """resolution, threshold, n_communities, n_frozen and max_level for every pair of parameters."""
    out = None
    for r, t in product(resolutions, thresholds):
        c, _ = communities.detect_hierarchy(edge, nodes, t, max_iterations, r)
        row = c.agg(F.lit(r).alias("resolution"), F.lit(t).alias("threshold"), F.count("*").alias("n_communities"), F.count_if("frozen").alias("n_frozen"), F.max("level").alias("max_level"))
        out = row if out is None else out.unionByName(row)
    return out
