"""The entity graph as DataFrames: building, measuring and contracting it.

Graphs are undirected and weighted; an edge is one row with ``src < dst``.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import COOCCURRENCE, SEPARATOR, node_id, normalize_entity, strip
from threadloom.session import dealt, settle, tasks_for


def mentions(extractions: DataFrame) -> DataFrame:
    """(chunk_id, pos, epos, raw, node_id, norm) of the non-blank entities of each chunk."""
    e = extractions.select("chunk_id", "pos", F.posexplode("entities").alias("epos", "name")).withColumn("raw", strip("name"))
    return e.filter("raw <> ''").select("chunk_id", "pos", "epos", "raw", node_id("raw").alias("node_id"), normalize_entity("raw").alias("norm"))


def vertices(extractions: DataFrame, sources: bool = True) -> DataFrame:
    """node_id, name (first spelling), normalized_name, occurrence_count and, with ``sources``, source_ids (sorted).

    source_ids puts all chunks of a node into one row; ``node_chunks`` has them as rows.
    """
    m = mentions(extractions)
    out = m.groupBy("node_id", F.col("norm").alias("normalized_name")).agg(F.min_by("raw", F.struct("pos", "epos")).alias("name"), F.count("*").alias("occurrence_count"))
    if not sources:
        return out
    return out.join(_gathered(node_chunks(extractions), "node_id"), "node_id", "left").select("node_id", "normalized_name", "name", "source_ids", "occurrence_count")


def node_chunks(extractions: DataFrame) -> DataFrame:
    """(node_id, chunk_id), each once: which chunks name a node."""
    return mentions(extractions).select("node_id", "chunk_id").distinct()


def edge_chunks(events: DataFrame) -> DataFrame:
    """(src, dst, chunk_id), each once: which chunks an edge comes from."""
    return events.select("src", "dst", "chunk_id").distinct()


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("chunk_id")).alias("source_ids"))


def edge_events(extractions: DataFrame) -> DataFrame:
    """(src, dst, chunk_id, pos, phase, seq, w, type, description) of every mention of a pair, and ``part`` if it is there.

    Explicit relations (weight 2) need both ends among the chunk's own spellings. Each
    unordered pair of distinct spellings of a chunk adds 1; pairs are made inside the
    row, without a join, and each name is normalised once.
    """
    own = [c for c in ("part",) if c in extractions.columns]
    named = lambda raw: F.struct(raw.alias("raw"), node_id(raw).alias("id"))
    names = F.array_distinct(F.filter(F.transform("entities", strip), lambda x: x != ""))
    chunks = extractions.select(*own, "chunk_id", "pos", "relations", names.alias("raws")).filter(F.size("raws") > 0).withColumn("names", F.transform("raws", named))
    said = lambda r, i: F.struct(F.lit(0).alias("phase"), i.cast("long").alias("seq"), named(strip(r["source"])).alias("a"), named(strip(r["target"])).alias("b"), F.coalesce(r["description"], F.lit("")).alias("description"))
    met = lambda x, i: F.struct(F.lit(1).alias("phase"), i.cast("long").alias("seq"), x.alias("a"), F.lit(None).alias("b"), F.lit("").alias("description"))
    known = lambda r: (r["a"]["raw"] != "") & (r["b"]["raw"] != "") & F.array_contains("raws", r["a"]["raw"]) & F.array_contains("raws", r["b"]["raw"])
    relations = F.coalesce(F.filter(F.transform("relations", said), known), F.array())
    e = chunks.select(*own, "chunk_id", "pos", "names", F.explode(F.concat(relations, F.transform("names", met))).alias("e"))
    explicit, i = F.col("e.phase") == 0, F.col("e.seq").cast("int")
    others = F.when(explicit, F.array("e.b")).otherwise(F.slice("names", i + 2, F.size("names")))
    e = e.select(*own, "chunk_id", "pos", "e", F.posexplode(others).alias("k", "b"))
    e = e.select(*own, "chunk_id", "pos", F.col("e.phase").alias("phase"), F.when(explicit, F.col("e.seq")).otherwise(F.col("e.seq") * 1_000_000 + F.col("k")).alias("seq"), F.col("e.a.id").alias("a"), F.col("b.id").alias("b"), F.col("e.description").alias("description"))
    explicit = F.col("phase") == 0
    return e.filter("a <> b").select(*own, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "chunk_id", "pos", "phase", "seq", F.when(explicit, 2).otherwise(1).alias("w"), F.when(explicit, "explicit").otherwise(COOCCURRENCE).alias("type"), "description")


#: More than any seq, and the place of an event without pos: before all others.
SEQS, NOWHERE = 10**16, Decimal(-(10**19))


def _at() -> Column:
    """An event's place (pos, phase, seq) as one number, of which aggregates keep the least without a sort."""
    pos = F.coalesce(F.col("pos").cast("decimal(20,0)"), F.lit(NOWHERE))
    return ((pos * 2 + F.col("phase")) * F.lit(SEQS).cast("decimal(17,0)") + F.col("seq")).cast("decimal(38,0)")


def _is_explicit(at: Column) -> Column:
    """Whether an event's place is that of an explicit relation."""
    return F.floor(at / F.lit(SEQS).cast("decimal(17,0)")).cast("decimal(21,0)") % 2 == 0


def _together(rows: DataFrame, keys: list[str], tasks: int | None, *sums: Column) -> DataFrame:
    """``rows`` summed by ``keys``, which src and dst lead: those of a part in the task that holds it, then those of an
    edge in one of ``tasks``."""
    if "part" in rows.columns:
        rows = rows.groupBy("part", *keys).agg(*sums).drop("part")
    if tasks:
        rows = rows.repartition(tasks, "src", "dst")
    return rows.groupBy(*keys).agg(*sums)


def edge_types(extractions: DataFrame, tasks: int | None = None) -> DataFrame:
    """src, dst and edge_type (of the first event); ``tasks`` as in ``edges``."""
    own = _together(edge_events(extractions).withColumn("at", _at()), ["src", "dst"], tasks, F.min("at").alias("at"))
    return own.select("src", "dst", F.when(_is_explicit(F.col("at")), "explicit").otherwise(COOCCURRENCE).alias("edge_type"))


def edge_weights(extractions: DataFrame, tasks: int | None = None) -> DataFrame:
    """src, dst, weight and n_sources (how many chunks an edge comes from); ``tasks`` as in ``edges``.

    A chunk_id is in one part only, so that an edge's chunks are counted in each part.
    """
    e, part = edge_events(extractions), ["part"] if "part" in extractions.columns else []
    chunks = e.groupBy(*part, "src", "dst", "chunk_id").agg(F.sum("w").alias("weight"))
    own = chunks.select(*part, "src", "dst", "weight", F.lit(1).cast("long").alias("n_sources"))
    return _together(own, ["src", "dst"], tasks, F.sum("weight").alias("weight"), F.sum("n_sources").alias("n_sources"))


def edges(extractions: DataFrame, sources: bool = True, tasks: int | None = None) -> DataFrame:
    """src, dst, weight, edge_type (of the first event), relation and, with ``sources``, source_ids.

    relation starts with the first event's description (or the co-occurrence label),
    and later explicit descriptions are added unless already contained. Events are
    first combined per edge and description, so that an edge brings
    together its distinct descriptions only. source_ids puts all chunks of an edge into
    one row; ``edge_chunks`` has them as rows. If the rows are dealt out by ``part``, events are
    combined there, and edges are dealt out to ``tasks``.
    """
    e = edge_events(extractions)
    part = e.withColumn("at", _at()).withColumn("said", F.when(F.col("phase") == 0, F.col("description")))
    part = _together(part, ["src", "dst", "said"], tasks, F.sum("w").alias("w"), F.min("at").alias("at"))
    main = part.groupBy("src", "dst").agg(
        F.sum("w").alias("weight"),
        F.min("at").alias("at"),
        F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("at", F.col("said").alias("description"))))).alias("all"),
    )
    explicit = _is_explicit(F.col("at"))
    start = F.when(explicit, F.try_element_at("all", F.lit(1))["description"]).otherwise(F.lit(COOCCURRENCE))
    fold = F.aggregate("all", start, lambda a, x: F.when(F.contains(a, x["description"]), a).when(a == "", x["description"]).otherwise(F.concat(a, F.lit(SEPARATOR), x["description"])))
    main = main.select("src", "dst", "weight", F.when(explicit, "explicit").otherwise(COOCCURRENCE).alias("edge_type"), fold.alias("relation"))
    if not sources:
        return main
    return main.join(_gathered(edge_chunks(e), "src", "dst"), ["src", "dst"], "left").select("src", "dst", "weight", "edge_type", "source_ids", "relation")


def cooccurrence(rows: DataFrame, group: str, entity: str) -> DataFrame:
    """src, dst, weight: in how many groups two entities stand together.

    Rows without a group stand with none. Groups are dealt out to as many tasks as there are rows for; each counts
    its own pairs before they are dealt out in turn.
    """
    tasks = tasks_for(rows.sparkSession, rows.count())
    own = dealt(rows.select(F.col(group).alias("group"), F.col(entity).alias("entity")).filter("group is not null"), "group", tasks)
    sets = own.groupBy("part", "group").agg(F.array_sort(F.collect_set("entity")).alias("all")).filter(F.size("all") > 1)
    first = sets.select("part", F.posexplode("all").alias("i", "src"), "all")
    pairs = first.select("part", "src", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("dst"))
    counted = pairs.groupBy("part", "src", "dst").agg(F.count("*").alias("n")).select("src", "dst", "n")
    return counted.repartition(2 * tasks, "src", "dst").groupBy("src", "dst").agg(F.sum("n").alias("weight"))


def weighted_degree(edge: DataFrame) -> DataFrame:
    ends = edge.select(F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.sum("weight").alias("degree"))


def isolates(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    """The nodes (column node) that no edge touches."""
    return nodes.join(edge.select(F.explode(F.array("src", "dst")).alias("node")), "node", "left_anti")


def induced(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among ``nodes``."""
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return edge.join(a, "src", "left_semi").join(b, "dst", "left_semi").select(edge.columns)


def with_communities(edge: DataFrame, members: DataFrame) -> DataFrame:
    """Adds cu and cv, the communities of both ends; edges with an end in none go."""
    u = members.select(F.col("node").alias("src"), F.col("community").alias("cu"))
    v = members.select(F.col("node").alias("dst"), F.col("community").alias("cv"))
    return edge.join(u, "src").join(v, "dst")


def contract(edge: DataFrame, members: DataFrame) -> DataFrame:
    """src, dst, weight between communities: the summed weight that crosses."""
    e = with_communities(edge, members).filter("cu <> cv")
    return e.groupBy(F.least("cu", "cv").alias("src"), F.greatest("cu", "cv").alias("dst")).agg(F.sum("weight").alias("weight"))


def conductance(edge: DataFrame, members: DataFrame) -> DataFrame:
    """community, volume, internal, cut, size and conductance of each community of ``members``.

    A community of the whole volume has 0, one without volume 1, in this order. Volumes
    and cuts are of the type that sums of the weights have.
    """
    volume = members.join(weighted_degree(edge), "node", "left").groupBy("community").agg(F.sum(F.coalesce("degree", F.lit(0))).alias("volume"), F.count("*").alias("size"))
    inside = with_communities(edge, members).filter("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.sum("weight").alias("internal"))
    total = edge.agg(F.coalesce(2 * F.sum("weight"), F.lit(0)).alias("total"))
    out = volume.join(inside, "community", "left").withColumn("internal", F.coalesce("internal", F.lit(0))).crossJoin(F.broadcast(total))
    out = out.withColumn("cut", F.greatest(F.lit(0), F.col("volume") - 2 * F.col("internal")))
    phi = F.when(F.col("volume") == F.col("total"), 0.0).when(F.col("volume") == 0, 1.0).otherwise(F.try_divide(F.col("cut").cast("double"), F.least("volume", F.col("total") - F.col("volume")).cast("double")))
    return out.select("community", "size", "volume", "internal", "cut", phi.alias("conductance"))


def ancestors(parents: DataFrame) -> DataFrame:
    """(community, ancestor, distance) over (community, parent) rows of a forest, nearest first, however deep it is.

    A circle of parents has no top and is an error.
    """
    up = settle(parents.filter("parent is not null").select("community", F.col("parent").alias("ancestor")), "parents")
    n = up.select("community").distinct().count()
    step, out = up.withColumn("distance", F.lit(1)), [up.withColumn("distance", F.lit(1))]
    for depth in range(2, n + 2):
        nxt = step.alias("s").join(up.alias("u"), F.col("s.ancestor") == F.col("u.community")).select("s.community", "u.ancestor", F.lit(depth).alias("distance"))
        step = settle(nxt, "ancestors")
        if step.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(step)
    if n:
        raise ValueError("parents form a circle")
    return out[0]


def community_levels(communities: DataFrame) -> DataFrame:
    """level, its number of communities, frozen ones, single nodes and mean conductance.

    The mean is summed in decimals, so that the order of the rows does not decide its
    last digit; only a level with a conductance that those cannot hold has it in floats.
    """
    phi = F.col("conductance")
    held = phi.try_cast("decimal(28,18)")
    mean = F.when(F.count(held) == F.count(phi), F.round(F.avg(held), 4).cast("double")).otherwise(F.round(F.avg(phi), 4))
    return communities.groupBy("level").agg(F.count("*").alias("n"), F.count_if("frozen").alias("n_frozen"), F.count_if(F.col("size") == 1).alias("n_single"), mean.alias("mean_conductance"))


def verify_conductance(edge: DataFrame, communities: DataFrame, members: DataFrame, most: int = 5) -> DataFrame:
    """community, stored, counted and agrees of the first ``most`` communities by id: a spot check."""
    some = communities.select("community", F.col("conductance").alias("stored")).orderBy("community").limit(most)
    own = members.join(some.select("community"), "community", "left_semi")
    again = conductance(edge, own).select("community", F.round("conductance", 4).alias("counted"))
    return some.join(again, "community").withColumn("agrees", F.abs(F.col("stored") - F.col("counted")) < 1e-4)


def graph_health(nodes: DataFrame, edge: DataFrame, component: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolates and whether they are too many, components, the largest, weights.

    ``component`` has (id, root) of the nodes that edges touch.
    """
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = edge.agg(F.count("*").alias("n_edges"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.avg("weight").alias("avg_weight"))
    alone = isolates(nodes, edge).agg(F.count("*").alias("n_isolates"))
    sizes = component.groupBy("root").agg(F.count("*").alias("size")).agg(F.count("*").alias("linked"), F.max("size").alias("largest"))
    one = n.crossJoin(e).crossJoin(alone).crossJoin(sizes)
    return one.select("n_nodes", "n_edges", "n_isolates", (F.col("n_isolates") > 0.3 * F.col("n_nodes")).alias("many_isolates"), (F.col("linked") + F.col("n_isolates")).alias("n_components"), F.coalesce("largest", F.lit(0).cast("long")).alias("largest"), "min_weight", "max_weight", F.round("avg_weight", 6).alias("avg_weight"))
