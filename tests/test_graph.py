import math
import operator
import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import functions as F

from threadloom import session
from threadloom.operators import communities, graph
from threadloom.operators.components import components

EXTRACTION = "chunk_id string, pos long, entities array<string>, relations array<struct<source: string, target: string, description: string>>"


def test_two_chunks_by_hand(spark):
    rows = [
        ("c1", 0, ["Foo", "foo", "Bar"], [("Foo", "Bar", "d1"), ("bar", "Foo", "d2")]),
        ("c2", 1, ["foo", "bar"], [("foo", "bar", "d1"), ("foo", "bar", "d3")]),
        ("c3", 2, [" ", None], [("x", "y", "d")]),
        ("c4", 3, None, None),
    ]
    x = spark.createDataFrame(rows, EXTRACTION)
    v = {r.node_id: (r.name, r.occurrence_count, r.source_ids) for r in graph.vertices(x).collect()}
    assert v == {"entity::foo": ("Foo", 3, ["c1", "c2"]), "entity::bar": ("Bar", 2, ["c1", "c2"])}
    (e,) = graph.edges(x).collect()
    assert (e.edge_type, e.weight, e.relation) == ("explicit", 9, "d1；d3")


def test_conductance_by_hand(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1), (3, 4, 1)], "src long, dst long, weight long")
    m = spark.createDataFrame([(i, 0 if i < 4 else 1) for i in range(1, 7)] + [(7, 2)], "node long, community long")
    got = {r.community: r.conductance for r in graph.conductance(e, m).collect()}
    assert abs(got[0] - 1 / 7) < 1e-12 and abs(got[1] - 1 / 7) < 1e-12 and got[2] == 1.0
    whole = m.filter("node < 7").withColumn("community", F.lit(5).cast("long"))
    assert graph.conductance(e, whole).first().conductance == 0.0
    assert graph.conductance(e.filter("false"), m).filter("conductance <> 0").isEmpty()
    (c,) = graph.contract(e, m).collect()
    assert tuple(c) == (0, 1, 1)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 200)], "a long, b long")
    got = {r.id: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(links.filter("false")).isEmpty()


def two_cliques(spark):
    own = [(a, b, 1) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)]
    return spark.createDataFrame([*own, (4, 10, 1)], "src long, dst long, weight long"), spark.createDataFrame([(i,) for base in (0, 10) for i in range(base, base + 5)] + [(50,)], "node long")


def test_partition_finds_two_cliques(spark):
    e, nodes = two_cliques(spark)
    got = {r.node: r.community for r in communities.partition(e, nodes).collect()}
    assert got == {**{i: 0 for i in range(5)}, **{i: 10 for i in range(10, 15)}, 50: 50}


def test_hierarchy_rules(spark):
    e, nodes = two_cliques(spark)
    split = lambda edge, n: n.select("node", F.floor(F.col("node") / 10).alias("community"))
    c, m = communities.detect_hierarchy(e, nodes, 0.3, split=split)
    # Three communities with one edge between them: all freeze on level 0.
    assert [(r.level, r.frozen) for r in c.collect()] == [(0, True)] * 3
    c, _ = communities.detect_hierarchy(e, nodes, 0.3, max_iterations=0, split=split)
    assert not any(r.frozen for r in c.collect())
    assert m.count() == 11


def test_ancestors(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (4, None)], "community long, parent long")
    assert sorted(map(tuple, graph.ancestors(p).collect())) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "community long, parent long")
    assert graph.ancestors(chain).filter("community = 0").count() == 40
    assert graph.ancestors(p.filter("false")).isEmpty()
    with pytest.raises(ValueError):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "community long, parent long"))


def test_fractional_weights(spark):
    e = spark.createDataFrame([(1, 2, 0.6), (2, 3, 0.6)], "src long, dst long, weight double")
    assert {r.node: r.degree for r in graph.weighted_degree(e).collect()} == {1: 0.6, 2: 1.2, 3: 0.6}
    m = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "node long, community long")
    assert graph.contract(e, m).first().weight == 0.6
    got = {r.community: (r.volume, r.internal, round(r.conductance, 6)) for r in graph.conductance(e, m).collect()}
    assert got[0][1] == 0.6 and got[0][2] == 1.0


def test_numbers_are_dense(spark):
    names = spark.range(0, 1000).selectExpr("id * 7 % 1009 as community").repartition(5)
    got = sorted((r.community, r.new) for r in communities.numbered(names, 3).collect())
    assert [n for _, n in got] == list(range(3, 1003))
    assert communities.numbered(names.filter("false")).isEmpty()


def test_partition_finds_a_ring_of_cliques(spark):
    own = [(a, b, 1) for base in range(0, 120, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)]
    ring = [(base + 5, (base + 10) % 120, 1) for base in range(0, 120, 10)]
    e = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in own + ring], "src long, dst long, weight long")
    nodes = e.selectExpr("explode(array(src, dst)) as node").distinct()
    got = {r.node: r.community for r in communities.partition(e, nodes).collect()}
    groups = {frozenset(n for n in got if got[n] == c) for c in got.values()}
    assert all(len({got[n] for n in range(base, base + 6)}) == 1 for base in range(0, 120, 10)) and len(groups) >= 6
    assert all(c == min(n for n in got if got[n] == c) for c in got.values())


def test_mean_conductance_of_levels_in_any_order(spark):
    # The mean is 0.97035; in doubles, some orders of the sum end just below it.
    values = [0.9674, 0.9699, 0.9787, 0.9391, 0.9532, 0.9635, 1.0, 0.991]
    orders = [random.Random(level).sample(values, len(values)) for level in range(50)]
    assert min(reduce(operator.add, own) / len(own) for own in orders) < 0.97035
    rows = [(level, False, 2, x) for level, own in enumerate(orders) for x in own] + [(98, True, 1, None), (99, True, 1, 0.5), (99, True, 1, float("nan"))]
    c = spark.createDataFrame(rows, "level int, frozen boolean, size long, conductance double").coalesce(1)
    got = {r.level: r for r in graph.community_levels(c).collect()}
    assert {got[level].mean_conductance for level in range(50)} == {0.9704}
    assert got[0][1:4] == (8, 0, 0) and got[98].mean_conductance is None and math.isnan(got[99].mean_conductance)


def test_cooccurrence_is_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS", 100)
    r = random.Random(3)
    # One pair is in every group, a group is large, an entity repeats, and rows without a group or an entity tell nothing.
    groups = {g: {"x", "y", *(f"e{r.randrange(40)}" for _ in range(5))} for g in range(200)} | {200: {f"e{i}" for i in range(60)}}
    rows = [(g, e) for g, own in groups.items() for e in [*sorted(own), min(own)]] + [(None, "x"), (None, "y"), (5, None)]
    got = graph.cooccurrence(spark.createDataFrame(rows, "g long, e string"), "g", "e")
    want = Counter((a, b) for own in groups.values() for a in own for b in own if a < b)
    assert {(x.src, x.dst): x.weight for x in got.collect()} == want and got.schema["weight"].dataType.simpleString() == "bigint"
    assert got.rdd.getNumPartitions() >= 2 * len(rows) / 100


def plain_edges(rows):
    """(src, dst): weight, first type, relation and number of chunks, event by event."""
    events = {}
    for chunk, pos, entities, relations in rows:
        names = list(dict.fromkeys(x.strip() for x in entities or [] if x and x.strip()))
        at = lambda phase, seq, pos=pos: (-(10**30) if pos is None else pos, phase, seq)
        own = [(at(0, i), a.strip(), b.strip(), 2, d or "", "explicit") for i, (a, b, d) in enumerate(relations or []) if a and b and a.strip() in names and b.strip() in names]
        own += [(at(1, i * 1_000_000 + k), a, b, 1, "", "co-occurrence") for i, a in enumerate(names) for k, b in enumerate(names[i + 1 :])]
        for place, a, b, w, d, kind in own:
            a, b = sorted(("entity::" + a.lower(), "entity::" + b.lower()))
            if a != b:
                events.setdefault((a, b), []).append((place, w, d, kind, chunk))
    out = {}
    for pair, own in events.items():
        own.sort(key=lambda e: e[0])
        told = own[0][2] if own[0][3] == "explicit" else "co-occurrence"
        for d in (e[2] for e in own if e[3] == "explicit"):
            told = told if d in told else d if told == "" else f"{told}；{d}"
        out[pair] = (sum(e[1] for e in own), own[0][3], told, len({e[4] for e in own}))
    return out


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(4)
    name = lambda: r.choice(["A", "a", " b", "B ", "c", "d", "e", "", None])
    rows = [(f"c{i}", None if i == 7 else r.randrange(-5, 5) * 100 + i, [name() for _ in range(r.randrange(7))], [(name(), name(), r.choice(["x", "xy", "z", "", None])) for _ in range(r.randrange(4))]) for i in range(80)]
    rows += [("none", 2**62, None, [("a", "b", "x")]), ("low", -(2**62), ["a", "b"], None)]
    return rows, spark.createDataFrame(rows, EXTRACTION)


def test_relations_of_edges_dealt_out(spark, chunks):
    rows, x = chunks
    for got in (graph.edges(session.dealt(x, "chunk_id", 3), tasks=5), graph.edges(x)):
        assert {(e.src, e.dst): (e.weight, e.edge_type, e.relation, len(e.source_ids)) for e in got.collect()} == plain_edges(rows)
    plan = graph.edges(session.dealt(x, "chunk_id", 3), sources=False, tasks=5)._jdf.queryExecution().executedPlan().toString()
    # Chunks are dealt out once and so are edges; no step sorts all events of a task.
    assert plan.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in plan


def test_weights_of_edges_dealt_out(spark, chunks):
    rows, x = chunks
    for got in (graph.edge_weights(session.dealt(x, "chunk_id", 3), 5), graph.edge_weights(x)):
        assert {(e.src, e.dst): (e.weight, e.n_sources) for e in got.collect()} == {k: (v[0], v[3]) for k, v in plain_edges(rows).items()}
    plan = graph.edge_weights(session.dealt(x, "chunk_id", 3), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in plan


def test_types_of_edges_dealt_out(spark, chunks):
    rows, x = chunks
    for got in (graph.edge_types(session.dealt(x, "chunk_id", 3), 5), graph.edge_types(x)):
        assert {(e.src, e.dst): e.edge_type for e in got.collect()} == {k: v[1] for k, v in plain_edges(rows).items()}
    plan = graph.edge_types(session.dealt(x, "chunk_id", 3), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "SortAggregate" not in plan


def test_hierarchy_reads_its_edges_once(spark):
    e, nodes = two_cliques(spark)
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    split = lambda edge, n: n.select("node", F.floor(F.col("node") / 10).alias("community"))
    c, _ = communities.detect_hierarchy(e.mapInArrow(told, e.schema), nodes, 0.3, split=split)
    assert c.count() == 3 and read.value == e.count()
