import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from threadloom.operators import evaluate, retrieval


def test_fusion_by_hand(spark):
    v = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, doc_id long, rank int")
    x = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "query_id long, doc_id long, rank int")
    got = [(r.doc_id, r.score) for r in retrieval.rrf(v, x, 10).orderBy("rank").collect()]
    assert got == [(2, round(1 / 62 + 1 / 61, 9)), (1, round(1 / 61, 9)), (3, round(1 / 62, 9))]


def test_metrics_by_hand(spark):
    r = spark.createDataFrame([([1, 2, 3], [2, 5]), ([], [1])], "retrieved array<long>, truth array<long>")
    rows = evaluate.precision_recall(r).collect()
    assert [(x.precision, x.recall) for x in rows] == [(1 / 3, 0.5), (0.0, 0.0)]
    assert evaluate.macro(evaluate.precision_recall(r.limit(1))).first().f1 == 0.4


def test_clustering_scores_of_equal_labels(spark):
    p = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "u long, v long")
    assert evaluate.nmi(p).first().nmi == 1.0 and evaluate.ari(p).first().ari == 1.0
    one = spark.createDataFrame([(1, 1)] * 3, "u long, v long")
    assert evaluate.nmi(one).first().nmi == 1.0


def test_vector_search_of_nothing(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, v array<float>")
    q = spark.createDataFrame([], "query_id long, q array<float>")
    assert retrieval.vector_topk(q, base, 3).isEmpty()


def plain_bm25(docs, queries):
    """(query, document): score, as the formula says it, over documents that hold their tokens as a list."""
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    term = lambda t, d: idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean))
    return {(q, i): sum(term(t, d) for t in asked if t in d) for q, asked in queries.items() for i, d in docs.items() if set(asked) & set(d)}


def test_bm25_keeps_the_best_of_each_task(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    r = random.Random(1)
    docs = {i: r.choices("abcdefghij", k=r.randrange(12)) for i in range(60)} | {i: ["a", "b", "x"] for i in range(60, 90)}
    asked = {q: r.choices("abcdefghijz", k=r.randrange(1, 5)) for q in range(7)} | {7: ["z"], 8: ["x"], 9: []}
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()] + [(None, "a")], "doc_id long, text string")
    queries = spark.createDataFrame([(q, " ".join(t)) for q, t in asked.items()], "query_id long, text string")
    # A document without an id counts in the statistics, but is no hit.
    want = {k: v for k, v in plain_bm25(docs | {None: ["a"]}, asked).items() if k[1] is not None}
    hits = retrieval.bm25(frame.repartition(7), queries)
    # Nothing of a document is shuffled: its scores come from the row itself.
    assert "Exchange hash" not in hits._jdf.queryExecution().executedPlan().toString()
    got = {(x.query_id, x.doc_id): x.score for x in hits.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    rows = retrieval.bm25_topk(frame.repartition(7), queries, 4).collect()
    best = {q: sorted(((-got.get((q, i), 0.0), i) for i in docs), key=lambda x: x)[:4] for q in asked}
    assert {q: [(x.doc_id, x.score) for x in sorted(rows, key=lambda x: x.rank) if x.query_id == q] for q in asked} == {q: [(i, -s + 0.0) for s, i in b] for q, b in best.items()}
    # A search sends few rows on to be ranked, however many documents share a token.
    sent = retrieval._bm25(frame.repartition(7), queries, lambda block: retrieval._best_scores(block, 4)).groupBy("query_id").count().collect()
    assert all(x["count"] <= 7 * 4 for x in sent)


def test_rows_of_one_document_score_together(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "a c d"), (3, "e")], "doc_id long, text string")
    q = spark.createDataFrame([("q", "a c")], "query_id string, text string")
    got = {x.doc_id: x.score for x in retrieval.bm25(frame, q).collect()}
    assert got.keys() == {1, 2} and got[1] == got[2]


def test_scores_are_rounded_as_by_spark(spark):
    r = random.Random(2)
    values = [0.0, -0.0, 0.5e-6, -0.5e-6, 1.0000005, 2.0000015, 33.3333335, -7.1234565, 1e-9, -1e-9] + [r.randrange(10**9) / 2 / 10**6 for _ in range(20_000)] + [r.uniform(-40, 40) for _ in range(20_000)]
    want = [x.v for x in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6).alias("v")).collect()]
    assert retrieval._rounded(np.array(values)).tolist() == want
