import json

import pytest

from threadloom.functions import splitters
from threadloom.operators import graph
from threadloom.plans import rag


def test_from_chunks_to_answers(spark):
    chunks = spark.createDataFrame([("c1", 0, "Ann met Bob"), ("c2", 1, "Bob left"), ("c3", 2, "bad")], "chunk_id string, pos long, concat_text string")

    def call(prompt: str) -> str:
        body = prompt.rsplit("\n", 1)[1]
        if body == "bad":
            raise OSError
        names = [w for w in body.split() if w[0].isupper()]
        return "Sure: " + json.dumps({"entities": names, "relations": [{"source": a, "target": b, "description": "met"} for a, b in zip(names, names[1:])]})

    x = rag.extract(chunks, call).cache()
    v, e = graph.vertices(x), graph.edges(x)
    assert {r.name: r.occurrence_count for r in v.collect()} == {"Ann": 1, "Bob": 2} and e.first().weight == 3
    members = v.selectExpr("node_id as node", "1 as community")
    texts = chunks.selectExpr("chunk_id", "concat_text as text")
    (p,) = rag.summary_prompts(members, v, e, texts).collect()
    assert p.entities == ["Ann", "Bob"] and p.source_chunk_ids == ["c1", "c2"] and "Ann -> Bob: met" in p.prompt
    (s,) = rag.summaries(rag.summary_prompts(members, v, e, texts), lambda _: "short").collect()
    assert (s.summary, s.entity_count) == ("short", 2)
    queries = spark.createDataFrame([(1, "who"), (2, "what")], "query_id long, text string")
    ranked = spark.createDataFrame([(1, "c2", 1), (1, "c1", 2)], "query_id long, chunk_id string, rank int")
    got = {r.query_id: r for r in rag.answers(queries, ranked, texts).collect()}
    assert got[1].context == "Bob left\n\nAnn met Bob" and got[1].sources == ["[1] c2", "[2] c1"] and got[2].context == "empty"
    assert {r.keyword for r in rag.query_keywords(queries).collect()} == {"who", "what"}


def test_local_search_cuts_before_lookup(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id long, rank int, entity string")
    units = spark.createDataFrame([("a", "u1"), ("b", "u1"), ("b", "u2"), ("b", "u3")], "entity string, unit string")
    found = spark.createDataFrame([("u1", "c1"), ("u3", "c3")], "unit string, chunk_id string")
    assert [(r.chunk_id, r.rank) for r in rag.local_search(hits, units, found, 2).collect()] == [("c1", 1)]


def test_settings_and_paths(tmp_path, monkeypatch):
    s = rag.Settings().merged({"top_k": 9, "other": 1})
    assert s.top_k == 9 and s.extra == {"other": "1"}
    monkeypatch.setenv("MODEL_API_KEY", "k")
    assert s.api_key == "k"
    assert rag.safe_path(str(tmp_path), "a/b").endswith("a/b")
    with pytest.raises(ValueError):
        rag.safe_path(str(tmp_path), f"../{tmp_path.name}2/x")
    assert splitters.splitter("") == splitters.splitter("no such") == "recursive"


def test_cached_replies(spark, tmp_path):
    (tmp_path / "chat_1").write_text(json.dumps({"result": {"response": {"created": 5, "usage": {"total_tokens": 7}, "choices": [{"message": {"content": "hi"}}]}}}))
    assert tuple(rag.read_replies(spark, str(tmp_path)).first()) == (5, 7, "hi")
