import io
import json
import zipfile

from pyspark.sql import functions as F

from threadloom.functions import splitters, text
from threadloom.functions.providers import complete, embed
from threadloom.sources import loaders, sinks


def test_chunk_files(spark, tmp_path):
    data = {"window_id": "1", "chunks": [{"chunk_id": 0, "concat_text": "a", "msg_ids": ["m1"], "messages": [{"from": "x", "text": "hi"}, {"text": "yo"}, {"from": "z", "text": ""}]}, {"chunk_id": "k", "concat_text": "b", "msg_ids": ["m1", "m2"]}]}
    (tmp_path / "c.json").write_text(json.dumps(data))
    c = loaders.read_chunks(spark, str(tmp_path / "c.json"))
    assert [r.chunk_id for r in c.orderBy("pos").collect()] == ["0", "k"]
    assert loaders.read_chunks(spark, str(tmp_path / "c.json"), 1).count() == 1
    assert loaders.chunk_texts(c).filter("chunk_id = '0'").first().text == "x: hi\nunknown: yo"
    assert {r.msg_id: r.chunk_id for r in loaders.predicted_labels(c).collect()} == {"m1": "k", "m2": "k"}


def test_files_by_extension(spark, tmp_path):
    (tmp_path / "a.HTML").write_text("<p>one<script>x()</script></p><p>two &amp; three</p>")
    (tmp_path / "b.md").write_text("# head")
    (tmp_path / "c.unknown").write_text("no")
    (tmp_path / "d.ipynb").write_text(json.dumps({"cells": [{"source": ["x = 1\n", "y"]}]}))
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:r><w:t>first</w:t></w:r></w:p><w:p><w:t>second</w:t></w:p></w:d>')
    (tmp_path / "f.docx").write_bytes(buffer.getvalue())
    (tmp_path / "g.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r.page_content for r in loaders.load_files(spark, str(tmp_path)).collect()}
    assert got == {"a.HTML": "one\ntwo & three", "b.md": "# head", "d.ipynb": "x = 1\ny", "e.pdf": None, "f.docx": "first\nsecond", "g.docx": None}


def test_result_files(spark, tmp_path):
    (tmp_path / "x_R2.5_C0.1.json").write_text('{"nmi": 0.5, "ari": 0.25}')
    (tmp_path / "x_Rno_C1.json").write_text('{"nmi": 0.5, "ari": 0.25}')
    assert [tuple(r) for r in loaders.read_clustering_results(spark, str(tmp_path)).collect()] == [(2.5, 0.1, 0.5, 0.25)]


def test_graph_round_trip(spark, tmp_path):
    v, e = spark.range(3).toDF("node"), spark.createDataFrame([(0, 1, 2)], "src long, dst long, weight long")
    sinks.write_graph(v, e, str(tmp_path / "g"))
    a, b = sinks.read_graph(spark, str(tmp_path / "g"))
    assert a.count() == 3 and tuple(b.first()) == (0, 1, 2)
    sinks.upsert_kb(v, str(tmp_path / "kb"), "x")
    sinks.upsert_kb(v, str(tmp_path / "kb"), "x")
    assert sorted((r.kb or "", r.n) for r in sinks.kb_stats(spark, str(tmp_path / "kb")).collect()) == [("", 6), ("x", 6)]


def test_text_expressions(spark):
    row = spark.createDataFrame([(" 　Ab c\n", "say ```json\n{\"a\": 1}\n``` ok", "3 Results", "x\ty  z", None)], "a string, b string, c string, d string, e string").select(
        text.normalize_entity("a").alias("n"), text.fenced_json("b", "a int")["a"].alias("j"), text.is_title("c").alias("t"), text.tokens("d").alias("w"), text.tokens("e").alias("none"), text.normalize_entity("e").alias("empty"), text.json_slice("b").alias("s")
    ).first()
    assert (row.n, row.j, row.t, row.w, row.none, row.empty, row.s) == ("ab c", 1, True, ["x", "y", "z"], [], "", '{"a": 1}')


def test_pieces():
    assert splitters.recursive("a. b. c. " * 50, 40) and max(map(len, splitters.recursive("word word. " * 50, 40))) <= 40
    assert splitters.recursive("", 10) == [] and splitters.recursive("one", 10) == ["one"] and splitters.recursive("x" * 50, 10) == ["x" * 50]
    assert splitters.recursive("aa. bb. cc. dd. ", 8, 4) == ["aa. bb.", "bb. cc.", "cc. dd."]
    assert splitters.recursive("one\n\n" + "two。three four, five six\n" * 2, 12) == ["one", "two。", "three four,", "five six", "two。", "three four,", "five six"]
    assert splitters.recursive("a\n\n\nb", 20) == ["a\nb"]


def test_sentences(spark):
    texts = ["One. Two! “Three？” he said；四。五", "", None, "a, b, c  " + "long " * 3, "x\ny\n\n\n\nz  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select("doc_id", splitters.sentences("text", 12).alias("s"), splitters.sentences("text", 250, pdf=True).alias("p"), splitters.quoted_sentences("text").alias("q")).orderBy("doc_id").collect()
    assert got[0].s == ["One.", " Two!", " “Three？”", " he said；", "四。", "五"] and got[1].s == [] == got[2].s
    assert got[3].s == ["a,", " b,", " c  ", "long ", "long ", "long"] or "".join(got[3].s) == texts[3].rstrip()
    assert got[4].s == ["x", "y", "z"] and got[4].p == ["x y z"]
    assert got[0].q == ["One. Two! “Three？”", " he said；四。", "五"]


def test_documents_to_texts(spark):
    rows = [(1, "a,b. c", "x.CSV"), (2, "1 Heads\n\nbody one. body two", "y.md"), (3, None, "z.md"), (4, "", "w.csv")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = sorted((r.doc_id, r.pos, r.content) for r in splitters.documents_to_texts(df, "recursive", 12, 0, titles=True).collect())
    assert got == [(1, 0, "a,b. c"), (2, 0, "1 Heads"), (2, 1, "1 Heads body one."), (2, 2, "1 Heads body two")]
    own = splitters.split_rows(df, lambda t, size, overlap: t.split(" "), 5, 0)
    assert {(r.doc_id, r.piece) for r in own.collect()} >= {(1, "a,b."), (1, "c")}


def test_providers(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    replay = p.filter("id = 1").select(F.sha2("prompt", 256).alias("key"), F.lit("known").alias("reply"))
    assert {r.id: r.reply for r in complete(p, str.upper, replay).collect()} == {1: "known", 2: "B"}
    v = embed(spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert abs(sum(x * x for x in v[0].embedding) - 1) < 1e-5 and sum(v[1].embedding) == 0


def test_runs_and_summaries_round_trip(spark, tmp_path):
    c, m = spark.createDataFrame([(0, 0.5)], "community long, conductance double"), spark.createDataFrame([(0, 7)], "community long, node long")
    for r in (1.0, 1.0, 2.5):
        sinks.write_communities(c, m, str(tmp_path / "c"), r, 0.3)
    got, members = sinks.read_communities(spark, str(tmp_path / "c"))
    assert sorted((x.resolution, x.threshold) for x in got.collect()) == [(1.0, 0.3), (2.5, 0.3)] and members.count() == 2
    s = spark.createDataFrame([(0, "text", ["a"])], "community long, summary string, entities array<string>")
    sinks.write_summaries(s, str(tmp_path / "s"))
    assert [tuple(x) for x in sinks.read_summaries(spark, str(tmp_path / "s")).collect()] == [(0, "text", ["a"])]
    sinks.write_metrics(spark.createDataFrame([(0.5, 0.25)], "nmi double, ari double"), str(tmp_path / "m"), 1.0, 0.3)
    assert spark.read.json(str(tmp_path / "m")).first().nmi == 0.5


def test_knowledge_base_by_key(spark, tmp_path):
    kb = str(tmp_path / "kb")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sinks.open_kb(spark, kb, "x") is None and not sinks.drop_kb(spark, kb, "x")
    sinks.upsert_kb(docs, kb, "x", key="doc_id", embed=lambda d: d.join(embed(d), "doc_id"))
    sinks.upsert_kb(spark.createDataFrame([(2, "c"), (3, "d")], "doc_id long, text string"), kb, "x", key="doc_id", embed=lambda d: d.join(embed(d), "doc_id"))
    assert sorted((r.doc_id, r.text, len(r.embedding)) for r in sinks.open_kb(spark, kb, "x").collect()) == [(1, "a", 64), (2, "c", 64), (3, "d", 64)]
    assert sinks.drop_kb(spark, kb, "x") and sinks.open_kb(spark, kb, "x") is None


def test_images_slides_and_tables(spark, tmp_path):
    images = spark.createDataFrame([(60, 60, 100, 100, 90), (59, 99, 100, 100, 0), (99, 10, 100, 100, 45)], "width int, height int, page_width int, page_height int, angle int")
    assert loaders.images_to_read(images).count() == 1
    w, h = loaders.turned_size(F.lit(30), F.lit(20), F.lit(90))
    assert tuple(spark.range(1).select(w, h).first()) == (20, 30)
    shapes = spark.createDataFrame([(1, 5, 0, "low"), (1, 0, 9, "right "), (1, 0, 1, "left"), (2, 0, 0, " "), (1, 1, 1, None)], "slide int, top int, left int, text string")
    assert [tuple(r) for r in loaders.reading_order(shapes).collect()] == [(1, "left\nright\nlow")]
    (tmp_path / "t.csv").write_text("a,b c\n1,x\n,\n")
    assert [r.page_content for r in loaders.csv_documents(spark, str(tmp_path / "t.csv")).orderBy("row").collect()] == ["a: 1\nb c: x", "a: \nb c: "]
