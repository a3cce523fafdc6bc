"""Texts that defeat weak hashes, and every pipeline stage on odd tables."""

import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from threadloom.llm import bpe_codec, jaccard_join, language_id, pii, textkernel, token_counts


def thue_morse(a: str, b: str, n: int) -> str:
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


PAIRS = [w for n in (64, 90, 128, 1024, 8192) for w in (thue_morse("s", "r", n), thue_morse("r", "s", n))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_thue_morse_words(spark):
    rows = [*enumerate(PAIRS)]
    df = frame(spark, rows).coalesce(1)
    for path, got in (
        (public_tokenizers.path("word_bpe_49k.json"), lambda p: {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, p).collect()}),
        (public_tokenizers.path("byte_bpe_50k.json"), lambda p: {r.doc_id: len(r.ids) for r in bpe_codec.encode_documents(df, p).collect()}),
    ):
        tok = Tokenizer.from_file(path)
        assert got(path) == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert {r.doc_id: r.decoded for r in bpe_codec.encode_documents(df, path).collect()} == dict(rows)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()} == {i: i for i, _ in rows}


def test_equal_hashes_are_told_apart(monkeypatch):
    words = ["ab", "cd", "ab", "ef", "x" * 200, "y" * 200, "x" * 200, "", "cd"]
    cps = textkernel.code_points("".join(words))
    ends = np.cumsum([len(w) for w in words])
    monkeypatch.setattr(textkernel, "span_hashes", lambda c, s, e: ((e - s) > 2).astype(np.uint64))
    _, first, index = textkernel.distinct_spans(cps, ends - [len(w) for w in words], ends)
    assert [words[first[i]] for i in index] == words and len(first) == 6
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["the cat and the dog", "a dog ran to a cat", "and so on"]
    import pyarrow as pa

    for _, _, got, _, at, row in token_counts._blocks(pa.array(texts), path):
        assert [[got[k] for k in at[row == r]] for r in range(3)] == [t.split() for t in texts]
    assert tok


def test_hashes_do_not_depend_on_what_stands_beside():
    word = "naïve"
    alone, beside = textkernel.code_points(word), textkernel.code_points("日本 " + word)
    a, b = np.array([0]), np.array([3])
    assert alone.dtype != beside.dtype
    assert textkernel.span_hashes(alone, a, a + 5) == textkernel.span_hashes(beside, b, b + 5)


def test_language_of_a_task_without_words(spark):
    rows = [(i, "der Hund und die Katze laufen", "de") for i in range(20)] + [(50, None, "de"), (51, "", "fr"), (52, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parts = df.filter("doc_id < 50").coalesce(1).union(df.filter("doc_id = 50").coalesce(1)).union(df.filter("doc_id > 50").coalesce(1))
    got = {r.doc_id: r for r in language_id.identify_languages(parts).collect()}
    assert len(got) == 23 and got[3].lang_pred == "de" and {got[i].lang_pred for i in (50, 51, 52)} == {"und"} and got[50].score == 0
    assert language_id.identify_languages(df.filter("false")).isEmpty()


def test_language_quotas():
    assert language_id.quotas({"a": 1000, "b": 10, "c": 500}, 600) == {"a": 295, "b": 10, "c": 295}
    assert language_id.quotas({"a": 5, "b": 7, "c": 9}, 2) == {"a": 1, "b": 1, "c": 1}


def long_text(seed: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 10**6, 30_000))


def test_copies_go_by_row(spark):
    a, b = long_text(1)[:400], long_text(2)[:400]
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, "x y"), (4, "X y"), (4, "x y"), (5, None), (5, ""), (6, " "), (None, a), (None, a), (7, "x y z")]
    got = sorted((str(i), t) for i, t in jaccard_join.without_copies(frame(spark, rows)).collect() if t is not None)
    assert got == sorted([("1", a), ("2", b), ("4", "X y"), ("5", ""), ("6", " "), ("None", a), ("None", a), ("7", "x y z")])
    assert jaccard_join.without_copies(frame(spark, rows)).filter("text is null").count() == 1
    assert jaccard_join.without_copies(frame(spark, [])).isEmpty()


def test_hot_groups_are_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    rows = [(i, f"one two three four five six seven eight nine ten eleven twelve{i % 2 if i > 40 else ''}") for i in range(60)] + [(100 + i, f"single words of number {i} and {i * i} here") for i in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: 0 if i < 60 else i for i, _ in rows}


STAGE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", {"k": 1}),
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", {"k": 1}),
    (2, "write to me at someone@mail.example.com or call +44 20 7946 0958 now", "en", "b", None),
    (3, None, "en", None, None),
    (4, "", None, "c", None),
    (None, "a text without a number of its own, but words", "en", "d", None),
    (5, " \t\n", "en", "e", None),
    (6, "no language is known of these words at all", None, "f", None),
    (7, long_text(3), "en", "g", None),
]
STAGE_TABLE = "doc_id long, text string, lang string, `a b` string, `row` map<string,int>"


@pytest.fixture()
def bench_dir(spark, tmp_path):
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, bench_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([(*r, 1, "s") for r in STAGE_ROWS], f"{STAGE_TABLE}, n_chars long, s string")
    got = stage(spark, docs, bench_dir)
    rows = got.collect()
    if name == "bpe_encode":
        tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted((str(r[0]), tok.encode(r[1] or "", add_special_tokens=False).ids) for r in STAGE_ROWS)
    else:
        assert got.columns == docs.columns and got.schema["a b"].dataType == docs.schema["a b"].dataType
        texts = [r.text for r in rows]
    if name == "language_id":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "6", "7", "None"]
    if name == "near_duplicates":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "4", "5", "6", "7", "None"]
        assert [r["row"] for r in rows if r.doc_id == 1] == [{"k": 1}]
    if name == "decontaminate":
        assert sorted(str(r.doc_id) for r in rows) == ["2", "3", "4", "5", "6", "7", "None"]
    if name == "pii":
        assert len(rows) == len(STAGE_ROWS) and None in texts and "" in texts and sum("<EMAIL>" in (t or "") and "<PHONE>" in t for t in texts) == 1
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    empty = stage(spark, docs.filter("false"), bench_dir)
    assert empty.isEmpty() and empty.columns == got.columns
    nothing = stage(spark, spark.createDataFrame([(None,) * 7] * 3, docs.schema), bench_dir)
    assert nothing.count() == (0 if name == "language_id" else 3)


def test_pii_of_long_and_repeated_rows(spark):
    text = long_text(9) + " reach me at lone.person@mail.example.com or 10.1.2.3 " + long_text(10)
    rows = [(1, text), (1, text), (2, long_text(9)), (3, None)]
    got = pii.find_personal_data(frame(spark, rows), ["doc_id"]).collect()
    bases = [[(text[x.start : x.end], x.kind) for x in r.base] for r in got if r.doc_id == 1]
    assert bases == [[("lone.person@mail.example.com", 0), ("10.1.2.3", 1)]] * 2
    assert pii.find_personal_data(frame(spark, []), ["doc_id"]).isEmpty()


def test_pii_terms_against_brute_force(spark, sf):
    """All terms of the query's spans by PMI over IC, counted anew on all documents."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, words, held, places = len(docs), {}, {}, []
    for k, (_, t) in enumerate(docs):
        base = pii.base_spans(t)
        own = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t)]
        outside = [x for x in own if not any(s < x[2] and x[1] < e for s, _, e in base)]
        for w in {w for w, *_ in own}:
            words.setdefault(w, set()).add(k)
        for s, kind, e in base:
            held.setdefault(pii.entity(kind, t[s:e]), {}).setdefault(k, {w for w, *_ in outside})
        places.append((base, outside))
    flagged: dict[str, bool] = {}
    for by in held.values():
        for w in set().union(*by.values()):
            both = sum(w in own for own in by.values())
            share = np.log2(n * both / (len(by) * len(words[w]))) / np.log2(n / len(by))
            if share >= pii.GENERALISE:
                flagged[w] = flagged.get(w, False) or 2 * both >= len(words[w])
    from threadloom.llm.pii import op3_pii

    got = {r.doc_id: r.spans for r in op3_pii(spark, sf).collect()}
    assert flagged
    for (i, _), (base, outside) in zip(docs, places, strict=True):
        terms = [(s, 4, e) for w, s, e in outside if w in flagged and (flagged[w] or base)]
        assert got[i] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted([*base, *terms])), i
