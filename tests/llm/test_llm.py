"""The pipeline operations against brute force, on small tables with odd rows."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import bpe_codec, cross_polytope, decontaminate, jaccard_join, language_id, lm_scoring, pii, suffix_dedup, token_counts

PIECES = ["'s", "'re", "'", "  ", " ", "\n", "\t", "a", "B", "é", "1", "23", "!", "…", "<|endoftext|>", "<|endof", "'ll", "日本", "İ", "é", "😀", " the", "word", "\x1c"]
WORDS = [f"w{i}" for i in range(40)]
DOC = "doc_id long, text string, lang string, source string, row_no long, s long, h string"


def texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def frame(spark, rows):
    """A documents table whose extra columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "x", 1, 2, "h") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def odd():
    return [*enumerate(texts(300, 1)), (None, None), (5, "twice"), (5, "twice"), (900, ""), (901, "word " * 9000), (902, "ab" * 20000)]


def test_token_counts(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(frame(spark, odd).repartition(3), path).collect())
    want = []
    for i, t in odd:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((str(i), len((t or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert token_counts.count_tokens(frame(spark, []), path).isEmpty()


def test_bpe_round_trip(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = sorted((str(r.doc_id), r.ids, r.decoded) for r in bpe_codec.encode_documents(frame(spark, odd), path, leaf_chars=4096).collect())
    ids = [(str(i), tok.encode(t or "", add_special_tokens=False).ids) for i, t in odd]
    assert got == sorted((i, x, tok.decode(x, skip_special_tokens=False)) for i, x in ids)


def test_bpe_tree_joins():
    c = bpe_codec.codec(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice([*PIECES, "x" * 40, " " * 35]) for _ in range(60))
        for n in (17, 100):
            parts = [c.leaf(text[i : i + n]) for i in range(0, len(text), n)]
            while len(parts) > 1:
                parts = [c.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            assert np.frombuffer(b"".join(parts[0].blobs), np.int32).tolist() == c.tok.encode(text, add_special_tokens=False).ids


def shingles(text: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def near_copies(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        words = [rng.choice(WORDS) + str(base % 6) for _ in range(rng.randint(3, 60))]
        for _ in range(12):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
            rows.append((len(rows), " ".join(w)))
    return [*rows, (1000, None), (1001, " \t"), (1002, "a b"), (1003, "A  b"), (3, rows[3][1])]


def test_jaccard_components(spark):
    rows = near_copies(7)
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows).repartition(3)).collect())
    assert got == sorted((i, len(x), find(i)) for i, x in sets)
    assert jaccard_join.jaccard_components(frame(spark, [])).isEmpty()
    alone = jaccard_join.jaccard_components(frame(spark, [(None, "a b c"), (None, None)])).collect()
    assert sorted((r.n_shingles, r.component_id) for r in alone) == [(0, None), (1, None)]


def test_large_buckets_in_blocks(spark, monkeypatch):
    rows = near_copies(9)
    want = sorted(map(tuple, jaccard_join.jaccard_components(frame(spark, rows)).collect()))
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "PER_TASK", 2)
    assert sorted(map(tuple, jaccard_join.jaccard_components(frame(spark, rows)).collect())) == want


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = language_id.identify_languages(frame(spark, [(1, None), (2, "12 !"), (None, "text")])).collect()
    assert {r.lang_pred for r in odd} == {"und"}


def test_pii_base_spans():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "@", ".", "b.c", "-", " ", "1", "25", "4.5", "+1", "(", "4111 1111 1111 1111", "999", "é", "%", "192.168.0.1", "+44 20 7946 0958"]) for _ in range(rng.randint(1, 18)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        want += [(m.start(), 2, m.end()) for m in card.finditer(t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 9 <= len(digits(m)) <= 15]
        assert pii.base_spans(t) == sorted(want), t


def test_pii_terms(spark):
    rows = [(i, f"call zebulon at z@x.org the end of it") for i in range(8)] + [(i, "the end of it goes on for all") for i in range(8, 60)] + [(70, None), (71, "")]
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, rows), ["doc_id"]).collect()}
    words = {rows[0][1][x.start : x.end] for x in got[0].terms}
    assert "zebulon" in words and "the" not in words and not got[20].terms and not got[70].base
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "zebulon" not in clean[0] and "<EMAIL>" in clean[0] and clean[20] == rows[20][1] and clean[70] is None


def test_pii_terms_of_one_document(spark):
    text = "zebulon has lived a long way off from here and goes on with the end of it q@x.org"
    rows = [(0, text), (1, "zebulon goes on with it")] + [(i, "the end of it goes on with a long way off from here and has lived") for i in range(2, 60)]
    got = {r.doc_id: {rows[r.doc_id][1][x.start : x.end] for x in r.terms} for r in pii.find_personal_data(frame(spark, rows), ["doc_id"]).collect()}
    assert got == {0: {"zebulon"}, 1: {"zebulon"}} | {i: set() for i in range(2, 60)}
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert clean[0] == text.replace("zebulon", "<WORD>").replace("q@x.org", "<EMAIL>") and clean[1] == "<WORD> goes on with it" and clean[9] == rows[9][1]


def test_decontaminate(spark):
    rng = random.Random(5)
    item = [f"t{rng.randrange(500)}" for _ in range(30)]
    changed = [*item]
    for k in (4, 11, 19, 26):
        changed[k] = "other"
    noise = lambda: " ".join(f"t{rng.randrange(500)}" for _ in range(60))
    docs = [(1, f"{noise()} {' '.join(item)} {noise()}"), (2, f"{noise()} {' '.join(changed).upper()}. {noise()}"), (3, noise()), (4, None), (5, ""), (None, " ".join(item)), (6, "one two three, four five")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "x"), (4, "one two three four five")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, docs), bench).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (6, 4)}
    assert sorted(str(r.doc_id) for r in decontaminate.without_leaks(frame(spark, docs), bench).collect()) == ["3", "4", "5"]
    assert decontaminate.find_leaks(frame(spark, docs), bench.filter("false")).isEmpty()


def test_decontaminate_stretches():
    rng = random.Random(8)
    for _ in range(3000):
        same = np.array([rng.random() < rng.choice((0.6, 0.8, 0.9)) for _ in range(rng.randint(1, 40))])
        want = max((int(same[i:j].sum()), i - j) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 5 * same[i:j].sum() >= 4 * (j - i) or not same.any())
        start, end, match = decontaminate.best_stretch(same)
        assert (match, start - end) == want or not same.any() and match == 0


def test_decontaminate_short_substituted(spark):
    rng = random.Random(9)
    items, docs, want = [], [], set()
    for i in range(400):
        item = [f"i{i}x{k}" for k in range(rng.randint(5, 24) if i else 16)]
        copy = [*item]
        for k in rng.sample(range(len(item)), rng.randint(0, min(6, len(item) // 2))) if i else (2, 13):
            copy[k] = "other"
        same = [x == y for x, y in zip(item, copy, strict=True)]
        least = min(12, -(-4 * len(item) // 5))
        if any(sum(same[a:b]) >= least and 5 * sum(same[a:b]) >= 4 * (b - a) for a in range(len(same)) for b in range(a + least, len(same) + 1)):
            want.add((i, i))
        items.append((i, " ".join(item)))
        docs.append((i, "before it " + " ".join(copy) + " after it"))
    tail = [f"y{k}" for k in range(92)]
    items.append((400, " ".join(tail)))
    docs.append((400, " ".join(w if k < 12 or k % 4 else "other" for k, w in enumerate(tail))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, docs), bench).collect()}
    assert (0, 0) in want and got == want | {(400, 400)}


def test_decontaminate_masks_meet_every_leak():
    # A leak of 24 matches or more holds one of fewer: one of the parts before and after its twelfth match.
    left = np.array([(1 << m + k) - 1 - sum(1 << i for i in c) for m in range(12, 24) for k in range(m // 4 + 1) for c in itertools.combinations(range(1, m + k - 1), k)])
    for mask in decontaminate.SEED_MASKS:
        bits = sum(1 << i for i, c in enumerate(mask) if c == "1")
        for s in range(29 - len(mask)):
            left = left[left & bits << s != bits << s]
    assert not len(left)


def test_decontaminate_masks_meet_every_short_leak():
    for size in range(decontaminate.MIN_ITEM, 15):
        wrong = size - decontaminate.least_match(size)
        left = [(1 << size) - 1 - sum(1 << i for i in c) for c in itertools.combinations(range(size), wrong)]
        for mask in decontaminate.masks_of(size):
            bits = sum(1 << i for i, c in enumerate(mask) if c == "1")
            left = [x for x in left if not any((x >> s) & bits == bits for s in range(size - len(mask) + 1))]
        assert not left, size


def test_decontaminate_long_and_repeated(spark):
    rng = random.Random(15)
    item = [f"t{rng.randrange(500)}" for _ in range(40)]
    words = [f"n{rng.randrange(10**6)}" for _ in range(60_000)]
    text = " ".join([*words[:30_000], *item, *words[30_000:]])
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item))], "item_id long, text string")
    got = decontaminate.find_leaks(frame(spark, [(1, text), (1, text), (2, " ".join(words))]), bench).collect()
    assert [(r.doc_id, r.item_id, text[r.start : r.end], r.n_match) for r in got] == [(1, 1, " ".join(item), 40)] * 4
    assert decontaminate.find_leaks(frame(spark, []), bench).isEmpty()


def test_suffix_dedup(spark):
    rng = random.Random(6)
    words = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    shared, nested = words(70), words(40)
    docs = [words(80) + shared + words(30), words(10) + shared, shared[:49] + words(100), nested + shared[5:60] + words(9), nested + words(60), words(400)]
    rows = [*enumerate(map(" ".join, docs)), (50, None), (51, ""), (52, "a b")]
    windows = collections.defaultdict(set)
    for i, w in enumerate(docs):
        for p in range(len(w) - 49):
            windows[tuple(w[p : p + 50])].add((i, p))
    want = collections.defaultdict(set)
    for at in windows.values():
        for i, p in at if len(at) > 1 else ():
            want[i].update(range(p, p + 50))
    got = {r.doc_id: {k for x in r.spans for k in range(x.start, x.end)} for r in suffix_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert got == dict(want)


def test_suffix_dedup_edited_copies(spark):
    rng = random.Random(12)
    first = [f"v{rng.randrange(4000)}" for _ in range(300)]
    docs = [[w if rng.random() > 0.04 else f"e{rng.randrange(10**6)}" for w in first] for _ in range(200)]
    windows = collections.Counter(tuple(w[p : p + 50]) for w in docs for p in range(len(w) - 49))
    want = {}
    for i, w in enumerate(docs):
        at = {k for p in range(len(w) - 49) if windows[tuple(w[p : p + 50])] > 1 for k in range(p, p + 50)}
        if at:
            want[i] = at
    got = {r.doc_id: {k for x in r.spans for k in range(x.start, x.end)} for r in suffix_dedup.repeated_passages(frame(spark, [*enumerate(map(" ".join, docs))])).collect()}
    assert got == want


def test_lm_scoring(spark):
    good, bad = "the quiet river runs on", "buy cheap now click here"
    rows = [(i, good if i % 2 else bad) for i in range(40)] + [(100, None), (101, " "), (None, good)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(1, 1, 0), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm_scoring.score_documents(frame(spark, rows), labels).collect()}
    assert got[35].score < 0 < got[36].score and got[100].score is None and got[101].n_tokens == 0 and got[35].n_tokens == 5
    assert len(got) == 43
    # Far more buckets than a block has hashes.
    many = {r.doc_id: r for r in lm_scoring.score_documents(frame(spark, rows), labels, 8).collect()}
    assert many == got
    assert lm_scoring.score_documents(frame(spark, rows).limit(0), labels).count() == 0


def test_lm_scoring_counts_every_ngram(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(f"W{rng.randrange(10 ** rng.randint(1, 8))}" for _ in range(rng.randint(0, 900)))) for i in range(300)]
    rows += [(None, rows[7][1]), (7, rows[7][1]), (900, None)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(0, 300, 3)], "doc_id long, quality int, toxic int")
    texts = [((t or "").lower().split(), i is not None and i < 300 and i % 6 == 0) for i, t in rows]
    models = []
    for want in (True, False):
        words, before, pairs = collections.Counter(), collections.Counter(), collections.Counter()
        for w, good in texts:
            if good or not want:
                words.update(w)
                before.update(["", *w][: len(w)])
                pairs.update(zip(["", *w], w))  # noqa: B905
        models.append((words, before, pairs))
    vocabulary = len(models[1][0])
    assert vocabulary > 1 << 16

    def loss(m, w):
        words, before, pairs = m
        n = words.total()
        return -np.mean([np.log(0.6 * pairs[a, b] / max(before[a], 1) + 0.35 * words[b] / n + 0.05 / vocabulary) for a, b in zip(["", *w], w)])  # noqa: B905

    want = sorted((str(i), len(w), *((round(loss(m, w), 9) for m in models) if w else (None, None))) for (i, _), (w, _) in zip(rows, texts, strict=True))
    for chars in (lm_scoring.BUCKET_CHARS, 100_000):
        got = lm_scoring.score_documents(frame(spark, rows).repartition(3), labels, chars).collect()
        assert sorted((str(r.doc_id), r.n_tokens, *(x if x is None else round(x, 9) for x in (r.target_loss, r.background_loss))) for r in got) == want


def test_block_without_good_texts():
    for size in (10, 100, 1000) * 20:
        used = np.full(size, 255, np.uint8)
        del used
        assert not lm_scoring._good({"good": None, "ids": [0] * size}).any()
    assert lm_scoring._good({"good": b"\x40", "ids": [0] * 20}).nonzero()[0].tolist() == [1]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[500:540] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0, 2.0]), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in cross_polytope.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10].tolist()
        own = sorted(got[q])
        assert [r for r, *_ in own] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-12 for _, v, s in own)
        hits += len(set(want) & {v for _, v, _ in own})
    assert hits >= 54 and 700 not in got
    assert cross_polytope.nearest(df.filter("false"), df).isEmpty()


def test_neighbours_stay_when_far_vectors_come(spark):
    rng = np.random.default_rng(2)
    near, far = rng.normal(size=(500, 64)), 1000 * rng.normal(size=(6000, 64))
    x = near / np.linalg.norm(near, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, far]))], "vec_id long, embedding array<double>")
    few, queries = df.filter("vec_id < 500"), df.filter("vec_id < 500 and vec_id % 25 = 0")
    alone, beside = (sorted(map(tuple, cross_polytope.nearest(v, queries).collect())) for v in (few, df))
    assert alone == beside and len(alone) == 200
    d = np.sqrt(((x[::25, None] - x[None]) ** 2).sum(2))
    d[np.arange(20), np.arange(0, 500, 25)] = np.inf
    want = {(25 * i, v) for i, own in enumerate(np.argsort(d, 1)[:, :10].tolist()) for v in own}
    assert len(want & {(q, v) for q, _, v, _ in beside}) >= 180


def test_probes_are_the_nearest_buckets():
    x = np.random.default_rng(3).normal(size=(5, 20))
    (y,) = cross_polytope.rotations(x, 4)
    for probes in (1, 7, 64):
        got = cross_polytope.probe_codes(x, 2, probes)
        for row, table in np.ndindex(5, 2):
            both = (y[row, 2 * table][:, None] + y[row, 2 * table + 1][None, :]).ravel()
            assert sorted(both[got[row, table]]) == sorted(both)[-probes:] and len(set(got[row, table])) == probes


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in out}
    groups = jaccard_join.jaccard_components(docs).collect()
    leaks = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert not kept & leaks and len(kept) == len(out)
    firsts = {r.component_id for r in groups}
    assert len(kept) <= len(firsts) and len(kept) > 0.9 * len(firsts - leaks)
    assert hashlib.sha256(str(sorted(out[0].ids)).encode()).hexdigest() and all(r.n_tokens == len(r.ids) for r in out)
