"""Byte-level BPE encoding and decoding by tree concatenation.

A text of up to ``LEAF_CHARS`` characters is encoded where it lies: class tables
give its pre-tokens, each distinct one is encoded once per piece of work, and its
ids are put wherever it stands. A longer text is cut into leaves that are encoded
as rows of their own, in parallel; the results are joined pairwise, as a tree.
At a join, a window around it is cut anew into pre-tokens, growing until it agrees
with the left part where it begins and with the right part where it ends; only
what lies between is encoded again. A single pre-token longer than ``LONG_TOKEN``
is joined by ids in the same way: the last ids of the left half and the first of
the right one are re-encoded, more and more of them, until the outermost ids come
out as they were; neighbouring ids that BPE leaves apart stay apart in any context.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import pretokens, textkernel
from threadloom.llm.token_counts import byte_alphabet, load
from threadloom.session import settle

LEAF_CHARS = 32_768
LONG_TOKEN = 2_048
#: Distinct pre-tokens whose ids a worker keeps (some 25 MB).
CACHE = 100_000
#: Characters that the end of a text can change the pre-tokens of.
MARGIN = 32


class Codec:
    """Encodes pre-tokens and joins encoded parts, for one vocabulary."""

    def __init__(self, path: str):
        self.tok, self.specials, self.alphabet = load(path)
        self.split = self.tok.model.tokenize
        back = {c: b for b, c in byte_alphabet().items()}
        added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special_ids = {t: i for i, t in added.items()}
        size = max(self.tok.get_vocab().values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in self.tok.get_vocab().items():
            self.bytes[i] = added[i].encode() if i in added else bytes(back[c] for c in t)
        self.lengths = np.array([len(b) for b in self.bytes])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.cache: dict[str, bytes] = {}

    def of_bytes(self, data: bytes) -> list[int]:
        return [t.id for t in self.split("".join([self.alphabet[b] for b in data]))]

    def word(self, text: str) -> list[int]:
        """Ids of one pre-token; a long one as a tree of halves."""
        if text in self.special_ids:
            return [self.special_ids[text]]
        if len(text) <= LONG_TOKEN:
            return self.of_bytes(text.encode())
        parts = [self.of_bytes(text[i : i + LONG_TOKEN].encode()) for i in range(0, len(text), LONG_TOKEN)]
        while len(parts) > 1:
            parts = [self.join_ids(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the bytes of both, which are parts of one pre-token."""
        k = 8
        while True:
            a, b = left[-k:], right[:k]
            got = self.of_bytes(b"".join([self.bytes[i] for i in a + b]))
            if (k >= len(left) or got[0] == a[0]) and (k >= len(right) or got[-1] == b[-1]):
                return left[: max(0, len(left) - k)] + got + right[k:]
            k *= 2

    def pre_tokens(self, text: str) -> np.ndarray:
        """Where the pre-tokens of one text start."""
        if not text:
            return np.zeros(0, np.int64)
        cps = textkernel.code_points(text)
        bounds = np.array([0, len(cps)])
        if pretokens.stable_rows(cps, bounds)[0]:
            return pretokens.byte_level(cps, bounds, self.specials)
        return self.library_starts(text)

    def library_starts(self, text: str) -> np.ndarray:
        import re

        out, at = [], 0
        for part in re.split("(" + "|".join(map(re.escape, self.specials)) + ")", text) if self.specials else [text]:
            out += [at] if part in self.special_ids else [at + a for _, (a, _) in self.tok.pre_tokenizer.pre_tokenize_str(part)] if part else []
            at += len(part)
        return np.array(out, np.int64)

    def blobs(self, words: list[str]) -> list[bytes]:
        """Ids of many pre-tokens, as int32 bytes."""
        cache, out = self.cache, []
        for w in words:
            got = cache.get(w)
            if got is None:
                got = np.array(self.word(w), np.int32).tobytes()
                if len(w) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = got
            out.append(got)
        return out

    def leaf(self, text: str) -> Part:
        starts = self.pre_tokens(text)
        words = [text[a:b] for a, b in zip(starts.tolist(), [*starts.tolist()[1:], len(text)], strict=False)]
        return Part(text, starts, self.blobs(words))

    def join(self, a: Part, b: Part) -> Part:
        """The encoding of both texts in a row, from those of each."""
        cut, text = len(a.text), a.text + b.text
        reach = 256
        while True:
            i = int(np.searchsorted(a.starts, max(0, cut - reach), side="right")) - 1
            p = int(a.starts[i]) if i >= 0 else 0
            end = min(len(text), cut + reach)
            starts = self.pre_tokens(text[p:end]) + p
            if end == len(text):
                q, j = end, len(b.starts)
                break
            ok = np.intersect1d(starts, b.starts + cut)
            ok = ok[(ok >= cut + MARGIN) & (ok <= end - MARGIN)]
            if len(ok):
                q = int(ok[0])
                j = int(np.searchsorted(b.starts, q - cut))
                break
            reach *= 2
        starts = starts[starts < q]
        last = a.starts[-1] if len(a.starts) else 0
        first = int(b.starts[1]) + cut if len(b.starts) > 1 else len(text)
        blobs = []
        for x, y in zip(starts.tolist(), [*starts.tolist()[1:], q], strict=False):
            if x == last and y == first and x < cut < y and y - x > LONG_TOKEN:
                left, right = (np.frombuffer(z, np.int32).tolist() for z in (a.blobs[-1], b.blobs[0]))
                blobs.append(np.array(self.join_ids(left, right), np.int32).tobytes())
            else:
                blobs += self.blobs([text[x:y]])
        keep = int(np.searchsorted(a.starts, p))
        return Part(text, np.concatenate([a.starts[:keep], starts, b.starts[j:] + cut]), a.blobs[:keep] + blobs + b.blobs[j:])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the decoded ids; bytes that are no text become U+FFFD."""
        lengths = self.lengths[ids]
        raw = self.flat[textkernel.ragged(self.starts[ids], lengths)].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


class Part:
    """A text, where its pre-tokens start, and the ids of each."""

    def __init__(self, text: str, starts: np.ndarray, blobs: list[bytes]):
        self.text, self.starts, self.blobs = text, starts, blobs


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


OUT = "doc_id long, row_no long, leaf int, text string, ids array<int>, decoded string"


def _batch(doc_id, row_no, leaf=None, text=None, ids=None, decoded=None) -> pa.RecordBatch:
    n = len(row_no)
    columns = {"doc_id": (doc_id, pa.int64()), "row_no": (row_no, pa.int64()), "leaf": (leaf, pa.int32()), "text": (text, pa.string()), "ids": (ids, pa.list_(pa.int32())), "decoded": (decoded, pa.string())}
    return pa.RecordBatch.from_pydict({k: pa.nulls(n, t) if v is None else v if isinstance(v, pa.Array) else pa.array(v, t) for k, (v, t) in columns.items()})


def _encoded_chunk(c: Codec, cps: np.ndarray, bounds: np.ndarray, ok: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(ids, decoded text) of the texts of a chunk; those that are not ``ok`` through the library's own bounds."""
    if ok.all():
        starts = pretokens.byte_level(cps, bounds, c.specials)
    else:
        parts = [c.library_starts(textkernel.to_text(cps[a:b])) + a if not k else pretokens.byte_level(cps[a:b], np.array([0, b - a]), c.specials) + a for a, b, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), ok.tolist(), strict=True) if b > a]
        starts = np.concatenate(parts)
    ends = np.append(starts[1:], len(cps))
    _, first, index = textkernel.distinct_spans(cps, starts, ends)
    flat = textkernel.to_text(cps)
    blobs = c.blobs([flat[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    pool = np.frombuffer(b"".join(blobs), np.int32)
    pool_starts = np.cumsum(sizes) - sizes
    lengths = sizes[index]
    ids = pool[textkernel.ragged(pool_starts[index], lengths)]
    total = np.concatenate([[0], np.cumsum(lengths)])
    cut = total[np.searchsorted(starts, bounds)]
    id_lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids))
    word_bytes = [b"".join([c.bytes[i] for i in pool[a : a + n].tolist()]) for a, n in zip(pool_starts.tolist(), sizes.tolist(), strict=True)]
    widths = np.fromiter(map(len, word_bytes), np.int64, len(word_bytes))
    byte_pool = np.frombuffer(b"".join(word_bytes), np.uint8)
    byte_starts = np.cumsum(widths) - widths
    raw = byte_pool[textkernel.ragged(byte_starts[index], widths[index])].tobytes()
    byte_total = np.concatenate([[0], np.cumsum(widths[index])])[np.searchsorted(starts, bounds)]
    try:
        raw.decode()
        decoded = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(byte_total.astype(np.int32).tobytes()), pa.py_buffer(raw)])
    except UnicodeDecodeError:
        decoded = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(byte_total[:-1].tolist(), byte_total[1:].tolist(), strict=True)], pa.string())
    return id_lists, decoded


def _encode(path: str, leaf_chars: int):
    """Short texts encoded; long ones as leaves that are still to be encoded."""

    @textkernel.tidied
    def run(batches) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for a, b, cps, bounds in textkernel.chunks(batch.column("text"), 4096):
                sizes = np.diff(bounds)
                long = np.flatnonzero(sizes > leaf_chars)
                for r in long.tolist():
                    text = textkernel.to_text(cps[bounds[r] : bounds[r + 1]])
                    leaves = [text[i : i + leaf_chars] for i in range(0, len(text), leaf_chars)]
                    n = len(leaves)
                    yield _batch(pa.array([doc_ids[a + r].as_py()] * n, pa.int64()), [base + a + r] * n, list(range(n)), leaves)
                rows = np.flatnonzero(sizes <= leaf_chars)
                if len(long):
                    cps = np.concatenate([cps[bounds[r] : bounds[r + 1]] for r in rows.tolist()] or [cps[:0]])
                    bounds = np.concatenate([[0], np.cumsum(sizes[rows])])
                if len(rows):
                    ids, decoded = _encoded_chunk(c, cps, bounds, pretokens.stable_rows(cps, bounds)) if len(cps) else (pa.array([[]] * len(rows), pa.list_(pa.int32())), pa.array([""] * len(rows)))
                    whole = _batch(doc_ids.slice(a, b - a).take(pa.array(rows)), rows + base + a, ids=ids, decoded=decoded)
                    for i in range(0, len(rows), 256):
                        yield whole.slice(i, 256)
            base += batch.num_rows

    return run


LEAF = "row_no long, doc_id long, leaf int, text string, starts binary, sizes binary, ids binary"


def _leaves(path: str):
    @textkernel.tidied
    def run(batches):
        c = codec(path)
        for batch in batches:
            parts = [c.leaf(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "row_no": batch.column("row_no"), "doc_id": batch.column("doc_id"), "leaf": batch.column("leaf"), "text": batch.column("text"),
                    "starts": pa.array([p.starts.astype(np.int64).tobytes() for p in parts], pa.binary()),
                    "sizes": pa.array([np.array([len(x) // 4 for x in p.blobs], np.int32).tobytes() for p in parts], pa.binary()),
                    "ids": pa.array([b"".join(p.blobs) for p in parts], pa.binary()),
                }
            )

    return run


def _tree(path: str):
    """Joins the leaves of one text, level by level."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c = codec(path)
        parts = []
        for r in rows.sort_values("leaf").itertuples():
            ends = (np.cumsum(np.frombuffer(r.sizes, np.int32)) * 4).tolist()
            parts.append(Part(r.text, np.frombuffer(r.starts, np.int64), [r.ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]))
        while len(parts) > 1:
            parts = [c.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        ids = np.frombuffer(b"".join(parts[0].blobs), np.int32)
        out = pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1].astype("Int64"), "ids": [ids], "decoded": [c.decode(ids).decode()]})
        return out

    return run


def encode_documents(documents: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (the text decoded from them) per document row.

    A null or empty text has no ids and decodes to the empty text. A null doc_id
    stays null; repeated ids and rows each keep their row. Special strings in a text
    are encoded as the library does by default. Other columns are not read, so
    their names cannot clash; no rows give no rows.
    """
    long = F.length("text") > leaf_chars
    short = documents.filter(~F.coalesce(long, F.lit(False))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = short.mapInArrow(_encode(path, leaf_chars), OUT).select("doc_id", "ids", "decoded")
    first = documents.filter(long).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path, leaf_chars), OUT)
    leaves = settle(first.select("row_no", "doc_id", "leaf", "text"), "leaves")
    parts = leaves.repartition("row_no", "leaf").mapInArrow(_leaves(path), LEAF)
    joined = parts.groupBy("row_no").applyInPandas(_tree(path), "doc_id long, ids array<int>, decoded string")
    return short.unionByName(joined)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encode_documents`` of all of ``documents`` with byte_bpe_50k.json, as counts and digests; odd rows as stated there."""
    import public_tokenizers

    got = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
