"""Token counts: pieces counted once per distinct pre-token, then joined to frequencies.

One pass gathers the distinct pre-tokens, each of which the tokenizer's model
splits once. A second pass gives, per block of documents and pre-token, in how
many pieces of text of which document it stands; the two meet in a join on the
pre-token and sum up per document. Ids are never materialised.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import pretokens, textkernel
from threadloom.session import settle

#: Bytes of the texts whose frequencies go out as one block.
BLOCK_BYTES = 16_000_000
#: Characters that are split at once: the more, the fewer times a pre-token comes up anew.
SPLIT_CHARS = 2_000_000
#: Distinct pre-tokens that a task holds before they go out.
HELD = 400_000


@lru_cache(4)
def load(path: str):
    """The tokenizer at ``path`` with its special strings and byte alphabet."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    specials = tuple(t.content for t in tok.get_added_tokens_decoder().values())
    alphabet = byte_alphabet()
    assert set(alphabet.values()) == set(pre_tokenizers.ByteLevel.alphabet())
    return tok, specials, alphabet


@lru_cache(1)
def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def library_pretokens(tok, specials: tuple[str, ...], text: str) -> list[str]:
    """Pre-tokens as the library itself makes them; special strings stand alone."""
    import re

    back = {c: b for b, c in byte_alphabet().items()}
    out = []
    for part in re.split("(" + "|".join(map(re.escape, specials)) + ")", text) if specials else [text]:
        if part in specials:
            out.append(part)
        elif part:
            part = tok.normalizer.normalize_str(part) if tok.normalizer else part
            out += [bytes(back[c] for c in t).decode("utf-8", "replace") for t, _ in tok.pre_tokenizer.pre_tokenize_str(part)]
    return out


def _blocks(texts: pa.Array, path: str) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct pre-tokens, their hashes, index of each one's pre-token, its row) by chunk."""
    tok, specials, _ = load(path)
    for a, b, raw, bounds in textkernel.chunks(texts, max_chars=SPLIT_CHARS):
        cps = textkernel.lowered(raw)
        start, end = pretokens.word_level(cps, bounds, specials, raw)
        row = np.searchsorted(bounds, start, side="right") - 1
        ok = pretokens.stable_rows(raw, bounds)
        keep = ok[row]
        start, end, row = start[keep], end[keep], row[keep]
        distinct, first, index = textkernel.distinct_spans(cps, start, end)
        flat = textkernel.to_text(cps)
        words = [flat[x:y] for x, y in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if not ok.all():
            known: dict[str, int] = {w: k for k, w in enumerate(words)}
            more, rows = [], []
            for r in np.flatnonzero(~ok):
                text = textkernel.to_text(raw[bounds[r] : bounds[r + 1]])
                got = [known.setdefault(w, len(known)) for w in library_pretokens(tok, specials, text)]
                more += got
                rows += [r] * len(got)
            distinct = np.append(distinct, [_hash(w) for w in list(known)[len(words) :]]).astype(np.uint64)
            words = list(known)
            index, row = np.append(index, np.array(more, np.int64)), np.append(row, np.array(rows, np.int64))
        yield a, b, words, distinct, index, row


def _hash(word: str) -> np.uint64:
    cps = textkernel.code_points(word)
    return textkernel.span_hashes(cps, np.array([0]), np.array([len(cps)]))[0]


def _distinct(path: str):
    """Distinct pre-tokens of a task's texts; the set goes out whenever it is large."""

    @textkernel.tidied
    def run(batches):
        seen: set[str] = set()
        for batch in batches:
            for _, _, words, *_ in _blocks(batch.column("text"), path):
                seen.update(words)
                if len(seen) > HELD:
                    yield pa.RecordBatch.from_pydict({"pretoken": pa.array(list(seen), pa.string())})
                    seen = set()
        if seen:
            yield pa.RecordBatch.from_pydict({"pretoken": pa.array(list(seen), pa.string())})

    return run


def _pieces(path: str):
    def run(batches):
        tok, specials, alphabet = load(path)
        split = tok.model.tokenize
        for batch in batches:
            words = batch.column("pretoken").to_pylist()
            n = [1 if w in specials else len(split("".join([alphabet[b] for b in w.encode()]))) for w in words]
            yield pa.RecordBatch.from_pydict({"pretoken": batch.column("pretoken"), "n_pieces": pa.array(n, pa.int32())})

    return run


def _numbered(batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches with the number of their first row, unique over all tasks."""
    base = TaskContext.get().partitionId() << 40
    for batch in batches:
        yield base, batch
        base += batch.num_rows


def _frequencies(path: str):
    """Per block and pre-token: the block's rows that hold it, as steps, and how often.

    A posting is twice the step from the row before, plus one if the pre-token
    stands there more than once; those counts follow in ``more``.
    """

    def flush(block: int, parts: list, ids: pa.Array, n_bytes: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = np.asarray(ids.is_valid())
        meta = ids.fill_null(0).to_numpy().tobytes() + known.tobytes() + n_bytes.astype(np.int64).tobytes()
        # No pre-token holds white space, so this one is the block's own.
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "wide": pa.array([False]), "pretoken": pa.array([f" {block}"]), "postings": pa.array([meta], pa.binary()), "more": pa.array([b""], pa.binary())})
        if not parts:
            return
        words = np.concatenate([w for w, *_ in parts])
        shift = np.cumsum([0, *(len(w) for w, *_ in parts[:-1])])
        _, first, same = np.unique(np.concatenate([h for _, h, *_ in parts]), return_index=True, return_inverse=True)
        if not (words[first][same] == words).all():  # two pre-tokens of one hash
            _, first, same = np.unique(words, return_index=True, return_inverse=True)
        word = same[np.concatenate([index + k for k, (_, _, index, _, _) in zip(shift.tolist(), parts, strict=True)])]
        row, count = (np.concatenate([p[k] for p in parts]) for k in (3, 4))
        order = np.argsort(word, kind="stable")  # rows ascend within each pre-token
        word, row, count = word[order], row[order], count[order]
        cut = np.searchsorted(word, np.arange(len(first) + 1))
        step = np.diff(row, prepend=0)
        step[cut[:-1]] = row[cut[:-1]]
        many = count > 1
        wide = bool(step.max(initial=0) >= 1 << 15 or count.max(initial=0) >= 1 << 16)
        kind = np.uint32 if wide else np.uint16
        extra = np.concatenate([[0], np.cumsum(many)])[cut]
        whole = pa.RecordBatch.from_pydict(
            {
                "block": pa.array(np.full(len(first), block), pa.int64()), "wide": pa.array(np.full(len(first), wide)), "pretoken": pa.array(words[first], pa.string()),
                "postings": _binary((2 * step + many).astype(kind), cut), "more": _binary(count[many].astype(kind), extra),
            }
        )
        for i in range(0, len(first), 100_000):
            yield whole.slice(i, 100_000)

    @textkernel.tidied
    def run(batches):
        for base, batch in _numbered(batches):
            text, ids = pc.fill_null(batch.column("text"), ""), batch.column("doc_id")
            n_bytes = pc.binary_length(text).to_numpy(zero_copy_only=False)
            parts, start, size = [], 0, 0
            for a, b, words, hashes, index, row in _blocks(text, path):
                own = int(n_bytes[a:b].sum())
                if size and size + own > BLOCK_BYTES:
                    yield from flush(base + start, parts, ids.slice(start, a - start), n_bytes[start:a])
                    parts, start, size = [], a, 0
                size += own
                if len(index):
                    n = b - a
                    key, count = np.unique(index.astype(np.int64) * n + row, return_counts=True)
                    word, doc = np.divmod(key, n)
                    parts.append((np.array(words, object), hashes, word, doc + (a - start), count))
            if batch.num_rows:
                yield from flush(base + start, parts, ids.slice(start), n_bytes[start:])

    return run


def _binary(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """A binary array whose element i holds values[cut[i] : cut[i + 1]]."""
    offsets = (cut * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _values(column: list[bytes], wide: bool) -> tuple[np.ndarray, np.ndarray]:
    kind = np.dtype(np.uint32 if wide else np.uint16)
    return np.frombuffer(b"".join(column), kind).astype(np.int64), np.array([len(x) for x in column], np.int64) // kind.itemsize


def _sums(batches):
    """Adds pieces times counts into one array per block; a task's arrays go out when they
    are many. What belongs to a block itself passes through."""
    sums: dict[int, np.ndarray] = {}

    def row(block: int, total: np.ndarray | None, meta: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "sums": pa.array([total if total is None else total.tobytes()], pa.binary()), "meta": pa.array([meta], pa.binary())})

    def out():
        for block, total in sums.items():
            yield row(block, total, None)

    for batch in batches:
        own = batch.filter(pc.is_null(batch.column("n_pieces")))
        for block, meta in zip(own.column("block").to_pylist(), own.column("postings").to_pylist(), strict=True):
            yield row(block, None, meta)
        batch = batch.filter(pc.is_valid(batch.column("n_pieces")))
        blocks, n = batch.column("block").to_numpy(), batch.column("n_pieces").to_numpy().astype(np.int64)
        wide = batch.column("wide").to_numpy(zero_copy_only=False)
        post, more = batch.column("postings").to_pylist(), batch.column("more").to_pylist()
        order = np.lexsort((wide, blocks))
        cuts = np.flatnonzero((np.diff(blocks[order]) != 0) | (np.diff(wide[order].astype(int)) != 0)) + 1
        for ks in np.split(order, cuts):
            if not len(ks):
                continue
            block, w = int(blocks[ks[0]]), bool(wide[ks[0]])
            values, lengths = _values([post[k] for k in ks], w)
            extra, _ = _values([more[k] for k in ks], w)
            step, count = values >> 1, np.ones(len(values), np.int64)
            count[(values & 1).astype(bool)] = extra
            run = np.cumsum(step)
            first = np.cumsum(lengths) - lengths
            doc = run - np.repeat(np.where(first > 0, run[first - 1], 0), lengths)
            got = np.bincount(doc, weights=count * np.repeat(n[ks], lengths)).astype(np.int64)
            old = sums.get(block)
            if old is not None:
                if len(old) < len(got):
                    old, got = got, old
                old[: len(got)] += got
                got = old
            sums[block] = got
        if sum(map(len, sums.values())) > 4_000_000:
            yield from out()
            sums = {}
    yield from out()


def _totals(batches):
    """Rows come by block: the sum of each block's arrays, a row per document."""
    now, total, meta = None, np.zeros(0, np.int64), b""

    def out():
        n = len(meta) // 17
        ids, known, n_bytes = np.frombuffer(meta, np.int64, n), np.frombuffer(meta, bool, n, 8 * n), np.frombuffer(meta[9 * n :], np.int64)
        tokens = np.zeros(n, np.int64)
        tokens[: len(total)] = total[:n]
        whole = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, mask=~known), "n_bytes": pa.array(n_bytes), "n_tokens": pa.array(tokens)})
        for i in range(0, n, 100_000):
            yield whole.slice(i, 100_000)

    for batch in batches:
        for block, blob, own in zip(*(batch.column(c).to_pylist() for c in ("block", "sums", "meta")), strict=True):
            if block != now:
                yield from out()
                now, total, meta = block, np.zeros(0, np.int64), b""
            if own is not None:
                meta = own
                continue
            got = np.frombuffer(blob, np.int64)
            if len(got) > len(total):
                total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
            total[: len(got)] += got
    yield from out()


def count_tokens(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) per document row.

    A null text counts as empty, with 0 bytes and tokens. A null doc_id stays
    null; repeated ids and repeated rows each keep a row of their own, told
    apart by their place in the input. Other columns of ``documents`` are not
    read, so their names cannot clash. An empty table gives no rows.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = settle(
        documents.select("text").mapInArrow(_distinct(path), "pretoken string").distinct().mapInArrow(_pieces(path), "pretoken string, n_pieces int"),
        "pieces",
    )
    frequencies = documents.mapInArrow(_frequencies(path), "block long, wide boolean, pretoken string, postings binary, more binary")
    matched = frequencies.join(pieces, "pretoken", "left").select("block", "wide", "postings", "more", "n_pieces")
    sums = matched.mapInArrow(_sums, "block long, sums binary, meta binary").repartition("block").sortWithinPartitions("block")
    counts = sums.mapInArrow(_totals, "doc_id long, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``count_tokens`` of all of ``documents`` with word_bpe_49k.json; odd rows as stated there."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
