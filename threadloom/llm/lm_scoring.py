"""Scores by cross-entropy difference of two n-gram models.

The target model is counted over documents labelled good (quality 1, not toxic), the
background model over all documents. Both are bigram models with the same
vocabulary (all distinct words, A-Z folded) and the same interpolation, so that their
sizes cancel. A document's score is the mean over its words of the target's loss less
the background's: the lower, the more it is like the target.

Words and bigrams are counted by 64-bit hashes, none left out. Texts are kept
in blocks. Each block sends its distinct hashes, with its own counts, to buckets of
hashes; a bucket adds them up and sends every block the sums in the order of what
came; the block's texts meet them and are scored. Hashes are dealt evenly and a block
sends each once, so no common word or bigram makes a task larger. A block has no row for
a bucket that it has no hash of, so rows grow as the texts do, not as blocks times buckets;
the sizes of vocabulary and models, which every block needs, are added up beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import textkernel
from threadloom.session import settle

#: Characters of a block of texts (one text, if it is longer).
BLOCK_CHARS = 2_000_000
#: Characters of the corpus for each bucket of hashes.
BUCKET_CHARS = 16_000_000
#: Up to so many documents their labels are broadcast, at a bit each.
LABELS_BROADCAST = 1 << 28
#: Shares of the bigram and unigram estimates; the rest is uniform.
SHARES = (0.6, 0.35)
#: What stands before a text's first word, and what tells words from bigrams (fixed values).
START, WORD = np.uint64(0x51AB2E7F09C4D683), np.uint64(0x7C1E5A930DB2F846)
#: How hard texts are compressed.
LEVEL = 9

BLOCK = "block long, ids array<long>, lengths binary, texts binary, size long, n_chars long"


@textkernel.tidied
def _blocks(batches):
    """The texts in blocks, as UTF-8 and compressed."""
    block = TaskContext.get().partitionId() << 40
    for batch in batches:
        for a, b, cps, bounds in textkernel.chunks(batch.column("text"), max_chars=BLOCK_CHARS):
            raw = textkernel.to_text(cps).encode()
            ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column("doc_id").slice(a, b - a))
            lengths, texts = np.diff(bounds).astype(np.int64).tobytes(), pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)
            columns = {"block": [block], "ids": ids, "lengths": [lengths], "texts": [texts], "size": [len(raw)], "n_chars": [len(cps)]}
            yield pa.RecordBatch.from_pydict(columns)
            block += 1


def _words_of(lengths: bytes, texts: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, rows' bounds)."""
    bounds = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int64))])
    cps = textkernel.code_points(pa.decompress(texts, size, "zstd", asbytes=True).decode())
    word, _, _, rb = textkernel.word_hashes(cps, bounds)
    return word, rb


def _ngrams(lengths: bytes, texts: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]:
    """(distinct hashes, the index of each word's, of what stands before it and of each bigram, that of the start, row of every word, rows' bounds)."""
    word, rb = _words_of(lengths, texts, size)
    n, first = len(word), rb[:-1][rb[:-1] < rb[1:]]
    before = np.concatenate([[START], word])[:n]
    before[first] = START
    pair = textkernel.mix(before * np.uint64(0x9E3779B97F4A7C15) + word)
    keys, index = np.unique(np.concatenate([textkernel.mix(np.append(word, START) ^ WORD), pair]), return_inverse=True)
    at = np.concatenate([[0], index[:n]])[:n]
    at[first] = index[n]
    return keys, index[:n], at, index[n + 1 :], int(index[n]), np.repeat(np.arange(len(rb) - 1), np.diff(rb)), rb


def _packed(values: np.ndarray) -> bytes:
    """The width of the numbers, then their bytes by place (all first bytes, all second bytes and so on), compressed."""
    high = int(values.max(initial=0))
    kind = np.dtype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if high <= np.iinfo(t).max))
    places = values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T
    return bytes([kind.itemsize]) + pa.compress(places.tobytes(), "zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(pa.decompress(memoryview(blob)[1:], n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(f"u{width}").reshape(n)


#: Hashes go as steps from one to the next. A word is a context as often
#: as it stands anywhere, less how often it ends a text; the start counts as a word that ends none.
COUNTS = ("background", "target", "background_ends", "target_ends")
SENT = "bucket long, block long, n long, keys binary, " + ", ".join(f"{c} binary" for c in COUNTS)


def _good(r: dict) -> np.ndarray:
    """Which texts of a block are good."""
    # Of no bytes at all, unpackbits returns memory as it finds it.
    return np.unpackbits(np.frombuffer(r["good"] or b"\0", np.uint8), count=len(r["ids"])).astype(bool)


WORDS = "id long, n_background long, n_target long"


def _added(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, equal ones added up."""
    if held:
        ids, background, target = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, index = np.unique(ids, return_inverse=True)
        # Weights are doubles, exact up to 2**53.
        sums = [np.bincount(index, weights=n, minlength=len(ids)).astype(np.int64) for n in (background, target)]
        for i in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_pydict({"id": ids[i : i + 100_000].view(np.int64)} | {c: n[i : i + 100_000] for c, n in zip(("n_background", "n_target"), sums, strict=True)})


@textkernel.tidied
def _words(batches):
    """The distinct words of a task's blocks, with their counts in both models."""
    held, size = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            word, rb = _words_of(r["lengths"], r["texts"], r["size"])
            ids, index = np.unique(word, return_inverse=True)
            good = np.repeat(_good(r), np.diff(rb))
            held.append((ids, np.bincount(index, minlength=len(ids)), np.bincount(index[good], minlength=len(ids))))
            size += len(ids)
            if size > 1_000_000:
                yield from _added(held)
                held, size = [], 0
    yield from _added(held)


def _send(buckets: int):
    """A row for each block and bucket that it has hashes of."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys, word, _, pair, start, row, rb = _ngrams(r["lengths"], r["texts"], r["size"])
                good = _good(r)
                counts = []
                for rows in (np.ones(len(good), bool), good):
                    rows = rows & (rb[:-1] < rb[1:])
                    own = rows[row]
                    counts.append(np.bincount(np.concatenate([word[own], pair[own], np.full(rows.sum(), start)]), minlength=len(keys)))
                    counts.append(np.bincount(word[rb[1:][rows] - 1], minlength=len(keys)))
                counts = dict(zip(COUNTS, counts[::2] + counts[1::2], strict=True))
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                some, cut = np.unique(bucket, return_index=True)
                ends = [*cut[1:].tolist(), len(keys)]
                for k in range(0, len(some), 1000):
                    spans = list(zip(cut[k : k + 1000].tolist(), ends[k : k + 1000], strict=True))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": some[k : k + 1000], "block": np.full(len(spans), r["block"]), "n": [y - x for x, y in spans], "keys": [_packed(np.diff(keys[x:y], prepend=np.uint64(0))) for x, y in spans],
                        }
                        | {name: [_packed(c[x:y]) for x, y in spans] for name, c in counts.items()}
                    )

    return run


SUMS = "block long, bucket long, n long, " + ", ".join(f"{c} binary" for c in COUNTS)


def _add(table: pa.Table) -> pa.Table:
    """Sums of one bucket over all blocks, for each block in the order of its hashes."""
    n = table.column("n").to_numpy()
    keys = np.concatenate([np.cumsum(_unpacked(x, k), dtype=np.uint64) for x, k in zip(table.column("keys").to_pylist(), n.tolist(), strict=True)])
    distinct, index = np.unique(keys, return_inverse=True)
    out = {}
    cut = np.concatenate([[0], np.cumsum(n)]).tolist()
    for name in COUNTS:
        counts = np.concatenate([_unpacked(x, k) for x, k in zip(table.column(name).to_pylist(), n.tolist(), strict=True)])
        # Weights are doubles, exact up to 2**53.
        total = np.bincount(index, weights=counts, minlength=len(distinct)).astype(np.int64)
        each = total[index]
        out[name] = [_packed(each[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": table.column("n")} | out)


SCORE = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _score(vocabulary: int, n_words: dict[str, int]):
    def run(texts: pa.Table, sums: pa.Table) -> pa.Table:
        r = texts.to_pylist()[0]
        keys, word, before, pair, _, row, rb = _ngrams(r["lengths"], r["texts"], r["size"])
        sums = sums.sort_by("bucket")
        size = sums.column("n").to_pylist()
        rows, count = len(rb) - 1, np.diff(rb)
        losses = []
        for name in ("target", "background"):
            counts, ends = (np.concatenate([_unpacked(x, k) for x, k in zip(sums.column(c).to_pylist(), size, strict=True)]).astype(np.int64) for c in (name, f"{name}_ends"))
            assert len(counts) == len(keys)
            words, contexts, pairs = counts[word], (counts - ends)[before], counts[pair]
            unigram = SHARES[1] * words / max(n_words[name], 1) + (1 - sum(SHARES)) / max(vocabulary, 1)
            loss = -np.log(SHARES[0] * pairs / np.maximum(contexts, 1) + unigram)
            losses.append(np.bincount(row, weights=loss, minlength=rows) / np.maximum(count, 1))
        t, g = losses
        none = count == 0
        return pa.table({"doc_id": pa.array(r["ids"], pa.int64()), "n_tokens": count.astype(np.int64), "target_loss": pa.array(t, mask=none), "background_loss": pa.array(g, mask=none), "score": pa.array(t - g, mask=none)})

    return run


def _bits(batches):
    for batch in batches:
        out = []
        for at in batch.column("at").to_pylist():
            bits = np.zeros(max(at) + 1, bool)
            bits[at] = True
            out.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "good": pa.array(out, pa.binary())})


def score_documents(documents: DataFrame, labels: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score per document row.

    A document is good if any of its labels has quality 1 and none is toxic. Null or
    empty texts and those of white space have no words: their losses and score are null.
    A null doc_id has no label. Repeated rows each count and keep a row. Without good
    documents the target model is uniform. Other columns are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.coalesce("quality", F.lit(0))) == 1).alias("q"), (F.max(F.coalesce("toxic", F.lit(0))) == 1).alias("t"))
    good = good.filter("q and not t and doc_id is not null").select("doc_id")
    blocks = settle(docs.mapInArrow(_blocks, BLOCK), "blocks")
    n_chars, n_docs = blocks.agg(F.sum("n_chars"), F.sum(F.size("ids"))).first()
    buckets = max(1, -(-(n_chars or 0) // bucket_chars))
    # A merge join at any size: what is shuffled then grows as the documents do.
    at = blocks.select("block", F.posexplode("ids").alias("at", "doc_id")).join(good.hint("merge"), "doc_id")
    flags = settle(at.groupBy("block").agg(F.collect_list("at").alias("at")).mapInArrow(_bits, "block long, good binary"), "flags")
    flagged = blocks.select("block", "ids", "lengths", "texts", "size").join(flags.hint("broadcast" if (n_docs or 0) <= LABELS_BROADCAST else "merge"), "block", "left")
    words = flagged.mapInArrow(_words, WORDS).groupBy("id").agg(F.sum("n_background").alias("n_background"), F.sum("n_target").alias("n_target"))
    vocabulary, n_background, n_target = words.agg(F.count("*"), F.coalesce(F.sum("n_background"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0))).first()
    sums = flagged.mapInArrow(_send(buckets), SENT).groupBy("bucket").applyInArrow(_add, SUMS)
    texts = blocks.select("block", "ids", "lengths", "texts", "size")
    return texts.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_score(vocabulary, {"background": n_background, "target": n_target}), SCORE)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score_documents`` of all of ``documents`` with all of ``labels``; odd rows as stated there."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
