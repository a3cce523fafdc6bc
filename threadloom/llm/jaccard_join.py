"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and their groups.

Rare-first prefix filtering: a document's shingles are put in one global order,
rarest first (by counts of the whole corpus in a fixed number of hash bins, then
by hash), and two sets that overlap enough must share a shingle among the first
few. Candidates meet on those prefix shingles; the length, positional and suffix
filters drop what cannot reach the threshold; each remaining pair is verified once
on its whole sets.

Groups of copies do not turn into all their pairs. Equal sets are one node from
the start. In a bucket, all sets are first compared with the few that share the
largest part of their own prefixes (the text that others are copies of shares all of
it). Only in buckets that hold sets of several components after that are all pairs
across components compared. A pair that shares a
prefix shingle thus either is verified or lies in one component already, so no
link between components is missed.

The suffix filter bounds an overlap by parts: hashes are parted into ``PARTS`` ranges, and
in none of them can two sets share more than the smaller one has there.

Shingles are 56-bit hashes; two different shingles of one pair of 500-word texts
share one with a probability of about 1e-11. Equal sets are told by a 64-bit id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from threadloom.llm import textkernel
from threadloom.llm.tables import PART, added_up, sliced
from threadloom.operators.components import components
from threadloom.session import settle

WORDS = 5
#: A link needs MORE * intersection >= LESS * union (fixed values: 0.75).
MORE, LESS = 100, 75
ROWS = 256
HASH_BITS = 56
BINS = 1 << 20
PARTS = 8
#: Members of a centre that one task verifies; more of them go to more tasks.
PER_TASK = 2000
#: Sets of a bucket that all others of it are compared with first.
CENTRES = 3
#: Rows of a bucket that are compared in one group.
BLOCK = 20_000
#: Bits of the filter that says which sets verification needs; a fuller filter lets more sets through, none get lost.
FILTER_BITS = 1 << 27


def shingle_sets(texts: pa.Array, words: int = WORDS):
    """Per chunk: (first row, rows, distinct shingle hashes, bounds of each row's hashes), hashes sorted in each row."""
    for a, b, cps, bounds in textkernel.chunks(texts, ROWS):
        h, _, _, rb = textkernel.word_hashes(cps, bounds)
        n = b - a
        grams = textkernel.gram_hashes(h, words)
        row, pos = textkernel.positions_in_rows(rb, words)
        got = grams[pos]
        counts = np.diff(rb)
        short = np.flatnonzero((counts > 0) & (counts < words))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for k in range(1, words):
                at = np.flatnonzero(counts[short] == k)
                if len(at):
                    first = rb[short[at]]
                    total = np.full(len(at), k, np.uint64)
                    for j in range(k):
                        total = textkernel.mix(total * np.uint64(0x9FB21C651E98DF25) + h[first + j])
                    extra[at] = total
            row, got = np.append(row, short), np.append(got, extra)
        key = (row.astype(np.uint64) << np.uint64(HASH_BITS)) | (got >> np.uint64(64 - HASH_BITS))
        key = textkernel.sorted_unique(key)
        row = (key >> np.uint64(HASH_BITS)).astype(np.int64)
        yield a, n, key & np.uint64((1 << HASH_BITS) - 1), np.searchsorted(row, np.arange(n + 1))


def _sum_by_row(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[cut[1:]] - total[cut[:-1]]


def set_ids(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's set (0 for the empty set)."""
    ids = textkernel.mix(_sum_by_row(textkernel.mix(h + np.uint64(0x1D8E4E27C47D124F)), cut))
    return np.where(cut[1:] > cut[:-1], ids, np.uint64(0))


CARD = f"doc_id long, n int, s long, pair long, p0 long, p1 long, {PART}"


def pairs_of(ids: pa.Array, sets: np.ndarray) -> np.ndarray:
    """An id of each row's doc_id and set together."""
    known = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return textkernel.mix(textkernel.mix(known + np.uint64(0x3C6EF372FE94F82B)) ^ sets).view(np.int64)


def _cards(words: int):
    """A card per document, and at the end of a task its counts of shingles by bin."""

    def batch_of(**columns) -> pa.RecordBatch:
        types = {"doc_id": pa.int64(), "n": pa.int32(), "s": pa.int64(), "pair": pa.int64(), "p0": pa.int64(), "p1": pa.int64(), "grp": pa.int32(), "slice": pa.int32(), "counts": pa.binary(), "width": pa.int32()}
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_pydict({k: pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in types.items()})

    @textkernel.tidied
    def run(batches):
        bins = np.zeros(BINS, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            for a, n, h, cut in shingle_sets(batch.column("text"), words):
                bins += np.bincount((h & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
                row = np.repeat(np.arange(n), np.diff(cut))
                parts = np.bincount(row * PARTS + (h >> np.uint64(HASH_BITS - 3)).astype(np.int64), minlength=n * PARTS)
                packed = np.minimum(parts, 0xFFFF).astype(np.uint16).reshape(n, PARTS).view(np.int64)
                own, sets = ids.slice(a, n), set_ids(h, cut)
                yield batch_of(doc_id=own, n=np.diff(cut).astype(np.int32), s=sets.view(np.int64), pair=pairs_of(own, sets), p0=packed[:, 0].copy(), p1=packed[:, 1].copy())
        if bins.any():
            for part in sliced(bins):
                yield batch_of(**{c: part.column(c) for c in part.schema.names})

    return run


def rarity(cards: DataFrame) -> np.ndarray:
    """For each hash bin a level from 0 (rare) to 255, from counts over all documents."""
    bins = added_up(cards.filter("slice is not null"), BINS)
    return np.minimum(8 * np.log2(bins + 1), 255).astype(np.uint8)


def _prefixes(levels, words: int):
    """The first shingles, rarest first, of each distinct set that a task meets."""

    @textkernel.tidied
    def run(batches):
        level = levels.value
        seen: set[int] = set()
        for batch in batches:
            for _, n, h, cut in shingle_sets(batch.column("text"), words):
                size = np.diff(cut)
                sets = set_ids(h, cut)
                fresh = np.zeros(n, bool)
                for r, s in enumerate(sets.tolist()):
                    if s and s not in seen:
                        seen.add(s)
                        fresh[r] = True
                row = np.repeat(np.arange(n), size)
                keep = fresh[row]
                h, row = h[keep], row[keep]
                if not len(h):
                    continue
                rank = level[(h & np.uint64(BINS - 1)).astype(np.int64)].astype(np.uint64)
                order = np.argsort((row.astype(np.uint64) << np.uint64(HASH_BITS)) | (rank << np.uint64(48)) | (h >> np.uint64(HASH_BITS - 48)), kind="stable")
                h, row = h[order], row[order]
                first = np.searchsorted(row, np.arange(n))
                pos = np.arange(len(h)) - first[row]
                length = size - -(-LESS * size // MORE) + 1
                keep = pos < length[row]
                h, row, pos = h[keep], row[keep], pos[keep]
                out = pa.RecordBatch.from_pydict({"h": pa.array((h >> np.uint64(8)).view(np.int64)), "s": pa.array(sets.view(np.int64)[row]), "n": pa.array(size[row].astype(np.int32)), "pos": pa.array(pos.astype(np.int32))})
                for i in range(0, len(h), 200_000):
                    yield out.slice(i, 200_000)

    return run


def least_overlap(a, b):
    """The smallest intersection that links sets of a and b shingles."""
    return -(-LESS * (a + b) // (MORE + LESS))


def _shared(batches):
    """Rows come by shingle and set: those of shingles that several sets have, each set once.

    Only one row is kept from batch to batch.
    """
    held, given = None, False
    for batch in batches:
        rows = [batch.column(k).to_numpy() for k in ("h", "s", "n", "pos")]
        if held is not None:
            rows = [np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(held, rows, strict=True)]
        h, s = rows[:2]
        if not len(h):
            continue
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        rows = [x[fresh] for x in rows]
        h = rows[0]
        same = h[1:] == h[:-1]
        keep = np.append(False, same) | np.append(same, False)
        if given:
            keep[0] = False
        last = bool(keep[-1]) or (given and len(h) == 1)
        held, given = [x[-1] for x in rows], last
        if keep.any():
            yield pa.RecordBatch.from_pydict({k: pa.array(x[keep]) for k, x in zip(("h", "s", "n", "pos"), rows, strict=True)})


def can_link(x: dict[str, np.ndarray], a, b) -> np.ndarray:
    """Whether rows a and b of one bucket pass the length, positional and suffix filters.

    The positional bound takes the bucket's shingle as the first that both share; a
    pair that shares an earlier one is judged by that one's bucket as well, so a pair
    that can link passes in at least one.
    """
    na, nb = x["n"][a].astype(np.int64), x["n"][b].astype(np.int64)
    pa_, pb = x["pos"][a], x["pos"][b]
    need = least_overlap(na, nb)
    ok = np.minimum(na - pa_, nb - pb) >= need
    most = np.minimum(x["parts"][a], x["parts"][b]).sum(-1, dtype=np.int64)
    return ok & (LESS * np.maximum(na, nb) <= MORE * np.minimum(na, nb)) & ((most >= need) | (np.maximum(na, nb) > 0xFFFF))


def _groups(batches):
    """(columns, bounds of the groups) of runs of whole groups, in the order their rows come.

    The rows of the last group are held until the next one begins.
    """
    held: dict[str, np.ndarray] | None = None

    def ready(x, bounds):
        x = dict(x)
        x["parts"] = np.stack([x.pop("p0"), x.pop("p1")], 1).view(np.uint16).reshape(-1, PARTS)
        return x, bounds

    for batch in batches:
        x = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        if held is not None:
            x = {c: np.concatenate([held[c], v]) for c, v in x.items()}
        starts = np.flatnonzero(x["g"][1:] != x["g"][:-1]) + 1
        if len(starts):
            cut = starts[-1]
            yield ready({c: v[:cut] for c, v in x.items()}, np.concatenate([[0], starts]))
            x = {c: v[cut:] for c, v in x.items()}
        held = x
    if held is not None and len(held["g"]):
        yield ready(held, np.array([0, len(held["g"])]))


def _pairs(c: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"c": pa.array(np.minimum(c, s)), "s": pa.array(np.maximum(c, s))})


def _stars(batches):
    """Rows come by group, the sets that share most first: each row with up to CENTRES of them."""
    for x, bounds in _groups(batches):
        start = np.repeat(bounds[:-1], np.diff(bounds))
        place = np.arange(len(start)) - start
        for k in range(CENTRES):
            row = np.flatnonzero(place > k)
            centre = start[row] + k
            ok = can_link(x, centre, row)
            if ok.any():
                yield _pairs(x["s"][centre[ok]], x["s"][row[ok]])


def _crossing(batches):
    """All pairs of different components in a group that the filters let through.

    Every pair of a group of at most CENTRES + 1 sets has been a candidate already.
    """
    for x, bounds in _groups(batches):
        s, n, root = x["s"], x["n"].astype(np.int64), x["root"]
        mixed = np.minimum.reduceat(root, bounds[:-1]) != np.maximum.reduceat(root, bounds[:-1])
        for g in np.flatnonzero(mixed & (np.diff(bounds) > CENTRES + 1)).tolist():
            first, end = int(bounds[g]), int(bounds[g + 1])
            for i in range(first, end, 64):
                lo = first + int(np.searchsorted(n[first:end] * MORE, LESS * n[i], side="left"))
                a, b = np.arange(i, min(i + 64, end)), np.arange(lo, min(i + 64, end))
                p, q = np.nonzero((root[a, None] != root[None, b]) & (a[:, None] > b[None, :]))
                p, q = a[p], b[q]
                ok = can_link(x, p, q)
                if ok.any():
                    yield _pairs(s[p[ok]], s[q[ok]])


class IdFilter:
    """Which 64-bit ids may be in a set: two bits each in a table of a fixed size."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = textkernel.mix(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        return (h & np.uint64(size - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)

    def has(self, ids: np.ndarray) -> np.ndarray:
        size = len(self.bits) * 8
        ok = np.ones(len(ids), bool)
        for p in self.places(ids, size):
            ok &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
        return ok


def _filter_bits(size: int):
    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for p in IdFilter.places(batch.column("id").to_numpy(), size):
                np.bitwise_or.at(bits, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
        width = min(len(bits), 1 << 20)
        for i in range(0, len(bits), width):
            part = bits[i : i + width]
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i // width], pa.int32()), "bits": pa.array([part.tobytes()], pa.binary())})

    return run


def _or_slices(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column("slice").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            bits = np.frombuffer(blob, np.uint8)
            total[k] = total[k] | bits if k in total else bits
    for k, v in total.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": pa.array([v.tobytes()], pa.binary())})


def id_filter(ids: DataFrame) -> IdFilter:
    """A filter of the ids in column ``id``: 16 bits each, FILTER_BITS (16 MB) at most."""
    count = ids.count()
    size = 1 << int(np.clip(np.ceil(np.log2(16 * max(count, 1))), 10, np.log2(FILTER_BITS)))
    bits = np.zeros(size // 8, np.uint8)
    width = min(len(bits), 1 << 20)
    parts = ids.coalesce(16).mapInArrow(_filter_bits(size), "slice int, bits binary")
    for k, blob in parts.repartition(8, "slice").mapInArrow(_or_slices, "slice int, bits binary").collect():
        bits[k * width : (k + 1) * width] |= np.frombuffer(blob, np.uint8)
    return IdFilter(bits)


def _whole_sets(wanted, words: int):
    """The sets that verification needs, each once per task, at 7 bytes a shingle."""

    @textkernel.tidied
    def run(batches):
        keep = IdFilter(wanted.value)
        seen: set[int] = set()
        for batch in batches:
            for _, _, h, cut in shingle_sets(batch.column("text"), words):
                ids = set_ids(h, cut)
                rows = []
                for r in np.flatnonzero(keep.has(ids) & (ids != 0)).tolist():
                    if int(ids[r]) not in seen:
                        seen.add(int(ids[r]))
                        rows.append(r)
                blobs = [h[cut[r] : cut[r + 1]].view(np.uint8).reshape(-1, 8)[:, :7].tobytes() for r in rows]
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pydict({"s": pa.array(ids.view(np.int64)[rows[i : i + 500]], pa.int64()), "hashes": pa.array(blobs[i : i + 500], pa.binary())})

    return run


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :7] = raw
    return out.view(np.uint64).ravel()


def _verify(batches):
    """Rows come by (c, part), the centre's own set first: exact overlap of each member with it."""
    now, centre = None, None
    for batch in batches:
        got_c, got_s = [], []
        for c, s, lead, blob in zip(*(batch.column(k).to_pylist() for k in ("c", "s", "lead", "hashes")), strict=True):
            h = _unpack(blob)
            if lead:
                now, centre = c, h
            elif c == now:
                both = len(np.intersect1d(h, centre, assume_unique=True))
                if MORE * both >= LESS * (len(h) + len(centre) - both):
                    got_c.append(c)
                    got_s.append(s)
        yield pa.RecordBatch.from_pydict({"a": pa.array(got_c, pa.int64()), "b": pa.array(got_s, pa.int64())})


def verified(pairs: DataFrame, documents: DataFrame, words: int) -> DataFrame:
    """Those pairs (c, s) whose whole sets overlap enough, as (a, b)."""
    spark = pairs.sparkSession
    needed = pairs.select(F.col("c").alias("id")).union(pairs.select(F.col("s").alias("id"))).distinct()
    wanted = spark.sparkContext.broadcast(id_filter(needed).bits)
    sets = documents.select("text").mapInArrow(_whole_sets(wanted, words), "s long, hashes binary").dropDuplicates(["s"])
    tasks = pairs.groupBy("c").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("tasks"))
    members = pairs.join(tasks, "c").select("c", F.pmod(F.xxhash64("s"), "tasks").cast("int").alias("part"), "s", F.lit(False).alias("lead"))
    leads = tasks.select("c", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part"), F.col("c").alias("s"), F.lit(True).alias("lead"))
    rows = settle(members.unionByName(leads), "members").join(sets, "s").select("c", "part", "s", "lead", "hashes")
    rows = rows.repartition(F.col("c"), F.col("part")).sortWithinPartitions("c", "part", F.desc("lead"), "s")
    links = settle(rows.mapInArrow(_verify, "a long, b long"), "links")
    wanted.unpersist()
    return links


def classes(documents: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(cards, sets): a card per document row (doc_id, n, s, pair; s is the id of its set, 0 of
    the empty one), and the distinct sets with what links join them to (s, class)."""
    spark = documents.sparkSession
    found = settle(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cards(words), CARD), "cards")
    cards = found.filter("slice is null")
    levels = spark.sparkContext.broadcast(rarity(found))
    prefixes = documents.select("text").mapInArrow(_prefixes(levels, words), "h long, s long, n int, pos int")
    buckets = settle(prefixes.repartition("h").sortWithinPartitions("h", "s").mapInArrow(_shared, "h long, s long, n int, pos int"), "buckets")
    levels.unpersist()
    prefix = F.col("n") - F.ceil(F.col("n") * LESS / MORE) + 1
    shares = buckets.groupBy("s").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    shares = shares.select("s", (F.col("shared") / prefix).alias("share"))
    sets = settle(cards.filter("s <> 0").groupBy("s").agg(F.first("p0").alias("p0"), F.first("p1").alias("p1")).join(shares, "s"), "shares")
    rows = buckets.join(sets, "s")
    large = settle(buckets.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")).filter("k > 1"), "large")
    blocks = not large.isEmpty()

    groups = _blocks(rows, large) if blocks else rows.withColumnRenamed("h", "g")
    stars = groups.repartition("g").sortWithinPartitions("g", F.desc("share"), "s").select("g", "s", "n", "pos", "p0", "p1")
    pairs = settle(stars.mapInArrow(_stars, "c long, s long").distinct(), "pairs")
    links = verified(pairs, documents, words)
    roots = settle(components(links), "roots")

    rows = rows.join(roots.withColumnRenamed("id", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    groups = _blocks(rows, large) if blocks else rows.withColumnRenamed("h", "g")
    groups = groups.repartition("g").sortWithinPartitions("g", "n", "s").select("g", "s", "n", "pos", "p0", "p1", "root")
    crossing = groups.mapInArrow(_crossing, "c long, s long").distinct().join(pairs, ["c", "s"], "left_anti")
    crossing = settle(crossing, "crossing")
    links = links.union(verified(crossing, documents, words))
    roots = settle(components(links), "roots")
    known = cards.filter("s <> 0").groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("k"))
    known = known.join(roots.withColumnRenamed("id", "s"), "s", "left")
    return cards.select("doc_id", "n", "s", "pair"), settle(known.select("s", "doc_id", "k", F.coalesce("root", "s").alias("class")), "classes")


#: Keys that hold more than one in so many rows are joined apart: there are at most so many.
HOT = 10_000


def joined_hot(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of their ``key``'s row of ``table``, which says in ``k`` how many rows have the key.

    The keys with more than one in HOT rows, of which there are fewer than HOT, are
    broadcast, so that no task gathers the rows of a hot one.
    """
    hot = F.col("k") * HOT > total
    names = [c for c in table.columns if c not in (key, "k")]
    some = F.broadcast(table.filter(hot).select(key, F.struct(*names).alias("hot")))
    marked = rows.join(some, key, "left")
    cold = marked.filter("hot is null").drop("hot").join(table.filter(~hot).drop("k"), key, "left")
    return cold.unionByName(marked.filter("hot is not null").select(*rows.columns, "hot.*"))


def _least(known: DataFrame, total: int) -> DataFrame:
    """(s, least, first, k): of each set the smallest doc_id of its class, and the one set that is kept of it."""
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "s")
    least = known.groupBy("class").agg(F.min("doc_id").alias("least"), F.min(own)["s"].alias("first"), F.count("*").alias("k"))
    return joined_hot(known.withColumnRenamed("k", "copies").drop("doc_id"), least, "class", total).select("s", "least", "first", F.col("copies").alias("k"))


def jaccard_components(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id per document row.

    Words are runs without space, tab or line ends, A-Z folded; a document's set
    is its distinct ``words``-word shingles, or its whole sequence if it has fewer
    words. A null or empty text, or one of white space, has n_shingles 0 and links
    with nothing. component_id is the smallest doc_id reachable by links. A null
    doc_id takes part in no component and keeps a null component_id; rows that
    repeat a doc_id are one node each per text and share what links them through
    their texts only. Other columns are not read. No rows give no rows.
    """
    cards, known = classes(documents, words)
    total = cards.count()
    worded = joined_hot(cards.filter("s <> 0"), settle(_least(known, total), "least"), "s", total)
    rows = worded.select("doc_id", "n", "least").unionByName(cards.filter("s = 0").select("doc_id", "n", F.lit(None).cast("long").alias("least")))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def _tagged(wanted, words: int, maybe: bool):
    """The rows whose doc_id and set may be in the filter, with both, or the other rows as they are."""

    @textkernel.tidied
    def run(batches):
        keep = IdFilter(wanted.value)
        for batch in batches:
            texts = textkernel.texts_of(batch)
            for a, n, h, cut in shingle_sets(texts, words):
                part, sets = batch.slice(a, n), set_ids(h, cut)
                own = part.column("doc_id")
                hit = keep.has(pairs_of(own, sets)) & (sets != 0) & own.is_valid().to_numpy(zero_copy_only=False)
                at = pa.array(np.flatnonzero(hit == maybe))
                columns = {"row": part.column("row").take(at)}
                if maybe:
                    columns |= {"doc_id": own.take(at), "s": pa.array(sets.view(np.int64)).take(at), "words": texts.slice(a, n).take(at)}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def without_copies(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``documents`` (all columns) without near copies: one of each component stays.

    That is the row of the smallest doc_id and, of several rows of it, those of the set
    with the smallest id; of rows with the same doc_id and set the smallest text. Rows
    without words, or without a doc_id, are in no component and stay, each of them.
    Whether a row stays is judged by row, never by its doc_id alone.
    """
    spark = documents.sparkSession
    cards, known = classes(documents, words)
    total = cards.count()
    worded = joined_hot(cards.filter("s <> 0 and doc_id is not null"), settle(_least(known, total), "least"), "s", total)
    gone = settle(worded.filter("doc_id <> least or s <> first").select("pair", "doc_id", "s").distinct(), "gone")
    twice = worded.filter("doc_id = least and s = first").groupBy("pair").count().filter("count > 1").select("pair")
    wanted = spark.sparkContext.broadcast(id_filter(gone.select("pair").union(twice).withColumnRenamed("pair", "id")).bits)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    kinds = {f.name: f for f in rows.schema}
    sure = rows.mapInArrow(_tagged(wanted, words, False), StructType([kinds["row"]]))
    doubt = rows.mapInArrow(_tagged(wanted, words, True), StructType([kinds["row"], kinds["doc_id"], StructField("s", LongType()), StructField("words", documents.schema["text"].dataType)]))
    doubt = doubt.join(gone.select("doc_id", "s"), ["doc_id", "s"], "left_anti").groupBy("doc_id", "s").agg(F.min_by("row", "words").alias("row"))
    return sure.unionByName(doubt.select("row")).select("row.*")


def _blocks(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Adds ``g``: a bucket of at most BLOCK rows is one group; a larger one is dealt into
    blocks, and each pair of blocks is a group, so that no task holds a whole bucket."""
    rows = rows.join(large, "h", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("s"), "k").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    group = F.when(F.col("k") == 1, F.col("h")).otherwise(F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")))
    return rows.withColumn("g", group).drop("h", "k", "own", "other")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``jaccard_components`` of all of ``documents``; odd rows as stated there."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by comparing all pairs that share a shingle.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * k >= 75 * (na + nb - k)),
und AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS id, a AS r FROM und UNION SELECT reach.id, und.b FROM reach JOIN und ON reach.r = und.a),
comp AS (SELECT id, min(r) AS root FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id FROM sh LEFT JOIN comp ON id = doc_id
"""
