"""Ranking: exact vector search, BM25, reciprocal-rank fusion and the graph-aware retriever."""

from __future__ import annotations

from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from threadloom.functions.text import tokens
from threadloom.session import settle

#: Constants of BM25 and of rank fusion (fixed values).
K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60
SUMMARY_WEIGHT, EXACT_WEIGHT, VECTOR_WEIGHT = 0.4, 0.4, 0.2
#: Queries that are sent to all tasks at once in a vector search.
QUERY_BLOCK = 1024
#: Pairs of documents and queries, and shared tokens of them, that a task scores at a time.
PIECE = 1_000_000


def top(scored: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query, with their rank; the limit runs before the shuffle too."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(shared, k: int):
    """Of each batch the k nearest vectors of every query of the block: a matrix product tells which may be
    among them, and their distances are then summed exactly."""

    def run(batches):
        ids, q = shared.value
        length = (q * q).sum(1)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = _matrix(part.column("v"))
                size = (x * x).sum(1)
                near = length[:, None] + size[None, :] - 2 * (q @ x.T)
                limit = np.partition(near, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
                row, col = np.nonzero(near <= (limit + 1e-9 * (1 + length + size.max(initial=0)))[:, None])
                d = ((q[row] - x[col]) ** 2).sum(1)
                yield pa.RecordBatch.from_pydict({"query_id": ids.take(pa.array(row)), "vec_id": part.column("vec_id").take(pa.array(col)), "distance": pa.array(d)})

    return run


def vector_topk(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, distance, rank: the k nearest by squared Euclidean distance, ties to the smaller id.

    ``queries`` has (query_id, q), ``base`` (vec_id, v). Queries go to the tasks in blocks
    of at most ``QUERY_BLOCK`` and each batch of vectors keeps few rows per query before the
    shuffle. Vectors that are null, or of another width than the query's, take no part.
    """
    spark = base.sparkSession
    known = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("vec_id", base.schema["vec_id"].dataType), StructField("distance", DoubleType())])
    out, held = spark.createDataFrame([], known), []

    def search(rows):
        found = spark.createDataFrame([], known)
        for width in sorted({len(r.q) for r in rows}):
            own = [r for r in rows if len(r.q) == width]
            block = spark.sparkContext.broadcast((pa.array([r.query_id for r in own]), np.array([r.q for r in own], np.float64)))
            same = base.select("vec_id", "v").filter(F.size("v") == width).filter(F.forall("v", lambda x: x.isNotNull()))
            found = found.union(same.mapInArrow(_nearest(block, k), known))
        return found

    for r in queries.select("query_id", "q").filter("q is not null").toLocalIterator():
        held.append(r)
        if len(held) == QUERY_BLOCK:
            out, held = out.union(search(held)), []
    return top(out.union(search(held)) if held else out, k, "distance", "vec_id")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """token, df, n_docs, avg_length over (doc_id, text): what BM25 takes from the corpus.

    Each text is read once: a document's first distinct token carries its length.
    """
    t = docs.select(tokens("text").alias("t"))
    t = t.select(F.size("t").alias("size"), F.posexplode(F.array_distinct("t")).alias("pos", "token"))
    df = settle(t.groupBy("token").agg(F.count("*").alias("df"), F.sum(F.when(F.col("pos") == 0, F.col("size")).otherwise(0)).alias("length")), "vocabulary")
    total = docs.agg(F.count("*").alias("n_docs")).crossJoin(df.agg(F.sum("length").alias("length")))
    return df.select("token", "df").crossJoin(F.broadcast(total.select("n_docs", (F.col("length") / F.col("n_docs")).alias("avg_length"))))


def _rounded(x: np.ndarray, places: int = 6) -> np.ndarray:
    """As Spark rounds doubles: the shortest decimal that stands for each, halves away from zero."""
    unit = 10.0**places
    y = np.abs(x) * unit
    whole = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) <= 1e-6 + 1e-15 * y):
        whole[i] = float(Decimal(repr(float(abs(x[i])))).scaleb(places).to_integral_value(ROUND_HALF_UP))
    return np.copysign(whole / unit, x) + 0.0


def _scored(shared):
    """Scores the documents of a batch (doc_id, t: tokens) for all queries of the block: (documents, rows of
    them, queries, scores). A score is summed in the order of the block's tokens, whatever the batch."""
    ids, words, idf, begin, queries, times, mean = shared.value
    size = np.diff(begin)

    def pieces(n: int, entries: np.ndarray):
        """Ranges of documents that fill the sums of at most PIECE pairs and hold about PIECE tokens."""
        a = 0
        while a < n:
            b = min(n, a + max(1, PIECE // len(ids)), max(a + 1, int(np.searchsorted(entries, (entries[a - 1] if a else 0) + PIECE, "right"))))
            yield a, b
            a = b

    def of(doc, code, length):
        key, tf = np.unique(doc * len(words) + code, return_counts=True)
        d, c = key // len(words), key % len(words)
        row = np.repeat(np.arange(len(c)), size[c])
        at = begin[c][row] + np.arange(len(row)) - np.repeat(np.cumsum(size[c]) - size[c], size[c])
        tf = tf[row]
        part = times[at] * idf[c][row] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[d][row] / mean))
        pair = d[row] * len(ids) + queries[at]
        n = len(length) * len(ids)
        hit = np.flatnonzero(np.bincount(pair, minlength=n))
        return hit // len(ids), hit % len(ids), np.bincount(pair, part, minlength=n)[hit]

    def run(batches):
        for batch in batches:
            length = pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False)
            code = pc.index_in(batch.column("t").flatten(), value_set=words).to_numpy(zero_copy_only=False)
            known = ~np.isnan(code) if code.dtype.kind == "f" else np.ones(len(code), bool)
            doc, code = np.repeat(np.arange(len(length)), length)[known], code[known].astype(np.int64)
            entries = np.cumsum(np.bincount(doc, size[code], minlength=len(length)))
            for a, b in pieces(len(length), entries):
                own = slice(*np.searchsorted(doc, [a, b]))
                row, query, score = of(doc[own] - a, code[own], length[a:b])
                yield batch.column("doc_id"), row + a, query, score

    return run


def _all_scores(shared):
    def run(batches):
        for docs, row, query, score in _scored(shared)(batches):
            yield pa.RecordBatch.from_pydict({"query_id": shared.value[0].take(pa.array(query)), "doc_id": docs.take(pa.array(row)), "score": pa.array(score)})

    return run


def _best_scores(shared, k: int):
    """Of the documents of a task the k best of every query of the block, ties to the smaller id."""

    def run(batches):
        ids, held = shared.value[0], None
        bar = np.full(len(ids), -np.inf)
        for docs, row, query, score in _scored(shared)(batches):
            score = _rounded(score)
            may = score >= bar[query]
            new = pa.table({"query": pa.array(query[may]), "doc_id": docs.take(pa.array(row[may])), "score": pa.array(score[may])})
            if not len(new):
                continue
            held = pa.concat_tables([held, new]) if held else new
            held = held.take(pc.sort_indices(held, [("query", "ascending"), ("score", "descending"), ("doc_id", "ascending")])).combine_chunks()
            query = held.column("query").to_numpy()
            place = np.arange(len(query)) - np.searchsorted(query, query)
            last = place == k - 1
            bar[query[last]] = held.column("score").to_numpy()[last]
            held = held.filter(pa.array(place < k))
        if held:
            yield from held.select(["doc_id", "score"]).add_column(0, "query_id", ids.take(held.column("query"))).to_batches()

    return run


def _one_row_each(docs: DataFrame) -> DataFrame:
    """(doc_id, t): the tokens of each document, those of rows that share a doc_id together."""
    rows = docs.filter("doc_id is not null").select("doc_id", tokens("text").alias("t"))
    twice = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    if twice.isEmpty():
        return rows
    twice = settle(twice, "repeated")
    return rows.join(twice, "doc_id", "left_anti").unionByName(rows.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.flatten(F.collect_list("t")).alias("t")))


def _bm25(docs: DataFrame, queries: DataFrame, search) -> DataFrame:
    """query_id, doc_id, score from what ``search``, given a block of queries, finds in the tokens of documents."""
    spark, stats = docs.sparkSession, corpus_stats(docs)
    n, d = F.col("n_docs"), F.col("df")
    stats = stats.withColumn("raw", F.ln(n - d + 0.5) - F.ln(d + 0.5))
    mean = stats.agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    asked = queries.filter("query_id is not null").select("query_id", F.explode(tokens("text")).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    asked = asked.join(stats.crossJoin(F.broadcast(mean)).select("token", idf.alias("idf"), "avg_length"), "token")
    asked = asked.groupBy("query_id").agg(F.collect_list(F.struct("token", "times", "idf", "avg_length")).alias("x"))
    known = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("score", DoubleType())])
    rows, out, held, size = _one_row_each(docs), spark.createDataFrame([], known), [], 0

    def block(held) -> DataFrame:
        terms = sorted((x.token, x.idf, i, x.times) for i, r in enumerate(held) for x in r.x)
        words = {x[0]: x[1] for x in terms}
        begin = np.cumsum([0, *Counter(x[0] for x in terms).values()])
        ids = pa.array([r.query_id for r in held], to_arrow_type(known["query_id"].dataType))
        shared = (ids, pa.array([*words]), np.array([*words.values()], float), begin, np.array([x[2] for x in terms]), np.array([x[3] for x in terms], float), held[0].x[0].avg_length)
        return rows.mapInArrow(search(spark.sparkContext.broadcast(shared)), known)

    for r in asked.toLocalIterator():
        held.append(r)
        size += len(r.x)
        if len(held) == QUERY_BLOCK or size >= PIECE:
            out, held, size = out.union(block(held)), [], 0
    return out.union(block(held)) if held else out


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score of the documents that share a token with a query.

    Okapi BM25; negative idf becomes EPSILON times the mean idf of the vocabulary,
    and repeated query tokens count repeatedly. Queries go to the tasks in blocks of at most
    ``QUERY_BLOCK`` and each document is scored where it is read: neither postings nor scores are shuffled.
    """
    return _bm25(docs, queries, _all_scores).withColumn("score", F.round("score", 6))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: k documents for each query; those that share no token score 0.

    Each task keeps its k best of a query. Zero-score documents only fill up queries with fewer than k hits,
    smallest ids first; k of them and one for each hit suffice.
    """
    found = _bm25(docs, queries, lambda block: _best_scores(block, k))
    best = settle(top(found, k, F.desc("score"), "doc_id").drop("rank"), "hits")
    spare = docs.select("doc_id").filter("doc_id is not null").orderBy("doc_id").limit(2 * k + 1)
    lacking = queries.select("query_id").distinct().join(best.groupBy("query_id").count().filter(F.col("count") >= k), "query_id", "left_anti")
    zero = lacking.join(F.broadcast(spare), F.lit(True)).join(best, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top(best.unionByName(zero), k, F.desc("score"), "doc_id")


def rrf(vector: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank of two ranked lists (query_id, doc_id, rank), fused.

    A document that a vector list repeats keeps its last rank; ties go to the vector
    list's order, then to the lexical one's.
    """
    v = vector.groupBy("query_id", "doc_id").agg(F.max("rank").alias("rank")).select("query_id", "doc_id", "rank", F.col("rank").alias("vr"), F.lit(None).cast("int").alias("lr"))
    x = lexical.select("query_id", "doc_id", "rank", F.lit(None).cast("int").alias("vr"), F.col("rank").alias("lr"))
    both = v.unionByName(x).groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (RRF + F.col("rank"))), 9).alias("score"), F.min("vr").alias("vr"), F.min("lr").alias("lr"))
    return top(both, k, F.desc("score"), F.asc_nulls_last("vr"), "lr", "doc_id").drop("vr", "lr")


def graph_hybrid(summary_hits: DataFrame, entity_hits: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank from both routes of the graph-aware retriever.

    ``summary_hits`` has (query_id, rank, chunks): each chunk of the community ranked r
    gets SUMMARY_WEIGHT / (RRF + r). ``entity_hits`` has (query_id, keyword, name,
    chunks), the nearest entity of each keyword that is an entity's name: its chunks get
    EXACT_WEIGHT or, if the names differ beyond case, VECTOR_WEIGHT over RRF + 1.
    """
    a = summary_hits.select("query_id", F.explode("chunks").alias("chunk_id"), (SUMMARY_WEIGHT / (RRF + F.col("rank"))).alias("s"))
    weight = F.when(F.lower("keyword") == F.lower("name"), EXACT_WEIGHT).otherwise(VECTOR_WEIGHT)
    b = entity_hits.select("query_id", F.explode("chunks").alias("chunk_id"), (weight / (RRF + 1)).alias("s"))
    total = a.unionByName(b).groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 9).alias("score"))
    return top(total, k, F.desc("score"), "chunk_id")


def entity_probe(keywords: DataFrame, entities: DataFrame) -> DataFrame:
    """The rows of ``keywords`` (query_id, keyword) whose keyword is the very name of an entity."""
    return keywords.join(entities.select(F.col("name").alias("keyword")).distinct(), "keyword", "left_semi").select("query_id", "keyword")


def entity_hits(keywords: DataFrame, keyword_vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, keyword, name and chunks: the entity nearest to each keyword that is an entity's name.

    ``keyword_vectors`` has (keyword, q), ``entities`` (entity_id, name, v, chunks); ties go to
    the smaller entity_id. Each keyword is searched once, whatever number of queries asks for it.
    """
    asked = settle(entity_probe(keywords, entities), "asked")
    vectors = keyword_vectors.join(asked.select("keyword").distinct(), "keyword", "left_semi").select(F.col("keyword").alias("query_id"), "q")
    nearest = vector_topk(vectors, entities.select(F.col("entity_id").alias("vec_id"), "v"), 1).select(F.col("query_id").alias("keyword"), F.col("vec_id").alias("entity_id"))
    return asked.join(nearest, "keyword").join(entities.select("entity_id", "name", "chunks"), "entity_id").select("query_id", "keyword", "name", "chunks")


def graph_search(queries: DataFrame, keywords: DataFrame, keyword_vectors: DataFrame, summaries: DataFrame, entities: DataFrame, k: int, communities: int = 3) -> DataFrame:
    """query_id, chunk_id, score, rank: the graph-aware retriever with its searches.

    ``queries`` has (query_id, q), ``summaries`` (community, v, chunks); the rest as in
    ``entity_hits``. Chunks of the ``communities`` nearest summaries and of the nearest entities
    are scored by ``graph_hybrid``.
    """
    near = vector_topk(queries, summaries.select(F.col("community").alias("vec_id"), "v"), communities)
    hits = near.select("query_id", "rank", F.col("vec_id").alias("community")).join(summaries.select("community", "chunks"), "community")
    return graph_hybrid(hits, entity_hits(keywords, keyword_vectors, entities), k)


def search_results(hits: DataFrame) -> DataFrame:
    """kind, query_id, chunk_id, chunk_ids, text, score of hits of a knowledge base (query_id, page_content,
    chunk_id, source_chunk_ids as JSON, score): a chunk if it has a chunk_id, else a summary of chunks."""
    own = F.coalesce(F.col("chunk_id").cast("string") != "", F.lit(False))
    listed = F.coalesce(F.from_json("source_chunk_ids", "array<string>"), F.array().cast("array<string>"))
    return hits.select(F.when(own, "chunk").otherwise("summary").alias("kind"), "query_id", F.when(own, F.col("chunk_id").cast("string")).alias("chunk_id"), F.when(~own, listed).alias("chunk_ids"), F.col("page_content").alias("text"), "score")
