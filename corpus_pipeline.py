"""The corpus pipeline: five stages from raw documents to encoded ones.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
Extra columns of documents pass through. A null text survives no stage but the ones
that do not look at it; what each stage does with odd rows stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.bpe_codec import encode_documents
from threadloom.llm.decontaminate import without_leaks
from threadloom.llm.jaccard_join import without_copies
from threadloom.llm.language_id import UNKNOWN, predict, train
from threadloom.llm.pii import sanitise
from threadloom.session import settle

#: A document whose language is less certain than this is rejected.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows and is at least LEAST_SCORE sure of.

    Learned from the texts and languages of ``docs`` itself, held-out documents aside.
    Null and empty texts and texts without letters are rejected; so is everything if no
    row has a language. Repeated rows are judged alike; extra columns, whatever their
    names, pass through. An empty table gives no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.filter(~held).select("text", "lang", F.col("doc_id").cast("string").alias("key")))
    known = predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), model, ["row"])
    return known.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of the n-gram Jaccard join stays: that of the smallest doc_id.

    Rows are judged one by one, so of rows that share a doc_id but not their text each
    is judged by its own. Rows that repeat doc_id and text leave one. Rows without words
    (null, empty or white text), and those without a doc_id, are in no group and stay.
    An empty table gives no rows; extra columns pass through.
    """
    return without_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item leaks go.

    Null and empty texts hold no leak and stay; repeated rows go or stay together. An
    empty table, or an empty benchmark, changes nothing; extra columns pass through.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are masked, disclosing terms removed or generalised; n_chars follows the new text.

    Every row stays: null texts as null (with a null n_chars), empty ones as empty, repeated
    rows alike. An empty table gives no rows; extra columns pass through.
    """
    clean = sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row.

    Null and empty texts have no ids; a null doc_id stays null, and repeated rows each
    have a row. An empty table gives no rows; other columns are not read.
    """
    import public_tokenizers

    encoded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("bpe_encode", bpe_encode),
]

#: No stage but the second can be said in SQL (a trained model, a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
