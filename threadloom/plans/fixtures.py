"""The engine's logical inputs, laid over the generated tables.

Orders stand for chunks and suppliers or parts for entities; conversations for
dialogues, benchmark passages for queries, nations and regions for communities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import dealt, tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the lines of all orders are dealt out to."""
    return tasks_for(spark, table(spark, sf_dir, "lineitem").count())


def extractions(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """chunk_id, pos, entities and relations: an order's suppliers in line order, every third in
    another spelling; each line is related to the next one of the order. With ``tasks``, orders are
    dealt out to so many, and ``part`` is added."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    s = line.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    name = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.upper("s_name"), F.lit(" "))).otherwise(F.col("s_name"))
    part = ["part"] if tasks else []
    if tasks:
        s = dealt(s.select("l_orderkey", "l_linenumber", "s_name", "l_returnflag"), "l_orderkey", tasks)
    rows = s.groupBy(*part, "l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), name.alias("name"), F.concat(F.lit("ships "), F.col("l_returnflag")).alias("d")))).alias("x"))
    pairs = F.zip_with(F.slice("x", 1, F.greatest(F.size("x") - 1, F.lit(0))), F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda a, b: F.struct(a["name"].alias("source"), b["name"].alias("target"), a["d"].alias("description")))
    return rows.select(*part, F.col("l_orderkey").cast("string").alias("chunk_id"), F.col("l_orderkey").alias("pos"), F.transform("x", lambda e: e["name"]).alias("entities"), pairs.alias("relations"))


#: Mentions of ``extractions`` as rows, for SQL.
MENTIONS_SQL = """
line AS (SELECT l_orderkey AS chunk, l_linenumber AS k, CASE WHEN l_linenumber % 3 = 0 THEN upper(s_name) || ' ' ELSE s_name END AS nm, 'ships ' || l_returnflag AS d
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
seqd AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY k, nm, d) - 1 AS epos FROM line),
m AS (SELECT chunk, epos, trim(nm) AS raw, 'entity::' || lower(trim(nm)) AS id, d FROM seqd),
u AS (SELECT chunk, raw, id, row_number() OVER (PARTITION BY chunk ORDER BY min(epos)) - 1 AS i FROM m GROUP BY chunk, raw, id),
ev AS (SELECT a.chunk, 0 AS phase, CAST(a.epos AS BIGINT) AS seq, a.id AS x, b.id AS y, 2 AS w, 'explicit' AS ty, a.d AS d FROM m a JOIN m b ON a.chunk = b.chunk AND b.epos = a.epos + 1
       UNION ALL SELECT a.chunk, 1, CAST(a.i AS BIGINT) * 1000000 + (b.i - a.i - 1), a.id, b.id, 1, 'co-occurrence', '' FROM u a JOIN u b ON a.chunk = b.chunk AND a.i < b.i),
e AS (SELECT least(x, y) AS src, greatest(x, y) AS dst, chunk, phase, seq, w, ty, d FROM ev WHERE x <> y)
"""

#: Parts that share at least two orders, and suppliers that share an order.
PARTS_SQL = """
op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
pe AS (SELECT a.p AS src, b.p AS dst, count(*) AS weight FROM op a JOIN op b ON a.o = b.o AND a.p < b.p GROUP BY ALL HAVING count(*) >= 2)
"""
SUPPLIERS_SQL = """
os AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS p FROM lineitem),
se AS (SELECT a.p AS src, b.p AS dst, count(*) AS weight FROM os a JOIN os b ON a.o = b.o AND a.p < b.p GROUP BY ALL),
mem AS (SELECT s_suppkey AS node, s_nationkey AS community FROM supplier)
"""
