"""Every query that SQL can express, against DuckDB; the others by their properties."""

import duckdb
import pytest
from oracle import connect, difference

from threadloom.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    assert difference(df.collect(), df.columns, con, SQL[name]) == ""


def test_splits_lose_no_letters(spark, sf):
    pieces = QUERIES["sentence_split"](spark, sf).orderBy("doc_id", "pos").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    joined: dict[int, str] = {}
    for r in pieces:
        joined[r.doc_id] = joined.get(r.doc_id, "") + r.piece
    assert all("".join(joined[i].split()) == "".join(t.split()) for i, t in texts.items())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_votes_of_known_suppliers_without_a_sort(spark, tmp_path):
    lines = [(1, 5), (1, 3), (1, 3), (2, 9), (7, 1), (None, 2), (3, None)]
    spark.createDataFrame(lines, "l_suppkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (3,), (4,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES["message_vote"](spark, str(tmp_path))
    assert difference(df.collect(), df.columns, con, SQL["message_vote"]) == ""
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
