"""The driver's contract, and every query with its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from domframe import queries

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["page_id", "href"]


def canon(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_equal_their_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = df.select(*names).collect()
    if name not in queries.ORACLES:
        assert got
        return
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cur = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})")
    assert canon(got) == canon(cur.fetchall())


def test_names_are_unique_and_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
