"""Every query that has SQL gives the rows that DuckDB finds; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.functions import text

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOUND, SQL = entry.queries(), entry.oracle_sql()
OWN = sorted(n for n in FOUND if not n.startswith("op") and n != "pipeline")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = FOUND[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert rows
    if name in SQL:
        found = duck.sql(SQL[name])
        assert sorted(found.columns) == names
        at = [found.columns.index(c) for c in names]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["url", "title", "path", "crawled_at", "citation", "tool", "text"]


def test_sql_is_of_queries():
    assert set(SQL) <= set(FOUND)


def test_rounding_is_as_in_sql(spark, duck):
    values = [130.2085, 161.43449999999999, 128.6975, 64.2075, 188.67849999999999, -0.0005, 8.5]
    want = [duck.sql(f"SELECT round({v!r}::DOUBLE, 3)").fetchall()[0][0] for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(text.rounded(df["v"], 3)).collect()] == want
