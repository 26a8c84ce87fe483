"""Every query of the engine against its SQL on DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidefold import catalogue

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "None" if math.isnan(v) else repr(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return str(v)


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_plain(v) for v in row) for row in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, PATH).toPandas()
    want = duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)


def test_every_event_gets_a_replicate_verdict(spark):
    got = catalogue.QUERIES["topk_replicate"](spark, PATH)
    assert got.count() == got.where("replicate is not null").count() == spark.read.parquet(f"{PATH}/events.parquet").count()
