"""Driver contract: entry() runs, every query has an oracle, and on the
sf0.001 tables every query matches its DuckDB oracle."""
import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_mod
from kpiforge.plans.catalog import QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
NO_ORACLE = set()


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _canon(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "month" in df.columns


def test_every_query_has_oracle():
    missing = set(QUERIES) - set(entry_mod.oracle_sql()) - NO_ORACLE
    assert not missing


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, sf_small, name):
    sdf = entry_mod.queries()[name](spark, sf_small)
    scols = sdf.columns
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString()) for f in sdf.schema.fields}
    srows = [tuple(r) for r in sdf.collect()]
    sql = entry_mod.oracle_sql()[name]
    dtypes = dict(zip(duck.sql(sql).columns, (str(t) for t in duck.sql(sql).types)))
    rel = duck.execute(sql)
    dcols = [d[0] for d in rel.description]
    assert sorted(scols) == sorted(dcols)
    assert stypes == dtypes            # same column types, not only values
    assert _canon(scols, srows) == _canon(dcols, rel.fetchall())
