"""Every registered query against its DuckDB oracle on the smallest scale (sf0.001)."""

import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tripwire.plans.queries import REGISTRY
from tripwire.sources.tables import INPUT_TABLES

NAMES = sorted(set(E.oracle_sql()) & set(REGISTRY))  # the text operators have tests of their own


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return ("n", decimal.Decimal(v).normalize())
    if isinstance(v, float):
        return ("f", repr(v))
    if isinstance(v, dt.datetime):
        return ("t", v.isoformat())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return ("s", str(v))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in INPUT_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
