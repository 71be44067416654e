"""Every registered query against its oracle on the smallest tables (PLEDGEWORK_SF names others)."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

from pledgework.plans import catalog
from pledgework.sources.adapter import BASE

SF = os.environ.get("PLEDGEWORK_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = duck.sql(catalog.oracles()[name])
    cols = sorted(df.columns)
    assert cols == sorted(got.columns)
    at = [got.columns.index(c) for c in cols]
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
    assert ours == theirs


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracles())
