"""Every query that has SQL gives the rows of its SQL; every other one runs."""

from __future__ import annotations

import glob
import os
from collections import Counter
from decimal import Decimal

import pytest

import __spark_entry__
from gleanwork.plans import queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, Decimal):
        return float(v)
    return 0.0 if isinstance(v, float) and v == 0 else v


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) < 2e-6 or a == b
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(close, a, b))
    return a == b


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, duck, data):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in queries.SQL:
        return
    r = duck.execute(queries.SQL[name])
    there = [d[0] for d in r.description]
    assert sorted(there) == columns
    want = [tuple(plain(x[there.index(c)]) for c in columns) for x in r.fetchall()]
    order = lambda x: tuple((v is not None, str(v) if not isinstance(v, float) else f"{v:.4f}") for v in x)
    if Counter(got) != Counter(want):
        assert len(got) == len(want)
        assert all(map(close, sorted(got, key=order), sorted(want, key=order)))


def test_entry(spark, data):
    assert "field" in __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
