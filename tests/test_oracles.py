"""Every query with an oracle gives DuckDB's rows; the comparison is by value and whatever the order."""

import collections
import datetime
import math

import duckdb
import pytest

import __spark_entry__

NAMES = sorted(__spark_entry__.plans.ORACLES)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, sf, name):
    df = __spark_entry__.plans.QUERIES[name](spark, sf)
    rel = duck.sql(__spark_entry__.plans.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    want = collections.Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    assert want or name in ("beyond_range_join",)
