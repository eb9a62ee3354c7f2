"""Every query with an oracle against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from treeline.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DIR}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(row):
    return tuple(None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    ours = QUERIES[name](spark, DIR)
    theirs = duck.sql(ORACLES[name])
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    a = sorted((plain(r) for r in ours.select(*[f"`{c}`" for c in order]).collect()), key=repr)
    b = sorted((plain(r) for r in theirs.select(*[f'"{c}"' for c in order]).fetchall()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-5 for p, q in zip(x, y, strict=True)), (x, y)
