"""Each registered query with SQL must equal DuckDB's answer on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from quernal import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = Counter(repr(tuple(map(plain, r))) for r in got.select(*columns).collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert rows == Counter(repr(tuple(map(plain, r))) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
