"""Every query that has SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from silt.plans import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(engine.ORACLE))
def test_against_sql(spark, duck, name):
    got = engine.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    have = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    result = duck.sql(engine.ORACLE[name])
    assert sorted(result.columns) == names
    at = [result.columns.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert have == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
