"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from conftest import TINY
from curata import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, TINY)
    names = sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    if name not in plans.ORACLE_SQL:
        return
    result = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(result.columns) == names
    at = [result.columns.index(c) for c in names]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
