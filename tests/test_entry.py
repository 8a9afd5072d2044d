"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from auditarium.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    return repr(round(x, 9) + 0.0) if isinstance(x, float) else x.isoformat() if hasattr(x, "isoformat") else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, oracle, name):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    relation = oracle.sql(catalogue.ORACLES[name])
    names = list(relation.columns)
    assert columns == sorted(names)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
