"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from stratavox.plans.oracles import SQL
from stratavox.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def canonical(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.astype(object).where(pd.notna(df), None).itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    assert canonical(QUERIES[name](spark, sf).toPandas()) == canonical(duck.sql(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
