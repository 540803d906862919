"""Every registered query against its SQL on the small driver tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registered
from settlespark.catalog import load

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for file in sorted(os.listdir(small)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{file}'")
    yield con
    con.close()


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, str):
        return value
    if type(value).__name__ in ("bool", "bool_"):
        return bool(value)
    number = float(value)
    return None if math.isnan(number) else number


def rows(table, columns):
    values = [tuple(map(plain, r)) for r in table[columns].itertuples(index=False)]
    return sorted(values, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    assert len(got)
    if name not in SQL:
        return
    want = duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark, small):
    assert registered.entry(spark).count() > 0
    assert set(registered.oracle_sql()) <= set(registered.queries())
