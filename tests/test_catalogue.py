"""Every registered query with a DuckDB counterpart gives the same rows; the others give rows."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from caseloom.plans import catalogue

from .conftest import SMALL


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    have = rows(got.columns, got.collect())
    if name not in catalogue.ORACLES:
        assert have, "no rows"
        return
    want = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert have == rows(columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["month", "label", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
