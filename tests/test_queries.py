"""Every query on the smallest tables against its DuckDB twin."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__

SMALLEST = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALLEST}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 4) + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SMALLEST)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    made = duck.execute(ORACLES[name])
    have = [d[0] for d in made.description]
    assert sorted(have) == names
    want = sorted((tuple(plain(dict(zip(have, r, strict=True))[c]) for c in names) for r in made.fetchall()), key=repr)
    assert got == want


def test_flagship_query(spark):
    assert __spark_entry__.entry(spark).count() > 0
