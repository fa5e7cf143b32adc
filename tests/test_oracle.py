"""Every registered query of the engine against its SQL on another engine."""

import datetime
import os

import duckdb
import pytest

from dotloom.plans.catalogue import queries
from dotloom.plans.oracle import oracle_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if isinstance(v, (datetime.date, bytes)) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    rel = duck.sql(oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(rel.columns, rel.fetchall())


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())
