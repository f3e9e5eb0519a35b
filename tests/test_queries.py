"""Every registered query with an oracle gives the oracle's rows on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda x: "null" if x is None else str(x.normalize() + 0) if isinstance(x, Decimal) else repr(round(x, 6)) if isinstance(x, float) else str(x)
    return sorted(tuple(text(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    df, want = entry.queries()[name](spark, SF), db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
