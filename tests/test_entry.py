"""The driver's contract: the entry, and every query with SQL against DuckDB at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the tables aren't here")


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def plain(x):
    return ("nan" if math.isnan(x) else f"{x:.9g}") if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = contract.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    told = con.sql(contract.oracle_sql()[name])
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in told.fetchall())
