"""The driver's contract, and every registered query of the survey operators against its SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from aerolith.plans import files

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "supplier", "embeddings"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(files.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = files.queries()[name](spark, DATA)
    cursor = duck.execute(files.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in cursor.fetchall())
