"""The catalogue's queries against their SQL on the smallest test data, where it is there."""
import collections
import glob
import os

import pytest

import __spark_entry__ as entry
from lexiloom import catalog

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog.QUERIES[name](spark, FOLDER)
    cur = c.execute(catalog.ORACLES[name])
    columns = [x[0] for x in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = collections.Counter(plain(r) for r in cur.fetchall())
    got = collections.Counter(plain([r[x] for x in columns]) for r in df.collect())
    assert got == want


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
