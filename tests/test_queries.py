import glob
import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
SLOW = {"pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.queries()) - SLOW))
def test_equals_its_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        # What SQL can't express is held against brute force in tests of its own.
        assert name.startswith("op") and rows
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert plain(rows) == plain(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["uniq_id", "tm"]
