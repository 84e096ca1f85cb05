"""Every registered query runs on the smallest tables and equals its SQL."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return c


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    return ("nan" if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, small, name):
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    wanted = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == wanted


def test_entry(spark, small):
    assert entry.entry(spark).count() == 6
    assert set(SQL) <= set(entry.queries())
