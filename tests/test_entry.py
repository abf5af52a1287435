import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not there")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    tidy = lambda v: round(float(v), 5) if isinstance(v, float) or hasattr(v, "as_tuple") else v
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(tidy(r[c]) for c in sorted(names)) for r in df.collect()), key=key)
    b = sorted((tuple(tidy(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=key)
    assert a == b
