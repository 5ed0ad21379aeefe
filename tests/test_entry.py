import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", ["tfidf", "keyword_top_n", "product_top_keywords", "agent_sft"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{SMALL}/{table}'")
    got = entry.queries()[name](spark, SMALL)
    expected = con.execute(entry.oracle_sql()[name])
    order = sorted(got.columns)
    names = [d[0] for d in expected.description]
    plain = lambda r: tuple(str(x) for x in r)
    assert sorted(plain(r[c] for c in order) for r in got.collect()) == sorted(plain(r[names.index(c)] for c in order) for r in expected.fetchall())
