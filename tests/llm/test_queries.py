"""The registered queries of the operators over whole small tables; those with SQL against it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
OPERATORS = [f"op{n}_" for n in range(1, 11)]


def test_each_operator_has_one_query():
    names = entry.queries()
    assert all(sum(q.startswith(o) for q in names) == 1 for o in OPERATORS) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op4_mix_sources", "op8_exact_dedup"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    cur = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    got = entry.queries()[name](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(map(str, r)) for r in cur.fetchall()) == sorted(tuple(map(str, r)) for r in got.select(names).collect())


@pytest.mark.parametrize("start, rows", [("op2_", "documents"), ("op7_", "documents"), ("op9_", "documents"), ("op3_", "documents"), ("op10_", "pages")])
def test_every_row_has_a_result(spark, start, rows):
    name = next(q for q in entry.queries() if q.startswith(start))
    assert entry.queries()[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{rows}.parquet").count()
