"""Every registered query of the search engine against its SQL, over whole tables."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from siftwell.plans import catalog

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    found = rows(got.columns, got.collect())
    if name in catalog.ORACLE_SQL:
        cur = duck.execute(catalog.ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(got.columns)
        want = rows(names, cur.fetchall())
        assert found == want, (list((found - want).items())[:3], list((want - found).items())[:3])
    assert found, "a query that finds nothing shows nothing"


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]
