import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.llm import exact

SCHEMA = "doc_id long, text string, h string, Flag int, best int"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=300), st.integers(1, 50))
def test_second_filter_has_every_repeated_hash(values, block):
    h = np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words, _ = exact.second_filter(h, block)
    repeated = np.array([v for v in values if values.count(v) > 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert exact.Bloom(0, words).test(repeated).all()


def brute(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if r[1] is None or r[1] not in seen:
            out.append(r)
        seen.add(r[1])
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [exact.MAX_BROADCAST, 0])
def test_dedup(spark, most):
    texts = [f"text {i % 40}" for i in range(100)] + [None, None, "", "", "Text 1", "text 1 ", "long " * 300_000, "long " * 300_000]
    rows = [((i * 37) % 211 if i % 25 else None, t, "x", i, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exact.exact_dedup(df, max_broadcast=most)
    assert got.columns == df.columns
    found = [tuple(r) for r in got.collect()]
    assert sorted(map(str, (f[1] for f in found))) == sorted(str(b[1]) for b in brute(rows))
    first = {}
    for r in rows:
        if r[1] is not None and r[0] is not None:
            first[r[1]] = min(first.get(r[1], r[0]), r[0])
    assert all(f[0] == first[f[1]] for f in found if f[1] in first)


def test_same_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x", 1, 1)] * 3 + [(None, "b", None, None, None)] * 2, SCHEMA)
    assert exact.exact_dedup(df).count() == 2
    assert exact.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_repeated_rows_are_flagged(spark):
    df = spark.range(20_000).select(F.xxhash64(F.when(F.col("id") < 100, F.col("id") % 50).otherwise(F.col("id"))).alias("k"), "id")
    got = exact.possibly_repeated(df, "k", "again")
    assert got.where("id < 100 and not again").count() == 0
    assert got.where("again").count() < 200


def test_filters_beyond_the_broadcast_move_no_other_rows(spark):
    """With filters in parts, too, only possibly repeated rows take the way that shuffles."""
    df = spark.createDataFrame([(i, f"text {i}", "", 0, 0) for i in range(3000)] + [(5000 + i, f"text {i}", "", 0, 0) for i in range(300)], SCHEMA).repartition(6)
    h = df.withColumn("hash", F.xxhash64("text"))
    for most in (0, 64, 1 << 20):
        flagged = exact.possibly_repeated(h, "hash", "again", most)
        plan = flagged._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan
        got = flagged.select("doc_id", "again").collect()
        assert len(got) == 3300
        assert {r.doc_id for r in got if r.again} >= {*range(300), *range(5000, 5300)} and sum(r.again for r in got) < 800
