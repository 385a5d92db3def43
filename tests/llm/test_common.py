import pytest

from siftwell.llm import common


def test_a_worker_keeps_one_large_object():
    made = []

    def make(x):
        made.append(x)
        return [x]

    common.release()
    a = common.kept("a", lambda: make("a"))
    assert common.kept("a", lambda: make("again")) is a and made == ["a"]
    common.kept("b", lambda: make("b"))
    assert list(common._kept) == ["b"]
    common.release()
    assert not common._kept


def test_fresh_names(spark):
    df = spark.createDataFrame([], "Tokens int, `_tokens` int, `a.b` int")
    assert common.fresh(df, "tokens", "rate", "rate") == ["__tokens", "rate", "_rate"]
    assert common.picked(df, x="a.b").columns == ["x"]


def test_shared_folder(spark):
    df = common.written(spark.range(5), "test")
    assert df.count() == 5 and spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]
    assert common.n_buckets(df) >= int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("limit, hinted", [(10, False), (1000, True)])
def test_broadcast_only_below_the_limit(spark, limit, hinted):
    df = common.broadcast_if(spark.range(5), 100, limit)
    assert ("broadcast" in df._jdf.queryExecution().logical().toString().lower()) is hinted
