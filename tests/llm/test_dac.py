import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.llm import arrays as A
from siftwell.llm import dac
from siftwell.llm.bpe import encoder

SCHEMA = "doc_id long, text string, Code string, n_tokens string, text_of string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=1500))
def test_round_trip(ids):
    r = dac.Reader(dac.encode(np.array(ids, np.int64)))
    assert len(r) == len(ids) and r.all().tolist() == ids
    for i in range(0, len(ids), max(1, len(ids) // 50)):
        assert r[i] == ids[i]


def test_long_code_by_position():
    ids = np.random.default_rng(0).integers(0, 50_000, 300_000) * (np.arange(300_000) % 3 > 0)
    r = dac.Reader(dac.encode(ids))
    assert all(r[i] == ids[i] for i in range(0, len(ids), 991)) and r[len(ids) - 1] == ids[-1]


def test_refusals():
    for bad in ([-1], [2**32]):
        with pytest.raises(ValueError):
            dac.encode(np.array(bad))
    with pytest.raises(ValueError):
        dac.Reader(b"something else here")
    with pytest.raises(IndexError):
        dac.Reader(dac.encode(np.array([5])))[1]


def test_documents(spark):
    texts = ["Hello world, it's", None, "", "ünï " * 9000, "a"]
    df = spark.createDataFrame([(i, t, "x", "y", None) for i, t in enumerate(texts)] + [(None, "a", "x", "y", None)], SCHEMA)
    out = dac.tokens_to_dac(df)
    assert out.columns == ["doc_id", "text", "text_of", "n_tokens", "code"]
    rows = {r.doc_id: r for r in out.collect()}
    want, off = encoder(None, "tiktoken").encode(A.as_strings(pa.array(texts)))
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i].code is None and rows[i].n_tokens is None
        else:
            assert dac.Reader(bytes(rows[i].code)).all().tolist() == want[off[i] : off[i + 1]].tolist()
    got = out.where("doc_id = 0").select(dac.token_at("code", F.lit(1)).alias("a"), dac.token_at("code", F.lit(99)).alias("b")).first()
    assert got.a == want[1] and got.b is None
    assert dac.tokens_to_dac(spark.createDataFrame([], SCHEMA)).collect() == []
