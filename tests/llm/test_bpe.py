import base64

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import arrays as A
from siftwell.llm import bpe
from siftwell.llm.common import default_tokenizer

#: The published pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, text string, Token_IDs string, roundtrip string"


@pytest.fixture(scope="module")
def other():
    with open(default_tokenizer(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = st.text(st.one_of(st.sampled_from("aeinrst '’\n\t  .,!?0123"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_texts(other, texts):
    enc = bpe.encoder()
    ids, off = enc.encode(A.as_strings(pa.array(texts, pa.string())))
    for t, a, b in zip(texts, off[:-1], off[1:]):
        assert ids[a:b].tolist() == other.encode_ordinary(t)
    assert bpe.decode_all(enc, ids, off, chunk=2) == texts


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=24))
def test_any_bytes(piece):
    enc = bpe.encoder()
    assert enc.fst.encode(piece) == enc.merges.brute(piece)


def test_small_memory(other):
    enc = bpe.encoder()
    small = bpe.Transducer(enc.merges, max_states=20)
    for w in ["".join(chr(97 + (i * k) % 26) for i in range(k % 40)) for k in range(1, 200)]:
        assert small.encode(w.encode()) == other.encode_ordinary(w)


def test_long_piece_in_bounded_memory(other):
    """One unbroken piece may be as long as it will: states stay few, and what is emitted is the same."""
    small = bpe.Transducer(bpe.encoder().merges, max_states=500)
    r = np.random.default_rng(2)
    word = "".join(chr(97 + k) for k in r.integers(0, 26, 60_000))
    assert small.encode(word.encode()) == other.encode_ordinary(word)
    assert len(small.state) <= 501


def test_pieces_by_hash(monkeypatch):
    """Pieces with one hash are told apart by their bytes, and old ones make room."""
    enc = bpe.Encoder(by="tiktoken")
    r = np.random.default_rng(3)
    texts = [" ".join("".join(chr(97 + k) for k in r.integers(0, 26, r.integers(1, 9))) for _ in range(30)) for _ in range(20)] + ["the same text"] * 3
    col = A.as_strings(pa.array(texts))
    want = enc.encode(col)
    monkeypatch.setattr(bpe, "SLICE", 300)
    enc.known = bpe.Pieces(enc.dtype, 40)
    assert all((x == y).all() for x, y in zip(enc.encode(col), want)) and 0 < enc.known.n <= 100
    monkeypatch.setattr(A.SpanHash, "__call__", lambda self, a, b: (b - a).astype(np.uint64) % np.uint64(3))
    one = bpe.Encoder(by="tiktoken")
    for t in texts:  # one by one, so that pieces of different texts meet in the table only
        ids, _ = one.encode(A.as_strings(pa.array([t])))
        assert ids.tolist() == enc.encode(A.as_strings(pa.array([t])))[0].tolist()
    assert all((x == y).all() for x, y in zip(one.encode(col), want))


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_stream_of_bytes(data, at):
    d = bpe.StreamDecoder([bytes([i]) for i in range(256)])
    cuts = sorted({0, len(data), *(min(a, len(data)) for a in at)})
    out = "".join(d.push(data[a:b]) for a, b in zip(cuts, cuts[1:])) + d.finish()
    assert out == data.decode("utf-8", "replace")


def test_characters_come_when_complete():
    d = bpe.StreamDecoder([bytes([i]) for i in range(256)])
    assert [d.push([b]) for b in "a€".encode()] == ["a", "", "", "€"]


def test_long_texts(other):
    texts = ["word " * 400_000, "x" * 100_000, " " * 50_000 + "y", "ß" * 30_001]
    enc = bpe.encoder()
    ids, off = enc.encode(A.as_strings(pa.array(texts)))
    assert bpe.decode_all(enc, ids, off) == texts
    assert ids[: off[1]].tolist() == other.encode_ordinary(texts[0])


def test_documents(spark, other):
    texts = ["Hello world's end", "", None, "naïve 日本 🙂\r\n\t x", "Hello world's end"]
    df = spark.createDataFrame([(i % 2, t, "old", "old") for i, t in enumerate(texts)], SCHEMA)
    got = bpe.encode_documents(df)
    assert got.columns == ["doc_id", "text", "token_ids", "n_tokens", "roundtrip"]
    for r in got.collect():
        if r.text is None:
            assert r.token_ids is r.n_tokens is r.roundtrip is None
        else:
            assert r.token_ids == other.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids) and r.roundtrip
    assert got.count() == len(texts)
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_refusals():
    with pytest.raises(ValueError):
        bpe.Merges([b"a", b"b"])
    assert np.all(bpe.piece_bounds(np.zeros(0, np.uint32), np.zeros(1, np.int64)) == [])
