"""Language-model scoring: a Katz backoff trigram model over byte-level BPE tokens.

Counting, estimation and evaluation are partitioned by the token before the predicted one,
so a bucket has everything that its trigrams' recursion needs but the unigrams, which the
vocabulary bounds. A chunk of documents sends each different trigram once to its bucket and
gets one log probability for it back, so what travels is in proportion to the corpus while
the model is never in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .bpe import encoder, load_ranks
from .common import default_tokenizer, n_buckets, picked, written

#: Counts up to K are discounted.
K = 5
#: Trigrams, and bigrams, seen less often would be left to the backoff; 1 leaves none out.
MIN_TRIGRAM, MIN_BIGRAM = 1, 1
CHUNK_TOKENS = 3_000_000


def _z(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def _u(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


@dataclass
class Coding:
    """Trigrams as integers, the token before the predicted one first."""

    vocab: int

    @property
    def bits(self) -> int:
        return (self.vocab + 1).bit_length()

    @property
    def bos(self) -> int:
        return self.vocab

    @property
    def eos(self) -> int:
        return self.vocab + 1

    def keys(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """A key for each predicted token of each text, its end included."""
        b, full = np.uint64(self.bits), lens + 3
        end = np.cumsum(full)
        seq = np.empty(int(full.sum()), np.uint64)
        inner = np.ones(len(seq), bool)
        inner[end - 1] = inner[end - full] = inner[end - full + 1] = False
        seq[inner] = ids
        seq[end - 1], seq[end - full], seq[end - full + 1] = self.eos, self.bos, self.bos
        key = (seq[1:-1] << (b + b)) | (seq[:-2] << b) | seq[2:] if len(seq) > 2 else seq[:0]
        predicted = np.ones(len(seq), bool)
        predicted[end - full] = predicted[end - full + 1] = False
        return key[predicted[2:]] if len(seq) > 2 else key

    def parts(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """w1, w2, w3"""
        b, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        return (key >> b) & mask, key >> (b + b), key & mask

    def bucket(self, key: np.ndarray, n: int) -> np.ndarray:
        return (A.mix(key >> np.uint64(2 * self.bits)) % np.uint64(n)).astype(np.int32)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing factors by count, 1 above K. n[r]: how many n-grams are seen r times, to K + 1.

    Factors must lie between 0 and 1 and leave what is seen more often the larger count: where copied
    documents swell some n[r], the plain estimate turns that around. Then a line through log n[r] by
    log r smooths the counts of counts. If that fails too, absolute discounting by
    n1 / (n1 + 2 n2), or by one half, stands in for the whole order.
    """
    r = np.arange(1, K + 2)
    seen = np.array(n[1 : K + 2], np.float64)
    tries = [seen] if (seen > 0).all() else []
    if (seen > 0).sum() > 1:
        slope, at = np.polyfit(np.log(r[seen > 0]), np.log(seen[seen > 0]), 1)
        tries.append(np.exp(at + slope * np.log(r)))
    d = np.ones(K + 2)
    for m in tries:
        a = (K + 1) * m[K] / m[0]
        if a < 1:
            d[1 : K + 1] = (r[1:] * m[1:] / (r[:-1] * m[:-1]) - a) / (1 - a)
            if ((d[1 : K + 1] > 0) & (d[1 : K + 1] < 1)).all() and (np.diff(d[1:] * r) > 0).all():
                return d
    by = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d[1 : K + 1] = 1 - by / r[:-1]
    return d


def unigrams(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """P(w), summing to 1: what discounting leaves goes in equal parts to the tokens never seen."""
    n, unseen = count.sum(), int((count == 0).sum())
    if not n:
        return np.full(len(count), 1 / len(count))
    p = d[np.minimum(count, K + 1)] * count / n
    if not unseen:
        return p / p.sum()
    if 1 - p.sum() < 1e-12:
        p = count / (n + 1)
    p[count == 0] = (1 - p.sum()) / unseen
    return p


def _level(ctx: np.ndarray, contexts: int, count: np.ndarray, total: np.ndarray, d: np.ndarray, least: int, lower: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one order: P where seen often enough (else 0), the backoff weight of each context, and what is kept.

    ``lower``: the next lower order's probability of each entry. Over all tokens, P where kept and
    weight times lower elsewhere sum to 1 in each context.
    """
    keep = count >= least
    p = np.where(keep, d[np.minimum(count, K + 1)] * count / total[ctx], 0.0)
    left = 1 - np.bincount(ctx, p, contexts)
    kept = np.bincount(ctx, keep, contexts)
    # no discounted count in a context: one more is seen, of anything else
    none = (left < 1e-9) & (kept < vocabulary)
    if none.any():
        p = np.where(none[ctx] & keep, count / (total[ctx] + 1.0), p)
        left = 1 - np.bincount(ctx, p, contexts)
    free = 1 - np.bincount(ctx, np.where(keep, lower, 0.0), contexts)
    full = (kept >= vocabulary) | (free < 1e-12)
    if full.any():
        p = np.where(full[ctx], p / np.maximum(1 - left, 1e-300)[ctx], p)
    return p, np.where(full, 0.0, left / np.where(full, 1.0, free)), keep


class Bucket:
    """The model of all trigrams whose middle token falls in one bucket."""

    def __init__(self, coding: Coding, keys: np.ndarray, count: np.ndarray, uni: np.ndarray, d2: np.ndarray, d3: np.ndarray, min2: int = MIN_BIGRAM, min3: int = MIN_TRIGRAM):
        self.c, self.keys, self.uni = coding, keys, uni
        b = np.uint64(coding.bits)
        w1, w2, w3 = coding.parts(keys)
        v = coding.vocab + 1
        self.two, inv = np.unique((w2 << b) | w3, return_inverse=True)
        n2 = np.bincount(inv, count).astype(np.int64)
        self.hist, h = np.unique(self.two >> b, return_inverse=True)
        low = uni[self.symbol(self.two & np.uint64((1 << coding.bits) - 1))]
        self.p2, self.a2, keep = _level(h, len(self.hist), n2, np.bincount(h, n2), d2, min2, low, v)
        self.p2 = np.where(keep, self.p2, self.a2[h] * low)  # recursion: P(w3 | w2)
        self.ctx, g = np.unique((w2 << b) | w1, return_inverse=True)
        self.p3, self.a3, keep = _level(g, len(self.ctx), count, np.bincount(g, count), d3, min3, self.p2[inv], v)
        self.p3 = np.where(keep, self.p3, self.a3[g] * self.p2[inv])

    def symbol(self, w3: np.ndarray) -> np.ndarray:
        """Place in the unigram table: tokens, then the end."""
        return np.where(w3 == self.c.eos, self.c.vocab, w3).astype(np.int64)

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """log P(w3 | w1 w2), seen or not; all middle tokens must be this bucket's."""
        p = np.zeros(len(keys))
        at, seen = _find(self.keys, keys)
        p[seen] = self.p3[at[seen]]
        rest = np.flatnonzero(~seen)
        if len(rest):
            b = np.uint64(self.c.bits)
            w1, w2, w3 = self.c.parts(keys[rest])
            at, has = _find(self.two, (w2 << b) | w3)
            hist, known = _find(self.hist, w2)
            q = self.uni[self.symbol(w3)] * np.where(known, self.a2[hist] if len(self.a2) else 1.0, 1.0)
            q[has] = self.p2[at[has]]
            ctx, known = _find(self.ctx, (w2 << b) | w1)
            p[rest] = q * np.where(known, self.a3[ctx] if len(self.a3) else 1.0, 1.0)
        return np.log(p)


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def _tokens(docs: DataFrame, path: str | None) -> DataFrame:
    """Documents in chunks of tokens."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["id"].dataType)), T.StructField("lens", T.BinaryType()), T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(path, "tiktoken"), TaskContext.get().partitionId(), 0
        ids, lens, toks, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 20) | number], pa.int64()), pa.array([[x for a in ids for x in a.to_pylist()]], pa.list_(ids[0].type)),
                pa.array([_z(np.concatenate(lens).astype(np.int64).tobytes())], pa.binary()), pa.array([_z(A.pack(np.concatenate(toks)))], pa.binary()),
            ], names=schema.names)

        for batch in batches:
            for lo, piece in A.slices(A.as_strings(batch.column(1)), 2_000_000):
                t, off = enc.encode(piece)
                ids.append(batch.column(0).slice(lo, len(piece)))
                lens.append(np.diff(off))
                toks.append(t)
                total += len(t)
                if total >= CHUNK_TOKENS:
                    yield flush()
                    ids, lens, toks, total, number = [], [], [], 0, number + 1
        if ids:
            yield flush()

    return docs.mapInArrow(run, schema)


def _chunk(lens: bytes, tokens: bytes, coding: Coding) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's keys in order of the text, and its documents' lengths."""
    n = np.frombuffer(_u(lens), np.int64)
    return coding.keys(A.unpack(_u(tokens), np.uint16 if coding.vocab < 65_000 else np.int32), n), n


def _by_bucket(keys: np.ndarray, coding: Coding, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts sorted keys by bucket, and where buckets begin."""
    b = coding.bucket(keys, n)
    order = np.argsort(b, kind="stable")
    return order, A.cuts(b[order], n)


def _sent(tokens: DataFrame, coding: Coding, n: int, counts: bool) -> DataFrame:
    """Each chunk's distinct keys, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lens, toks in zip(*(c.to_pylist() for c in batch.columns)):
                keys, c = np.unique(_chunk(lens, toks, coding)[0], return_counts=True)
                order, at = _by_bucket(keys, coding, n)
                keys, c = keys[order], np.minimum(c[order], 0xFFFFFFFF).astype(np.uint32)
                used = [x for x in range(n) if at[x] < at[x + 1]]
                cols = [pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()), pa.array([_z(A.pack_sorted(keys[at[x] : at[x + 1]])) for x in used], pa.binary())]
                if counts:
                    cols.append(pa.array([_z(A.pack(c[at[x] : at[x + 1]])) for x in used], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "chunk", "keys", "counts"][: len(cols)])

    return tokens.select("chunk", "lens", "tokens").mapInArrow(run, "bucket int, chunk long, keys binary" + ", counts binary" * counts)


def _counted(sent: DataFrame, coding: Coding) -> DataFrame:
    schema = "bucket int, keys binary, counts binary, n2 array<bigint>, n3 array<bigint>, words array<int>, times array<bigint>"

    def run(t: pa.Table) -> pa.Table:
        keys = np.concatenate([A.unpack_sorted(_u(x), np.uint64) for x in t.column("keys").to_pylist()])
        count = np.concatenate([A.unpack(_u(x), np.uint32) for x in t.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, count = keys[order], count[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, count = keys[first], np.add.reduceat(count, first)
        _, w2, w3 = coding.parts(keys)
        _, inv = np.unique((w2 << np.uint64(coding.bits)) | w3, return_inverse=True)
        two = np.bincount(inv, count).astype(np.int64)
        words, inv = np.unique(w2, return_inverse=True)
        times = np.bincount(inv, count).astype(np.int64)
        cc = [np.bincount(np.minimum(x, K + 2), minlength=K + 3)[: K + 2].tolist() for x in (two, count)]
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "keys": pa.array([_z(A.pack_sorted(keys))], pa.binary()), "counts": pa.array([_z(A.pack(count.astype(np.uint64)))], pa.binary()),
                         "n2": pa.array([cc[0]], pa.list_(pa.int64())), "n3": pa.array([cc[1]], pa.list_(pa.int64())), "words": pa.array([words.astype(np.int32)], pa.list_(pa.int32())), "times": pa.array([times], pa.list_(pa.int64()))})

    return sent.groupBy("bucket").applyInArrow(run, schema)


@dataclass
class Katz:
    """A trained model: counts in a table partitioned by bucket, and what all buckets share."""

    coding: Coding
    buckets: int
    table: DataFrame
    uni: np.ndarray
    d2: np.ndarray
    d3: np.ndarray


def train_on(tokens: DataFrame, coding: Coding, buckets: int) -> Katz:
    table = written(_counted(_sent(tokens, coding, buckets, True), coding), "katz-counts")
    cc = table.select(*[F.sum(F.get(c, F.lit(r))).alias(f"{c}_{r}") for c in ("n2", "n3") for r in range(K + 2)]).first()
    n2, n3 = ([cc[f"{c}_{r}"] or 0 for r in range(K + 2)] for c in ("n2", "n3"))
    count = np.zeros(coding.vocab + 1, np.int64)
    # a token is a history as often as it is predicted; the end is predicted once for each begin. At most a row a token
    for w, c in table.select(F.explode(F.arrays_zip("words", "times")).alias("x")).select("x.words", "x.times").collect():
        count[coding.vocab if w == coding.bos else w] = c
    nr = np.bincount(np.minimum(count, K + 2), minlength=K + 3)
    return Katz(coding, buckets, table, unigrams(count, discounts(nr.tolist())), discounts(n2), discounts(n3))


def score_tokens(tokens: DataFrame, model: Katz) -> DataFrame:
    """(id, n_tokens, log_prob) of the documents of ``tokens``."""
    coding, n = model.coding, model.buckets
    id_type = tokens.schema["ids"].dataType.elementType
    shared = tokens.sparkSession.sparkContext.broadcast((model.uni, model.d2, model.d3))  # bounded by the vocabulary

    def answer(key: tuple, counts: pa.Table, asked: pa.Table) -> pa.Table:
        keys = A.unpack_sorted(_u(counts.column("keys")[0].as_py()), np.uint64) if len(counts) else np.zeros(0, np.uint64)
        count = A.unpack(_u(counts.column("counts")[0].as_py()), np.uint64).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
        m = Bucket(coding, keys, count, *shared.value)
        out = [_z(A.pack(m.log_p(A.unpack_sorted(_u(x), np.uint64)).astype(np.float32))) for x in asked.column("keys").to_pylist()]
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "log_p": pa.array(out, pa.binary())})

    asked = _sent(tokens, coding, n, False)
    answers = model.table.select("bucket", "keys", "counts").groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, "chunk long, bucket int, log_p binary")
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType())])

    def total(key: tuple, chunk: pa.Table, got: pa.Table) -> pa.Table:
        seq, lens = _chunk(chunk.column("lens")[0].as_py(), chunk.column("tokens")[0].as_py(), coding)
        keys, inv = np.unique(seq, return_inverse=True)
        order, at = _by_bucket(keys, coding, n)
        value = np.empty(len(keys))
        for b, x in zip(got.column("bucket").to_pylist(), got.column("log_p").to_pylist()):
            value[order[at[b] : at[b + 1]]] = A.unpack(_u(x), np.float32)
        end = np.cumsum(lens + 1)
        sums = np.add.reduceat(value[inv], end - lens - 1) if len(lens) else np.zeros(0)
        return pa.table([pa.array(chunk.column("ids")[0].as_py(), chunk.schema.field("ids").type.value_type), pa.array(lens), pa.array(sums)], names=schema.names)

    return tokens.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(total, schema)


def lm_score(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, n_tokens, log_prob, perplexity) of every row of ``df``, by the model counted on all of them.

    A trigram seen ``MIN_TRIGRAM`` times or more has its discounted frequency; others have the
    context's weight times the bigram's probability, and so on down to the unigrams; in each
    context the probabilities of all tokens and the end sum to 1. ``log_prob`` is natural, over all tokens
    and the end; an empty text has the end only. A null text is not counted and has null in the
    three results. Rows with equal or null keys are scored one by one. Whole texts; other columns
    are not read.
    """
    docs = picked(df, id=key, text=text)
    coding = Coding(len(load_ranks(path or default_tokenizer())))
    tokens = written(_tokens(docs.where("text is not null"), path), "katz-tokens")
    model = train_on(tokens, coding, n_buckets(docs, 1.0))
    some = score_tokens(tokens, model)
    none = docs.where("text is null").select("id", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("log_prob"))
    out = some.unionByName(none)
    return out.select(F.col("id").alias(key), "n_tokens", F.round("log_prob", 4).alias("log_prob"), F.round(F.exp(-F.col("log_prob") / (F.col("n_tokens") + 1)), 4).alias("perplexity"))
