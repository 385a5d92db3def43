"""Exact dedup by two-pass Bloom filtering.

Pass 1 sends only 8-byte hashes: each hash bucket streams its hashes through a Bloom
filter of what was seen, and those that were seen already into a second filter. Pass 2
tests every row against the second filters; rows that hit are possibly repeated and alone
shuffle, the rest pass straight through. Rows that shuffle are compared by SHA-256 and
the whole value, so false positives cost time, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, n_buckets, written

#: Filter bits per element, and hash functions.
BITS, K = 16, 4
#: Second filters that are broadcast at once. Where all of them are larger, the table is read once for each such part.
MAX_BROADCAST = 128 << 20


class Bloom:
    """A Bloom filter over 64-bit hashes, 64-bit words; double hashing."""

    def __init__(self, n: int, words: np.ndarray | None = None):
        self.words = np.zeros(max(1, -(-n * BITS // 64)), np.uint64) if words is None else words

    @staticmethod
    def positions(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        # 31-bit parts of the hash, so that Spark's signed 64-bit arithmetic gives the same
        a, b = h & np.uint64(0x7FFFFFFF), (h >> np.uint64(31)) & np.uint64(0x7FFFFFFF)
        for i in range(K):
            yield (a + np.uint64(i) * b) % np.uint64(bits)

    def test(self, h: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h), bool)
        for p in self.positions(h, len(self.words) * 64):
            hit &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return hit

    def add(self, h: np.ndarray) -> None:
        for p in self.positions(h, len(self.words) * 64):
            np.bitwise_or.at(self.words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))


def second_filter(h: np.ndarray, block: int = 4096) -> tuple[np.ndarray, int]:
    """The filter of hashes that the first filter had already seen, and their number."""
    seen = Bloom(len(h))
    again = []
    for i in range(0, len(h), block):
        part = h[i : i + block]
        u, c = np.unique(part, return_counts=True)
        again.append(u[(c > 1) | seen.test(u)])  # within a block, an element is seen before its second copy
        seen.add(u)
    rep = np.unique(np.concatenate(again)) if again else h[:0]
    out = Bloom(len(rep))
    out.add(rep)
    return out.words, len(rep)


def _bucket(h: Column, n: int) -> Column:
    return (F.shiftrightunsigned(h, 40) % n).cast("int")


def _test(h: Column, words: Column) -> Column:
    """The same test as Bloom.test as a Spark expression over array<bigint>; null words: no hit."""
    bits = F.size(words).cast("long") * 64
    a, b = h.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(h, 31).bitwiseAND(0x7FFFFFFF)
    hit = F.lit(True)
    for i in range(K):
        p = (a + b * i) % bits
        # get() counts from 0; shifts take the low six bits of the distance
        hit = hit & (F.call_function("shiftrightunsigned", F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")).bitwiseAND(1) == 1)
    return F.coalesce(hit, F.lit(False))


def possibly_repeated(df: DataFrame, h: str, flag: str, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``df`` with the boolean column ``flag``: false only where ``h`` (long, not null) stands once.

    Null hashes are never flagged. Filters of neighbouring buckets are broadcast together, up to
    ``max_broadcast`` bytes (one bucket at least, whose hashes ``n_buckets`` bounds); the rows of their
    buckets are tested against them. So no row moves, however many hashes are repeated.
    """
    n = n_buckets(df, 0.01)
    hashes = df.select(df[f"`{h}`"].alias("h")).where("h is not null").withColumn("b", _bucket(F.col("h"), n))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        words, rep = second_filter(pdf["h"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"b": [key[0]], "rep": [rep], "words": [words.view(np.int64)]})

    filters = hashes.groupBy("b").applyInPandas(build, "b int, rep long, words array<bigint>").where("rep > 0")
    filters = written(filters, "bloom")
    # a number for each bucket: sizes decide which filters go together
    starts, held = [0], 0
    for b, size in sorted(filters.select("b", F.size("words") * 8).collect()):
        if held and held + size > max_broadcast:
            starts.append(b)
            held = 0
        held += size
    if not held:
        return df.withColumn(flag, F.lit(False))
    b, words = fresh(df, "bucket", "words")
    df = df.withColumn(b, F.coalesce(_bucket(F.col(f"`{h}`"), n), F.lit(0)))
    parts = []
    for lo, hi in zip(starts, [*starts[1:], n]):
        some = F.broadcast(filters.where(F.col("b").between(lo, hi - 1)).select(F.col("b").alias(b), F.col("words").alias(words)))
        rows = df.where(F.col(b).between(lo, hi - 1)) if len(starts) > 1 else df
        parts.append(rows.join(some, b, "left").withColumn(flag, F.col(f"`{h}`").isNotNull() & _test(F.col(f"`{h}`"), F.col(words))).drop(b, words))
    return reduce(DataFrame.unionByName, parts)


def exact_dedup(df: DataFrame, text: str = "text", order: str = "doc_id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row of each group with the same text, all columns: the first by ``order``.

    Ties in ``order`` go by the whole row's hash; rows equal in everything are one. Texts are
    compared whole and as they are (case, white space). Empty texts are equal to each other; a
    row with a null text is a copy of nothing and stays. A null ``order`` comes last.
    """
    cols = list(df.columns)
    h, flag, key, best, null = fresh(df, "h", "flag", "key", "best", "null")
    t, o = F.col(f"`{text}`"), F.col(f"`{order}`")
    tagged = possibly_repeated(df.withColumn(h, F.when(t.isNotNull(), F.xxhash64(t))), h, flag, max_broadcast)
    row = F.struct([F.col(f"`{c}`") for c in cols])
    # min_by combines on the map side: of a group with many copies, each task sends one row
    first = (
        tagged.where(F.col(flag))
        .groupBy(F.sha2(t, 256).alias(key), F.length(t))
        .agg(F.min_by(row, F.struct(o.isNull(), o, F.xxhash64(*[F.col(f"`{c}`") for c in cols]))).alias(best))
        .select(f"{best}.*")
    )
    return tagged.where(~F.col(flag)).select([F.col(f"`{c}`") for c in cols]).unionByName(first)
