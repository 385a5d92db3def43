"""Token ids as directly addressable codes.

An id is cut into chunks of bits, one level each. A level holds the chunks of those ids that
reach it, a bitmap says which of them go on, and a rank directory counts the bitmap's ones
before each block; so token i is found by one look-up and one short popcount a level,
without decoding any other token.

Layout of a code (little-endian): magic "DAC1"; u32 number of ids; u8 levels; u8 bits of each
level; then for each level: chunks (bit-packed), and for all but the last level the
bitmap in 64-bit words and a u32 rank for each block of 8 words. Sections are padded to 8 bytes.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .bpe import encoder
from .common import fresh

MAGIC = b"DAC1"
#: Bits of the levels, lowest first: most ids of a 50k vocabulary end on the first two.
LEVELS = (8, 8, 16)
BLOCK = 8
_BYTES = {8: np.uint8, 16: np.uint16, 32: np.uint32}


def _pad(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def encode(ids: np.ndarray, levels: tuple[int, ...] = LEVELS) -> bytes:
    """The code of ids from 0 to 2**sum(levels) - 1; any number of them, none included."""
    if any(b not in _BYTES for b in levels):
        raise ValueError("levels are 8, 16 or 32 bits")
    x = np.asarray(ids, np.int64)
    if len(x) and (int(x.min()) < 0 or int(x.max()) >> sum(levels)):
        raise ValueError("ids must lie in 0 .. 2**bits - 1")
    parts, n = [], len(x)
    used = []
    for bits in levels:
        used.append(bits)
        parts.append(_pad((x & ((1 << bits) - 1)).astype(_BYTES[bits]).tobytes()))
        x = x >> bits
        more = x > 0
        if not more.any():
            break
        raw = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(more) // 64), np.uint64)
        words.view(np.uint8)[: len(raw)] = raw
        ones = np.bitwise_count(words).astype(np.uint32)
        block = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK))
        parts += [words.tobytes(), _pad((np.cumsum(block) - block).astype(np.uint32).tobytes())]
        x = x[more]
    head = MAGIC + np.uint32(n).tobytes() + bytes([len(used), *used])
    return _pad(head) + b"".join(parts)


class Reader:
    """Random access to one code, in memory or memory-mapped."""

    def __init__(self, code: bytes | memoryview):
        head = bytes(code[:9])
        if head[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        self.n, levels = int.from_bytes(head[4:8], "little"), head[8]
        bits = list(bytes(code[9 : 9 + levels]))
        at, n = -(-(9 + levels) // 8) * 8, self.n
        self.levels = []
        for k, b in enumerate(bits):
            chunks = np.frombuffer(code, _BYTES[b], n, at)
            at += -(-n * b // 8 // 8) * 8
            words = rank = None
            if k < levels - 1:
                w = -(-n // 64)
                words = np.frombuffer(code, np.uint64, w, at)
                at += 8 * w
                r = -(-w // BLOCK)
                rank = np.frombuffer(code, np.uint32, r, at)
                at += -(-4 * r // 8) * 8
                last = (r - 1) * BLOCK
                n = int(rank[-1]) + int(np.bitwise_count(words[last:]).sum())
            self.levels.append((b, chunks, words, rank))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out, shift = 0, 0
        for b, chunks, words, rank in self.levels:
            out |= int(chunks[i]) << shift
            if words is None or not (int(words[i >> 6]) >> (i & 63)) & 1:
                return out
            shift += b
            w = i >> 6
            first = w // BLOCK * BLOCK
            below = int(words[w]) & ((1 << (i & 63)) - 1)
            i = int(rank[w // BLOCK]) + sum(int(x).bit_count() for x in words[first:w]) + below.bit_count()
        raise ValueError("the last level goes on")

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(self.n, np.int64)
        at, shift = np.arange(self.n), 0
        for b, chunks, words, _ in self.levels:
            out[at] |= chunks.astype(np.int64) << shift
            shift += b
            if words is not None:
                at = at[np.unpackbits(words.view(np.uint8), bitorder="little")[: len(at)].astype(bool)]
        return out


def tokens_to_dac(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, code: str = "code", n_tokens: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` (default: all) with each text's token ids as one binary ``code``.

    An empty text has the code of no ids, a null text null in ``code`` and ``n_tokens``. Kept
    columns named like a result are replaced. Whole texts; narrow, no shuffle.
    """
    names = [c for c in (keep if keep is not None else df.columns) if c.lower() not in (code.lower(), n_tokens.lower())]
    t = fresh(df, "text_of")[0]
    src = df.select([df[f"`{c}`"] for c in names] + [df[f"`{text}`"].alias(t)])
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(n_tokens, T.LongType()), T.StructField(code, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "tiktoken")
        for b in batches:
            col = b.column(len(names))
            for lo, part in A.slices(A.as_strings(col), 4_000_000):
                ids, off = enc.encode(part)
                null = np.asarray(col.slice(lo, len(part)).is_null())
                codes = [None if z else encode(ids[x:y]) for x, y, z in zip(off[:-1].tolist(), off[1:].tolist(), null.tolist())]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, len(part)).columns[:-1], pa.array(np.diff(off), pa.int64(), mask=null), pa.array(codes, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


@F.pandas_udf(T.LongType())
def token_at(code: pd.Series, i: pd.Series) -> pd.Series:
    """Token ``i`` (from 0) of a code; null where either is null or there is no such token."""
    out = []
    for c, k in zip(code, i):
        if c is None or k is None or k != k:
            out.append(None)
            continue
        r = Reader(c)
        out.append(r[int(k)] if 0 <= k < len(r) else None)
    return pd.Series(out, dtype="Int64")
