"""Array kernels over Arrow string batches: slices, code points, words, packing.

All of them work on whole batches without a Python loop over characters or words.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters handled at once; one longer text is handled alone, whole.
SLICE_CHARS = 1_500_000

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
_tables: dict[str, np.ndarray] = {}
#: \s of Unicode regular expressions.
_SPACES = [*range(9, 14), 28, 29, 30, 31, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def class_table() -> np.ndarray:
    """LETTER, DIGIT, SPACE or OTHER for every code point."""
    if "class" not in _tables:
        t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        kinds = {"L": LETTER, "N": DIGIT}
        for c in range(sys.maxunicode + 1):
            k = kinds.get(unicodedata.category(chr(c))[0])
            if k is not None:
                t[c] = k
        t[[c for c in _SPACES if c not in (28, 29, 30, 31)]] = SPACE
        _tables["class"] = t
    return _tables["class"]


def lower_table() -> np.ndarray:
    """One-to-one lower case; characters whose lower case is longer keep their first character."""
    if "lower" not in _tables:
        t = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            if not 0xD800 <= c < 0xE000:
                t[c] = ord(chr(c).lower()[0])
        _tables["lower"] = t
    return _tables["lower"]


def as_strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A null-free large_string array that starts at offset 0 (nulls become "")."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pa.concat_arrays([col.fill_null("").cast(pa.large_string())])


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a null-free large_string array."""
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    buf = col.buffers()[2]
    raw = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(col: pa.Array, most: int = SLICE_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of at most ``most`` bytes of text (one row at least), with their first row."""
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, col.slice(i, j - i)
        i = j


def codepoints(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, their texts' offsets, and each character's byte offset (with the end)."""
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(cps) == len(raw):
        return cps, off, np.arange(len(raw) + 1)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    at = np.append(at, len(raw))
    return cps, np.searchsorted(at, off), at


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_P, _PINV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    key = f"pow{int(base)}"
    have = _tables.get(key)
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        have = np.empty(m, np.uint64)
        have[0] = 1
        have[1:] = base
        have = np.multiply.accumulate(have)
        _tables[key] = have
    return have[:n]


class SpanHash:
    """Hashes of any spans of one array, from prefix sums of a polynomial modulo 2**64.

    Equal spans have equal hashes wherever they stand.
    """

    def __init__(self, values: np.ndarray):
        v = mix(values.astype(np.uint64) + np.uint64(0x1234567))
        self.sums = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * powers(_P, len(v)), out=self.sums[1:])
        self.inv = powers(_PINV, len(v) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64) * _P)


def words(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of letters and digits."""
    kind = class_table()[cps] <= DIGIT
    start = kind.copy()
    start[1:] &= ~kind[:-1]
    end = kind.copy()
    end[:-1] &= ~kind[1:]
    inner = off[(off > 0) & (off < len(cps))]  # a text's first character begins a run, its predecessor ends one
    start[inner] = kind[inner]
    end[inner - 1] = kind[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lens[i]-1, one after another."""
    total = int(lens.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    keep = lens > 0
    starts, lens = starts[keep], lens[keep]
    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
    out[at] = starts
    out[at[1:]] -= starts[:-1] + lens[:-1] - 1
    return np.cumsum(out)


def pack(a: np.ndarray) -> bytes:
    """Bytes plane by plane, so that the exchange's compression sees equal high bytes together."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not b:
        return np.zeros(0, dtype)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """A sorted integer array as packed differences."""
    if not len(a):
        return b""
    d = a.copy()
    d[1:] -= a[:-1]
    return pack(d)


def unpack_sorted(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(b, dtype), dtype=dtype)


def cuts(sorted_codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of the codes 0..n-1 begins in a sorted array of codes, and the end."""
    return np.searchsorted(sorted_codes, np.arange(n + 1))
