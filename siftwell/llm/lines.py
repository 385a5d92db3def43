"""Line dedup: a segment-partition edit join over all lines of a corpus.

Two lines within ``k`` edits share one of ``k + 1`` segments of the shorter one unchanged,
at a place and for a length that the edits bound. Every line indexes its segments and
probes, for each length in reach, the substrings that could be such a segment. Keys travel
packed, per bucket and chunk; what meets under a key is verified by a banded bit-parallel
edit distance over many pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .common import broadcast_if, fresh, n_buckets, release, written

MAX_EDITS = 2
#: Shorter lines are never removed: this is part of what the operator means by a line.
MIN_CHARS = 20
#: Keys that a task gathers before it sends them.
CHUNK_KEYS = 1_500_000
#: Tables up to this size are broadcast, larger ones are joined by shuffle.
BROADCAST = 32 << 20


def segments(n: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of each of the k segments of lines of the lengths n; the last ones are the longer."""
    base, rem = n // k, n % k
    return [(i * base + np.maximum(0, i - (k - rem)), base + (i >= k - rem)) for i in range(k)]


def line_keys(cps: np.ndarray, start: np.ndarray, end: np.ndarray, edits: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(keys, line numbers) that the lines index, and those they probe."""
    span, n, k = A.SpanHash(cps), end - start, edits + 1
    number = np.arange(len(n))
    index, probe = [], []

    def keys(s: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
        return A.mix(span(s, s + size) ^ A.mix((length * 16 + i).astype(np.uint64)))

    for i, (p, size) in enumerate(segments(n, k)):
        index.append((keys(start + p, size, n, i), number))
    for less in range(edits + 1):
        length = n - less
        for i, (p, size) in enumerate(segments(length, k)):
            # the segment moves by at most i edits before it and edits - i after it
            for by in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                ok = (p + by >= 0) & (p + by + size <= n) & (length > 0)
                probe.append((keys(start[ok] + (p + by)[ok], size[ok], length[ok], i), number[ok]))
    return tuple((np.concatenate([x for x, _ in t]), np.concatenate([x for _, x in t])) for t in (index, probe))


def within(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Whether a[i] and b[i] are within ``edits`` edits: Myers' bit vectors on a band that moves down
    by one row a column, for all pairs at once."""
    out = np.zeros(len(a), bool)
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b)]
    len1 = np.array([len(x) for x, _ in pairs], np.int64)
    len2 = np.array([len(y) for _, y in pairs], np.int64)
    todo = np.flatnonzero((len1 - len2 <= edits) & (len1 > edits))
    for i in np.flatnonzero(len1 <= edits):
        out[i] = True  # replacing everything is enough
    todo = todo[np.argsort(len1[todo], kind="stable")]
    at = 0
    while at < len(todo):
        size = 1
        while at + size < len(todo) and size < 8192 and (size + 1) * len1[todo[at + size]] < 6_000_000:
            size += 1
        some = todo[at : at + size]
        at += size
        out[some] = _within_block([pairs[i] for i in some], len1[some], len2[some], edits)
    return out


def _within_block(pairs: list[tuple[str, str]], n1: np.ndarray, n2: np.ndarray, k: int) -> np.ndarray:
    count, width = len(pairs), int(n1.max())
    s1 = np.zeros((width + 4 * k + 4, count), np.uint32)  # one row a position, k rows of padding before
    s2 = np.full((width + 1, count), 0xFFFFFFFF, np.uint32)
    for j, (x, y) in enumerate(pairs):
        s1[k + 1 : k + 1 + len(x), j] = np.frombuffer(x.encode("utf-32-le"), np.uint32) + 1
        s2[: len(y), j] = np.frombuffer(y.encode("utf-32-le"), np.uint32) + 1
    # bit 2k of the band is row i + k, bit 0 row i - k
    one, top = np.uint64(1), np.uint64(2 * k)
    full = np.uint64((1 << (2 * k + 1)) - 1)
    vp = np.full(count, ((1 << (k + 1)) - 1) << k, np.uint64)  # rows 0 .. k grow by one; above them nothing does
    vn = np.zeros(count, np.uint64)
    score = np.full(count, k, np.int64)  # at row k of column -1
    mask = np.full(count, int(one << top), np.uint64)
    for i in range(int(n2.max())):
        eq = np.zeros(count, np.uint64)
        for d in range(2 * k + 1):
            eq |= (s1[i + 1 + d] == s2[i]).astype(np.uint64) << np.uint64(d)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        run = i < n2
        slide = run & (i + k < n1)  # the band's last row still moves down
        score += slide & ((d0 >> top) & one == 0)
        fixed = run & ~slide  # at the last row, one bit lower each column
        if fixed.any():
            mask = np.where(fixed, mask >> one, mask)
            score += fixed & (hp & mask != 0)
            score -= fixed & (hn & mask != 0)
        d1 = d0 >> one
        vp = (hn | ~(d1 | hp)) & full
        vn = d1 & hp
    return score <= k


def _near_pairs(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """Candidate pairs (a, b) of 64-bit hashes of lines that may be within ``edits`` edits, each pair once."""
    buckets = n_buckets(docs, 1.2)

    def keys_of(part: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(keys, hashes of their lines) for the index and for probing."""
        raw, off = A.string_parts(part)
        cps, coff, at = A.codepoints(raw, off)
        if not len(cps):
            return []
        brk = cps == 10
        # a line begins where a text does and after a break
        start = np.unique(np.concatenate([coff[:-1], np.flatnonzero(brk) + 1]))
        start = start[start < len(cps)]
        after = np.append(start[1:], len(cps))
        end = after - brk[after - 1]
        long = end - start >= min_chars
        start, end = start[long], end[long]
        if not len(start):
            return []
        _, first = np.unique(A.SpanHash(cps)(start, end), return_index=True)
        start, end = start[first], end[first]
        data, cut_a, cut_b = raw.tobytes(), at[start].tolist(), at[end].tolist()
        h = np.fromiter((xxhash.xxh64_intdigest(data[x:y], 42) for x, y in zip(cut_a, cut_b)), np.uint64, len(start))
        return [(keys, h[number]) for keys, number in line_keys(cps, start, end, edits)]

    def packed(held: list[list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
        cols = []
        for i in (0, 1):
            keys, h = _distinct(np.concatenate([x[i][0] for x in held]), np.concatenate([x[i][1] for x in held]))
            b = (keys % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")  # keys stay sorted in a bucket
            cols.append((A.cuts(b[order], buckets), (keys[order] >> np.uint64(32)).astype(np.uint32), h[order]))
        (ci, ki, hi), (cp, kp, hp) = cols
        used = [x for x in range(buckets) if ci[x] < ci[x + 1] or cp[x] < cp[x + 1]]
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array(used, pa.int32()),
            "ik": pa.array([A.pack_sorted(ki[ci[x] : ci[x + 1]]) for x in used], pa.binary()),
            "ih": pa.array([hi[ci[x] : ci[x + 1]].tobytes() for x in used], pa.binary()),
            "pk": pa.array([A.pack_sorted(kp[cp[x] : cp[x + 1]]) for x in used], pa.binary()),
            "ph": pa.array([hp[cp[x] : cp[x + 1]].tobytes() for x in used], pa.binary()),
        })

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, total = [], 0
        for batch in batches:
            for _, part in A.slices(A.as_strings(batch.column(0))):
                if got := keys_of(part):
                    held.append(got)
                    total += len(got[1][0])
                if total >= CHUNK_KEYS:
                    yield packed(held)
                    held, total = [], 0
        if held:
            yield packed(held)

    def meet(t: pa.Table) -> pa.Table:
        def col(name: str) -> list[bytes]:
            return t.column(name).to_pylist()

        release()
        ik = np.concatenate([A.unpack_sorted(x, np.uint32) for x in col("ik")])
        ih = np.concatenate([np.frombuffer(x, np.uint64) for x in col("ih")])
        pk = np.concatenate([A.unpack_sorted(x, np.uint32) for x in col("pk")])
        ph = np.concatenate([np.frombuffer(x, np.uint64) for x in col("ph")])
        ik, ih = _distinct(ik, ih)
        # probes that meet nothing go before anything is sorted
        lo = np.searchsorted(ik, pk)
        hit = lo < len(ik)
        hit[hit] = ik[lo[hit]] == pk[hit]
        pk, ph = _distinct(pk[hit], ph[hit])
        lo, hi = np.searchsorted(ik, pk), np.searchsorted(ik, pk, "right")
        size, found, i = hi - lo, [np.zeros((0, 2), np.uint64)], 0
        ends = np.cumsum(size)
        while i < len(pk):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 4_000_000, "right")))
            x = np.repeat(ph[i:j], size[i:j])
            y = ih[A.expand(lo[i:j], size[i:j])]
            x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
            found.append(np.unique(np.stack([x, y], 1), axis=0) if len(x) else found[0])
            i = j
        p = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": p[:, 0].astype(np.uint64).view(np.int64) if len(p) else np.zeros(0, np.int64), "b": np.ascontiguousarray(p[:, 1]).view(np.int64) if len(p) else np.zeros(0, np.int64)})

    blobs = docs.mapInArrow(emit, "bucket int, ik binary, ih binary, pk binary, ph binary")
    return blobs.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def _distinct(k: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, k))
    k, h = k[order], h[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    return k[new], h[new]


def _lines(df: DataFrame, text: str, order: str, min_chars: int) -> DataFrame:
    """A row for each line of ``min_chars`` or more: identity (h, g), place (nul, o, rh, pos) and the line."""
    t, o = F.col(f"`{text}`"), F.col(f"`{order}`")
    return (
        df.where(F.length(t) >= min_chars)
        .select(o.isNull().alias("nul"), o.alias("o"), F.xxhash64(t).alias("rh"), F.posexplode(F.split(t, "\n", -1)).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("nul", "o", "rh", "pos", F.xxhash64("line").alias("h"), F.crc32("line").alias("g"), "line")
    )


def _place() -> Column:
    return F.struct("nul", "o", "rh", "pos")


def repeated_lines(df: DataFrame, text: str = "text", order: str = "doc_id", edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Places (nul, o, rh, pos) of lines that repeat an earlier one; see line_dedup."""
    lines = _lines(df, text, order, min_chars)
    near = written(_near_pairs(df.select(F.col(f"`{text}`")), edits, min_chars), "line-pairs")
    firsts = lines.groupBy("h", "g").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
    n_near = near.count()
    later = None
    if n_near:
        ends = near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "h")
        got = lines.join(broadcast_if(ends, 32 * n_near, BROADCAST), "h", "left_semi").groupBy("h", "g").agg(F.min(_place()).alias("first"), F.min("line").alias("line"))
        got = written(got, "line-texts")
        x, y = got.select([F.col(c).alias(f"{c}1") for c in got.columns]), got.select([F.col(c).alias(f"{c}2") for c in got.columns])
        met = near.join(x, F.col("a") == F.col("h1")).join(y, F.col("b") == F.col("h2")).where(F.abs(F.length("line1") - F.length("line2")) <= edits)

        def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            release()
            for p in parts:
                yield p.loc[within(p["line1"].tolist(), p["line2"].tolist(), edits), ["h", "g"]]

        late = F.col("first1") > F.col("first2")
        later = met.select("line1", "line2", F.when(late, F.col("h1")).otherwise(F.col("h2")).alias("h"), F.when(late, F.col("g1")).otherwise(F.col("g2")).alias("g"))
        later = later.mapInPandas(verify, "h long, g long").distinct().withColumn("near", F.lit(True))
    twice = firsts.where("n > 1")
    if later is not None:
        gone = twice.join(later, ["h", "g"], "full_outer").select("h", "g", "first", "near")
    else:
        gone = twice.select("h", "g", "first", F.lit(False).alias("near"))
    gone = written(gone, "line-gone")
    size = gone.count() * 96
    places = lines.select("nul", "o", "rh", "pos", "h", "g")
    return places.join(broadcast_if(gone, size, BROADCAST), ["h", "g"]).where(F.coalesce("near", F.lit(False)) | (_place() != F.col("first"))).select("nul", "o", "rh", "pos")


def line_dedup(df: DataFrame, text: str = "text", order: str = "doc_id", edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``df`` with, in ``text``, only those lines that repeat no earlier line of the whole table.

    A line repeats another if both have ``min_chars`` characters or more and are within
    ``edits`` edits (insertions, deletions, replaced characters); earlier is by ``order``, then by
    the text's hash, then by place in the text, whether or not the earlier line stays itself.
    Null ``order`` comes last; rows equal in ``order`` and text lose the same lines. Shorter
    lines, empty ones among them, stay where they are. A document left without any line
    goes; null and empty texts stay. Other columns are as they were.
    """
    drop = repeated_lines(df, text, order, edits, min_chars).groupBy("nul", "o", "rh").agg(F.collect_set("pos").alias("drop"))
    nul, o, rh, d = fresh(df, "nul", "o", "rh", "drop")
    drop = drop.select(F.col("nul").alias(nul), F.col("o").alias(o), F.col("rh").alias(rh), F.col("drop").alias(d))
    t, k = F.col(f"`{text}`"), F.col(f"`{order}`")
    rows = df.withColumn(nul, k.isNull()).withColumn(rh, F.xxhash64(t)).alias("l")
    drop = drop.alias("r")
    joined = rows.join(drop, (F.col(f"l.{nul}") == F.col(f"r.{nul}")) & (F.col(f"l.{rh}") == F.col(f"r.{rh}")) & (F.col(f"l.`{order}`").eqNullSafe(F.col(f"r.{o}"))), "left")
    kept = F.filter(F.split(F.col(f"l.`{text}`"), "\n", -1), lambda x, i: ~F.array_contains(F.col(f"r.{d}"), i))
    new = F.when(F.col(f"r.{d}").isNull(), F.col(f"l.`{text}`")).otherwise(F.array_join(kept, "\n"))
    left = F.col(f"r.{d}").isNull() | (F.size(kept) > 0)
    return joined.where(left).select([(new.alias(c) if c == text else F.col(f"l.`{c}`")) for c in df.columns])
