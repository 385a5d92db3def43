"""N-gram Jaccard join: an exact metric-space join over documents' word n-gram sets.

1. *Counting.* Distinct n-grams travel once, packed by hash bucket and chunk; what comes
   back to a chunk are the n-grams that two documents or more have. Only these can be in an
   intersection, so they are all that is kept of a document. Equal sets are one point.
2. *Regions.* Unrelated documents are at Jaccard distance 1 from each other and from any
   pivot, so no pivot tells them apart; regions are found through the rarest n-grams: with
   n-grams ordered by document count, two documents within the threshold share one of their first
   ``n - ceil(t n) + 1`` n-grams (and ``l`` of their first ``n - ceil(t n) + l``, so that who has
   fewer with a count of two is out). For each such n-gram the first point that has it is the
   region's pivot, and every point is replicated to the regions of all pivots it meets so. A
   region of very many points is divided into pairs of blocks, a task each.
3. *Recursion.* Inside a region, points within a radius of their nearest pivot make its Voronoi
   cell; the triangle inequality gives the window (the cell's own radius + 1 - t) in which points
   of later cells are replicated to it, and each cell is joined the same way with a smaller
   radius. Points near no pivot are joined around pivots of their own, as long as these gather any. In the smallest cells the
   sums of two distances to the pivot settle most pairs unseen: up to 1 - t they are links. Only
   the rest are verified, by set intersections as matrix products.

A pair meets in each region that has both; it counts in the first one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .common import broadcast_if, fresh, n_buckets, picked, release, written

NGRAM = 5
THRESHOLD = 0.5
#: Bits of an n-gram's hash: two n-grams of two given documents fall together with a chance of about 1e-9.
HASH_BITS = 48
#: Partners share this many of their first n-grams, or as many as their sizes ask for; the first ones are so many more.
SHARED = 8
#: Documents of a cell that are joined at once.
LEAF = 512
#: N-grams that one chunk counts together.
CHUNK_GRAMS = 4_000_000
#: What documents with the same set have in common.
SAME = ["d1", "d2", "size"]
#: Radii of the cells of each recursion, as parts of 1 - t. In a cell of half of it all pairs are links.
RADII = (0.8, 0.5)
#: Points of a region that are joined in one task; larger regions are divided into pairs of blocks.
BLOCK = 16_384
#: Sides of joins up to this size are broadcast.
BROADCAST = 8 << 20


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram hash), sorted and distinct. ``texts``: from as_strings.

    Words are lower-cased runs of letters and digits; a text with fewer than ``n`` words has
    them all as its one n-gram, a text without words has none.
    """
    raw, off = A.string_parts(texts)
    cps, coff, _ = A.codepoints(raw, off)
    if not len(cps):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s, e, row = A.words(cps, coff)
    word = A.SpanHash(A.lower_table()[cps])(s, e)
    at = A.cuts(row, len(texts))
    size = np.diff(at)
    start = A.expand(at[:-1], np.where(size >= n, size - n + 1, (size > 0).astype(np.int64)))
    end = np.minimum(start + n, at[row[start] + 1])
    h = A.SpanHash(word)(start, end) >> np.uint64(64 - HASH_BITS)
    doc = row[start]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def need(size: np.ndarray, t: float) -> np.ndarray:
    """n-grams that a partner must share: ceil(t * size)."""
    return np.ceil(t * size - 1e-9).astype(np.int64)


def shared_least(size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """How much longer than by one n-gram's need a signature is made, and how many of its n-grams any partner shares.

    Sets that share o n-grams share l of their first n - o + l. A partner of n n-grams has t n or
    more, so its own l is known to be as large as that size gives.
    """
    give = lambda n: np.clip(np.ceil(t * t * n - 1e-9), 1, SHARED).astype(np.int64)
    return give(size), give(np.ceil(t * size - 1e-9))


def _squeeze(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def _loose(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def _documents(docs: DataFrame, n: int, t: float) -> DataFrame:
    """A row for each document: node, id, size (0 without words), digest, shared n-grams and signature.

    ``grams`` (sorted 64-bit hashes of n-grams that others have too) and ``sig`` (those of them
    among the first by document count) are null where no partner is possible.
    """
    buckets = n_buckets(docs, 1.5)
    id_type = docs.schema["id"].dataType
    blob_schema = T.StructType([
        T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("info", T.BinaryType()), T.StructField("keys", T.BinaryType()), T.StructField("docs", T.BinaryType()), T.StructField("df", T.BinaryType()),
    ])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        arrow_ids = None

        def flush() -> pa.RecordBatch:
            nonlocal number
            chunk = (part << 17) | number
            number += 1
            doc, h = np.concatenate([d for d, _ in held]), np.concatenate([x for _, x in held])
            size = np.bincount(doc, minlength=len(ids))
            begin = np.cumsum(size) - size
            some = np.flatnonzero(size)
            d1, d2 = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
            if len(some):
                d1[some] = np.add.reduceat(A.mix(h), begin[some])
                d2[some] = np.add.reduceat(A.mix(h ^ np.uint64(0x5DEECE66D5DEECE6)), begin[some])
            info = b"".join([size.astype(np.int64).tobytes(), d1.tobytes(), d2.tobytes()])
            b = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((h, b))
            h, doc, at = h[order], doc[order].astype(np.uint32), A.cuts(b[order], buckets)
            used = [x for x in range(buckets) if at[x] < at[x + 1]]
            rows = [(x, chunk, None, None, _squeeze(A.pack_sorted(h[at[x] : at[x + 1]])), _squeeze(A.pack(doc[at[x] : at[x + 1]])), None) for x in used]
            rows.append((chunk % buckets, chunk, ids, info, None, None, None))
            types = [pa.int32(), pa.int64(), pa.list_(arrow_ids), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), types)], names=blob_schema.names)

        total = 0
        for batch in batches:
            arrow_ids = batch.column(0).type
            for lo, piece in A.slices(A.as_strings(batch.column(1))):
                doc, h = gram_sets(piece, n)
                held.append((doc + len(ids), h))
                ids += batch.column(0).slice(lo, len(piece)).to_pylist()
                total += len(h)
                if total >= CHUNK_GRAMS or len(ids) > 900_000:
                    yield flush()
                    ids, held, total = [], [], 0
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        release()
        rows = table.to_pylist()
        grams = [r for r in rows if r["keys"] is not None]
        out = [r for r in rows if r["keys"] is None]
        keys = [A.unpack_sorted(_loose(r["keys"]), np.uint64) for r in grams]
        if keys:
            every = np.concatenate(keys)
            every.sort()
            new = np.ones(len(every), bool)
            new[1:] = every[1:] != every[:-1]
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(every)))
            twice = every[first[times > 1]]
            times = np.minimum(times[times > 1], 0xFFFFFFFF).astype(np.uint32)
            for r, k in zip(grams, keys):
                at = np.minimum(np.searchsorted(twice, k), max(len(twice) - 1, 0))
                hit = twice[at] == k if len(twice) else np.zeros(len(k), bool)
                if hit.any():
                    doc = A.unpack(_loose(r["docs"]), np.uint32)[hit]
                    out.append(r | {"keys": _squeeze(A.pack_sorted(k[hit])), "docs": _squeeze(A.pack(doc)), "df": _squeeze(A.pack(times[at[hit]]))})
        return pa.Table.from_pylist(out, schema=table.schema)

    doc_schema = T.StructType([
        T.StructField("node", T.LongType()), T.StructField("id", id_type), T.StructField("size", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
        T.StructField("grams", T.BinaryType()), T.StructField("sig", T.ArrayType(T.LongType())),
    ])

    def gather(table: pa.Table) -> pa.Table:
        release()
        rows = table.to_pylist()
        head = next(r for r in rows if r["info"] is not None)
        ids, m = head["ids"], len(head["ids"])
        info = np.frombuffer(head["info"], np.int64).reshape(3, m)
        size = info[0]
        posts = [r for r in rows if r["keys"] is not None]
        none = np.zeros(0, np.uint64)
        h = np.concatenate([none] + [A.unpack_sorted(_loose(r["keys"]), np.uint64) for r in posts])
        doc = np.concatenate([none.astype(np.uint32)] + [A.unpack(_loose(r["docs"]), np.uint32) for r in posts])
        df = np.concatenate([none.astype(np.uint32)] + [A.unpack(_loose(r["df"]), np.uint32) for r in posts])
        order = np.lexsort((h, df, doc))
        h, doc = h[order], doc[order]
        at = A.cuts(doc, m)
        own = size - np.diff(at)  # n-grams of this document alone come first
        longer, least = shared_least(size, t)
        take = np.clip(size - need(size, t) + longer - own, 0, np.diff(at))
        take[take < least] = 0
        grams = [np.sort(h[at[i] : at[i + 1]]).tobytes() if take[i] else None for i in range(m)]
        sig = [h[at[i] : at[i] + take[i]].view(np.int64) if take[i] else None for i in range(m)]
        return pa.table([
            pa.array((head["chunk"] << 20) + np.arange(m)), pa.array(ids, table.schema.field("ids").type.value_type), pa.array(size), pa.array(info[1]), pa.array(info[2]),
            pa.array(grams, pa.binary()), pa.array(sig, pa.list_(pa.int64())),
        ], names=doc_schema.names)

    shared = docs.mapInArrow(emit, blob_schema).groupBy("bucket").applyInArrow(count, blob_schema)
    return shared.groupBy("chunk").applyInArrow(gather, doc_schema)


class Region:
    """The exact join of one region's documents."""

    def __init__(self, size: np.ndarray, sets: list[np.ndarray], t: float):
        self.size, self.t = size.astype(np.int64), t
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, code, times = np.unique(every, return_inverse=True, return_counts=True)
        shared = times[code] > 1  # n-grams of one document here are in no intersection
        lens = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), lens)[shared]
        number = np.cumsum(times > 1) - 1
        self.code, self.at = number[code[shared]], A.cuts(owner, len(sets))
        self.width = int((times > 1).sum())

    def inter(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of intersections of the documents a and b, as matrix products over blocks of n-grams."""
        out = np.zeros((len(a), len(b)), np.float32)
        ca, ra = self._rows(a)
        cb, rb = self._rows(b)
        use = np.intersect1d(ca, cb)
        ca, ra = self._only(ca, ra, use)
        cb, rb = self._only(cb, rb, use)
        step = max(1, min(len(use), 16_000_000 // max(1, len(a) + len(b))))
        oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
        ca, ra, cb, rb = ca[oa], ra[oa], cb[ob], rb[ob]
        for lo in range(0, len(use), step):
            x, y = (self._dense(c, r, k, lo, step) for c, r, k in ((ca, ra, len(a)), (cb, rb, len(b))))
            out += x @ y.T
        return out

    def _rows(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.at[docs + 1] - self.at[docs]
        return self.code[A.expand(self.at[docs], lens)], np.repeat(np.arange(len(docs)), lens)

    @staticmethod
    def _only(c: np.ndarray, r: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(use, c), max(len(use) - 1, 0))
        ok = use[at] == c if len(use) else np.zeros(len(c), bool)
        return at[ok], r[ok]

    @staticmethod
    def _dense(c: np.ndarray, r: np.ndarray, rows: int, lo: int, step: int) -> np.ndarray:
        i, j = np.searchsorted(c, (lo, lo + step))
        m = np.zeros((rows, step), np.float32)
        m[r[i:j], c[i:j] - lo] = 1
        return m

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = self.inter(a, b).astype(np.float64)
        d = 1 - x / (self.size[a][:, None] + self.size[b][None, :] - x)
        d[a[:, None] == b[None, :]] = 0  # n-grams of one document alone aren't in its set here
        return d

    def blocks(self, docs: np.ndarray, others: np.ndarray, within: bool, out: Found) -> None:
        """Pairs of docs and others, and within docs, by blocks in order of size; blocks whose sizes are too far apart are left out."""
        t, by_size = self.t, lambda x: x[np.argsort(self.size[x], kind="stable")]
        docs = by_size(docs)
        sides = [(docs, True)] * within + [(by_size(others), False)]
        for i in range(0, len(docs), LEAF):
            a = docs[i : i + LEAF]
            for side, own in sides:
                for j in range(i if own else 0, len(side), LEAF):
                    b = side[j : j + LEAF]
                    if self.size[a[-1]] < t * self.size[b[0]] - 1e-9:
                        break
                    if self.size[b[-1]] >= t * self.size[a[0]] - 1e-9:
                        self.verify(a, b, None, own and i == j, out)

    def verify(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray | None, half: bool, out: Found) -> None:
        """Pairs of a and b within the threshold; of b[k], only those from a[begin[k]] on. ``half``: a is b, each pair once."""
        x = self.inter(a, b)
        p, q = np.nonzero(x >= np.float32(self.t / (1 + self.t)) * (self.size[a][:, None] + self.size[b][None, :]).astype(np.float32) - np.float32(0.01))
        ok = p < q if half else p >= begin[q] if begin is not None else np.ones(len(p), bool)
        p, q = p[ok], q[ok]
        both = x[p, q].astype(np.float64)
        j = both / (self.size[a[p]] + self.size[b[q]] - both)
        ok = j >= self.t - 1e-12
        out.pairs(a[p[ok]], b[q[ok]], j[ok])

    def divide(self, docs: np.ndarray, others: np.ndarray, within: bool, out: Found, level: int = 0) -> None:
        """All links of docs and others, and within docs, by Voronoi cells of pivots among docs."""
        if not len(docs) or not (within or len(others)):
            return
        if len(docs) + len(others) <= LEAF:
            return self.blocks(docs, others, within, out)
        eps, last = 1 - self.t, level == len(RADII) - 1
        radius = RADII[level] * eps - 1e-9
        while len(docs):
            k = min(64, 2 + len(docs) // LEAF, len(docs))
            every = np.concatenate([docs, others])
            d = self.distance(every, docs[(np.arange(k) * len(docs)) // k])
            home = d[: len(docs)].argmin(1)
            near = d[np.arange(len(docs)), home]
            far = near > radius
            home[far] = k
            for j in np.unique(home[~far]).tolist():
                inner = np.flatnonzero(home == j)
                rest = np.arange(len(docs), len(every))
                if within:  # a pair of two cells is found in the first
                    rest = np.concatenate([np.flatnonzero(home > j), rest])
                outer = rest[d[rest, j] <= near[inner].max() + eps + 1e-9]
                out.cells += 1
                if last or len(inner) == 1:
                    inner = inner[np.argsort(near[inner], kind="stable")]
                    self.cell(every[inner], near[inner], every[outer], d[outer, j], within, out)
                else:
                    self.divide(every[inner], every[outer], within, out, level + 1)
            docs = docs[far]
            if (~far).sum() <= k + k // 4:  # pivots have hardly any points near them
                return self.blocks(docs, others, within, out)

    def cell(self, inner: np.ndarray, d: np.ndarray, outer: np.ndarray, e: np.ndarray, within: bool, out: Found) -> None:
        """Links of a cell of half the reach. ``d``, ``e``: distances to the pivot, d rising."""
        eps = 1 - self.t
        begin = np.searchsorted(d, e - eps - 1e-9)  # nearer ones are too far from these
        if out.bulk:
            if within:
                out.clique(inner)
            sure = np.searchsorted(d, eps - e - 1e-9, "right")
            out.star(inner, outer, sure)
            begin = np.maximum(begin, sure)
        elif within:
            self.blocks(inner, inner[:0], True, out)
        some = np.flatnonzero(begin < len(inner))
        some = some[np.argsort(begin[some], kind="stable")]
        for j in range(0, len(some), LEAF):
            part = some[j : j + LEAF]
            for i in range(int(begin[part[0]]), len(inner), LEAF):
                self.verify(inner[i : i + LEAF], outer[part], begin[part] - i, False, out)


class Found:
    """What a join has found: links by point (each counts the other's ``weight``), and edges that connect the same points.

    ``bulk`` allows pairs to be counted without being named; otherwise ``named`` has each (a, b, jaccard).
    """

    def __init__(self, weight: np.ndarray, bulk: bool = True):
        self.weight, self.bulk, self.cells = weight.astype(np.float64), bulk, 0
        self.links = np.zeros(len(weight))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.named: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def pairs(self, a: np.ndarray, b: np.ndarray, j: np.ndarray) -> None:
        if not self.bulk:
            self.named.append((a, b, j))
        else:
            self.add(a, b)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.links += np.bincount(a, self.weight[b], len(self.links)) + np.bincount(b, self.weight[a], len(self.links))
        self.edges.append((a, b))

    def clique(self, docs: np.ndarray) -> None:
        self.links[docs] += self.weight[docs].sum() - self.weight[docs]
        self.edges.append((np.repeat(docs[:1], len(docs) - 1), docs[1:]))

    def star(self, inner: np.ndarray, outer: np.ndarray, sure: np.ndarray) -> None:
        """outer[k] is linked to inner[: sure[k]]."""
        total = np.append(0, np.cumsum(self.weight[inner]))
        self.links[outer] += total[sure]
        by = np.bincount(sure, self.weight[outer], len(inner) + 1)
        self.links[inner] += by[::-1].cumsum()[::-1][1:]
        some = outer[sure > 0]
        if len(some):
            # without a clique (within False) inner's points are connected through one outer point
            most = int(sure.max())
            self.edges.append((np.repeat(inner[:1], len(some)), some))
            self.edges.append((np.repeat(outer[sure.argmax()], most), inner[:most]))

    def named_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate([x[i] for x in self.named]) for i in range(3))

    def roots(self, order: np.ndarray) -> np.ndarray:
        """For each point the connected one of lowest ``order``."""
        rank = np.empty(len(order), np.int64)
        by = np.argsort(order, kind="stable")
        rank[by] = np.arange(len(order))
        root = np.arange(len(order))
        a = rank[np.concatenate([x for x, _ in self.edges])] if self.edges else root[:0]
        b = rank[np.concatenate([x for _, x in self.edges])] if self.edges else root[:0]
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                return by[root[rank]]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]


def whole_regions(batches: Iterator[pa.RecordBatch], grams: int = 2_000_000) -> Iterator[pa.Table]:
    """Runs of rows that hold whole regions, of about ``grams`` n-grams; rows come sorted by pivot and part."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        pivot, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ends = np.append(np.flatnonzero((pivot[1:] != pivot[:-1]) | (part[1:] != part[:-1])) + 1, len(pivot))
        weight = np.append(0, np.cumsum(batch.column("size").to_numpy()))
        lo = 0
        if held and size >= grams and len(pivot) and (pivot[0], part[0]) != last:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        for e in ends[:-1].tolist():  # the last region of a batch may go on in the next one
            if size + weight[e] - weight[lo] >= grams:
                held.append(batch.slice(lo, e - lo))
                yield pa.Table.from_batches(held)
                held, size, lo = [], 0, e
        if lo < len(pivot):
            held.append(batch.slice(lo))
            size, last = size + int(weight[-1] - weight[lo]), (pivot[-1], part[-1])
    if held:
        yield pa.Table.from_batches(held)


@dataclass
class Rows:
    """Points of whole regions, region by region."""

    region: np.ndarray  # a number for each region or part of one, rising
    pivot: np.ndarray
    side: np.ndarray  # of a part between two blocks: 1 and 2; else 0
    node: np.ndarray
    size: np.ndarray
    weight: np.ndarray
    sets: list[np.ndarray]
    pivots: list[np.ndarray]  # of all of a point's regions, rising

    @classmethod
    def of(cls, t: pa.Table) -> Rows:
        pivot, part, side, node, size, weight = (t.column(c).to_numpy() for c in ("pivot", "part", "side", "node", "size", "copies"))
        new = (pivot[1:] != pivot[:-1]) | (part[1:] != part[:-1])
        lists = t.column("pivots").combine_chunks()
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        return cls(np.append(0, np.cumsum(new))[: len(pivot)], pivot, side, node, size.astype(np.int64), weight, [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()], [values[x:y] for x, y in zip(at[:-1], at[1:])])

    def here(self, a: np.ndarray, b: np.ndarray, native: np.ndarray) -> np.ndarray:
        """Whether pairs of rows of a region have no earlier region in common."""
        ok = native[a] | native[b]
        for i in np.flatnonzero(~ok).tolist():
            x, y = (self.pivots[k][self.pivots[k] < self.pivot[k]] for k in (a[i], b[i]))
            ok[i] = x[0] != y[0] and not len(np.intersect1d(x, y))
        return ok


def join_rows(rows: Rows, t: float, bulk: bool = True, small: int = 12) -> Found:
    """What the regions of ``rows`` find. Regions of up to ``small`` points are joined together, by counting
    how often two of a region's points meet at an n-gram; larger ones one by one."""
    n = len(rows.node)
    out = Found(rows.weight, bulk)
    native = np.array([x[0] for x in rows.pivots], np.int64) == rows.pivot if n else np.zeros(0, bool)
    begin = np.flatnonzero(np.append(True, rows.region[1:] != rows.region[:-1])) if n else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, n))
    for lo, k in zip(begin[count > small].tolist(), count[count > small].tolist()):
        _join_region(rows, lo, lo + k, native, t, out)
    few = A.expand(begin[count <= small], count[count <= small])
    if len(few):
        region = rows.region[few]
        lens = np.array([len(rows.sets[i]) for i in few.tolist()])
        doc, gram = np.repeat(few, lens), np.concatenate([rows.sets[i] for i in few.tolist()])
        key = A.mix(gram ^ A.mix(np.repeat(region, lens).astype(np.uint64)))
        order = np.argsort(key, kind="stable")  # in a group, documents stay in order
        key, doc = key[order], doc[order]
        pairs, by = [], 1
        at = np.arange(len(key))
        while len(at):
            at = at[at + by < len(key)]
            at = at[key[at] == key[at + by]]
            pairs.append(doc[at] * n + doc[at + by])
            by += 1
        u, inter = np.unique(np.concatenate(pairs), return_counts=True)
        a, b = u // n, u % n
        j = inter / (rows.size[a] + rows.size[b] - inter)
        ok = (j >= t - 1e-12) & ((rows.side[a] != rows.side[b]) | (rows.side[a] == 0))
        a, b, j = a[ok], b[ok], j[ok]
        ok = rows.here(a, b, native)
        out.pairs(a[ok], b[ok], j[ok])
    return out


def _join_region(rows: Rows, lo: int, hi: int, native: np.ndarray, t: float, out: Found) -> None:
    region = Region(rows.size[lo:hi], rows.sets[lo:hi], t)
    one, within = rows.side[lo:hi] < 2, rows.side[lo] == 0
    own, foreign = np.flatnonzero(one & native[lo:hi]), np.flatnonzero(one & ~native[lo:hi])
    second = np.flatnonzero(~one)
    found = Found(rows.weight[lo:hi], out.bulk)
    # a pair with a native of this region has no earlier one
    if within:
        region.divide(own, foreign, True, found)
    else:
        region.divide(own, second, False, found)
        region.divide(foreign, second[native[lo:hi][second]], False, found)
        second = second[~native[lo:hi][second]]
    if len({int(rows.pivots[lo + i][0]) for i in (*foreign.tolist(), *second.tolist())}) > 1:
        some = Found(rows.weight[lo:hi], False)
        region.divide(foreign, second, bool(within), some)
        a, b, j = some.named_pairs()
        ok = rows.here(a + lo, b + lo, native)
        found.pairs(a[ok], b[ok], j[ok])
        out.cells += some.cells
    out.cells += found.cells
    out.links[lo:hi] += found.links
    out.edges += [(a + lo, b + lo) for a, b in found.edges]
    out.named += [(a + lo, b + lo, j) for a, b, j in found.named]


def _points(df: DataFrame, text: str, key: str, n: int, t: float) -> tuple[DataFrame, DataFrame]:
    """All documents, and the points that stand for those with the same set."""
    docs = picked(df, id=key, text=text)
    every = written(_documents(docs, n, t), "jaccard-documents")
    some = every.where("size > 0 and id is not null")
    points = some.groupBy(SAME).agg(F.min(F.struct("id", "node")).alias("first"), F.count("*").alias("copies"))
    return every, written(points.select(*SAME, "first.id", "first.node", "copies"), "jaccard-points")


def _regions(every: DataFrame, points: DataFrame, run: Callable[[Rows], pa.RecordBatch], schema: str, buckets: int) -> DataFrame:
    """What ``run`` makes of each region's points."""
    single = every.where("sig is not null").join(points.select("node", "copies"), "node")
    single = written(single.select("node", "size", "copies", "grams", "sig"), "jaccard-sets")
    met = single.select("node", F.explode("sig").alias("g"))
    first = met.groupBy("g").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1").select("g", "pivot")
    members = met.join(first, "g").groupBy("node").agg(F.array_sort(F.collect_set("pivot")).alias("pivots"))
    members = written(members, "jaccard-members").select("node", "pivots", F.explode("pivots").alias("pivot"))
    large = written(members.groupBy("pivot").count().where(F.col("count") > BLOCK).select("pivot", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "jaccard-large")
    members = members.join(broadcast_if(large, large.count() * 32, BROADCAST), "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # blocks i <= j of a region meet in part i * blocks + j
    i = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")
    members = members.withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("pivot", (F.least("i", "j") * F.col("blocks") + F.greatest("i", "j")).alias("part"), F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).alias("side"), "node", "pivots")
    rows = members.join(single.drop("sig"), "node").select("pivot", "part", "side", "node", "size", "copies", "grams", "pivots")

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in whole_regions(batches):
            yield run(Rows.of(table))

    return rows.repartition(buckets, "pivot", "part").sortWithinPartitions("pivot", "part").mapInArrow(regions, schema)


def jaccard_join(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = NGRAM, t: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_a, doc_b, jaccard) of documents whose word n-gram sets have a Jaccard index of ``t`` or more, folded.

    Documents with the same set are one point of the metric space: the one with the lowest
    key stands for it, and the others are paired with that one, at 1.0. Of different sets, every
    pair within the threshold is there, as a pair of such documents; so all pairs follow, and
    groups of copies stay linear in size. doc_a < doc_b. Rows with a null key or without a word (null and
    empty texts) take no part; a key that stands twice is never paired with itself. Whole
    texts count; other columns are not read.
    """
    every, points = _points(df, text, key, n, t)

    def run(rows: Rows) -> pa.RecordBatch:
        a, b, j = join_rows(rows, t, bulk=False).named_pairs()
        return pa.RecordBatch.from_arrays([pa.array(rows.node[a]), pa.array(rows.node[b]), pa.array(j, pa.float64())], names=["a", "b", "jaccard"])

    near = _regions(every, points, run, "a long, b long, jaccard double", n_buckets(picked(df, text=text)))
    for side in ("a", "b"):
        near = near.join(points.select(F.col("node").alias(side), F.col("id").alias(f"id_{side}")), side)
    near = near.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b"), "jaccard")
    copies = every.where("id is not null").select("id", *SAME).join(points.select(F.col("id").alias("doc_a"), *SAME), SAME)
    copies = copies.where("id > doc_a").select("doc_a", F.col("id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    # keys that stand twice may give a pair with two values
    return near.unionByName(copies).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = NGRAM, t: float = THRESHOLD) -> DataFrame:
    """A row (key, class_id, links) for each document: the join of ``jaccard_join`` counted, not listed.

    ``links`` is the number of other documents whose word n-gram sets have a Jaccard index of ``t`` or
    more with the document's, copies and near documents, each counted once. ``class_id`` is the lowest key among all documents that
    links connect with it, directly or through others; without a link, its own key. Rows with a null
    key or without a word (null and empty texts) take no part: no links, their own key. Rows that share a key
    count one by one. Whole texts; other columns are not read. As rows, groups of any size are linear.
    """
    every, points = _points(df, text, key, n, t)

    def run(rows: Rows) -> pa.RecordBatch:
        found = join_rows(rows, t)
        some = np.flatnonzero(found.links)
        root = rows.node[found.roots(rows.node)]
        return pa.RecordBatch.from_arrays([pa.array(rows.node[some]), pa.array(found.links[some].astype(np.int64)), pa.array(root[some])], names=["node", "links", "root"])

    near = written(_regions(every, points, run, "node long, links long, root long", n_buckets(picked(df, text=text))), "jaccard-links")
    links = near.groupBy("node").agg(F.sum("links").alias("near"))
    root = components(near.select(F.col("node").alias("doc_a"), F.col("root").alias("doc_b")))
    named = points.select("id", "node", *SAME, "copies").join(links, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "jaccard-classes")
    lowest = named.where("near is not null").groupBy("root").agg(F.min("id").alias("lowest"))
    named = named.join(lowest, "root", "left").select(*SAME, F.coalesce("lowest", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    one = every.where("size > 0 and id is not null").join(named, SAME).select("id", "class_id", "links")
    rest = every.where("size = 0 or id is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return one.unionByName(rest).withColumnRenamed("id", key)


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the lowest key of each node's connected group, by alternating large and small stars.

    Every round is one table in the shared folder; edges never grow in number.
    """
    e = pairs.select(F.least("doc_a", "doc_b").alias("v"), F.greatest("doc_a", "doc_b").alias("u")).where("u <> v").distinct()
    e = written(e, "stars")
    mark = None
    while True:
        # lowest neighbours are aggregated and joined, as a window would hold a whole star in one task
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        e = written(small, "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def near_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", n: int = NGRAM, t: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, all columns, without those that jaccard_join links to a lower key, directly or through others.

    Rows with a null key or without a word stay; rows that share a key stay or go together.
    """
    node = fresh(df, "node")[0]
    gone = classes(df, text, key, n, t).where(F.col("class_id") < F.col(f"`{key}`")).select(F.col(f"`{key}`").alias(node))
    return df.join(gone, F.col(f"`{key}`") == F.col(node), "left_anti")
