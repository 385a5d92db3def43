"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of character n-grams
(n = 1 .. 3) that both contain, over the geometric mean of their numbers. Nyström features
against landmark texts make it linear; one-versus-rest kernel ridge regression is solved
on a bounded labelled sample. Scoring is one sparse-to-dense presence matrix and two
matrix products for each slice of a batch.

Scores of a text sum to 1, so they tell languages apart but not a text in none of them. That is
told by coverage: the share of a text's n-grams that are usual in its language, against a floor that
``fit`` calibrates on its rows, each left out of its own language, and each with its whole language left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .common import fresh, release

#: Labelled rows per language that the classifier is fitted on, at most.
SAMPLE_PER_LANGUAGE = 400
LANDMARKS = 96
FEATURES = 6000
#: Below this highest one-versus-rest score, under its language's floor of coverage, or without one known n-gram, a text is rejected.
MIN_SCORE = 0.35
REJECTED = "unknown"
#: An n-gram is usual in a language where this share of its rows have it.
USUAL = 0.01
#: Rows of a language that its floor may reject, and rows of languages left out that should be under it.
LOST, CAUGHT = 0.005, 0.95
#: Characters that fitting looks at together; it covers all of them.
FIT_CHARS = 400_000


@dataclass
class Model:
    labels: list[str]
    symbols: np.ndarray  # code point -> 1..254 for frequent ones, 255 for the rest, 0 for a break
    slot: np.ndarray  # 1-, 2-, 3-gram code -> feature + 1, or a number past the features for other usual n-grams, 0 for none
    landmarks: np.ndarray  # features x landmarks, presence over the root of the landmark's norm
    weights: np.ndarray  # landmarks x labels: Nyström map times ridge solution
    bias: np.ndarray
    usual: np.ndarray  # slots x labels: n-grams that are usual in a language
    floor: np.ndarray  # coverage by label under which a text is in no language

    def slots(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text number, slot) of every n-gram with a letter, n by n; whole texts."""
        raw, off = A.string_parts(texts)
        cps, coff, _ = A.codepoints(raw, off)
        code = sym = self.symbols[cps].astype(np.int32)
        row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(coff))
        for n in range(3):
            if len(sym) > n:
                code = (code[:-1] << 8) | sym[n:] if n else code
                r = row[n:]
                use = (row[: len(r)] == r) & (code > 0)  # an n-gram lies in one text
                yield r[use], self.slot[code[use]]

    def coverage(self, texts: pa.Array, label: np.ndarray) -> np.ndarray:
        """The share of each text's n-grams that are usual in its label; 0 without one."""
        have, every = np.zeros(len(texts)), np.zeros(len(texts))
        flat, names = self.usual.ravel(), len(self.labels)
        for row, slot in self.slots(texts):
            have += np.bincount(row, flat[slot.astype(np.int64) * names + label[row]], len(texts))
            every += np.bincount(row, minlength=len(texts))
        return have / np.maximum(every, 1)

    def identify(self, texts: pa.Array, min_score: float = MIN_SCORE) -> tuple[list[str], np.ndarray]:
        """Label, or REJECTED, and highest score."""
        s = self.score(texts)
        best, top = s.argmax(1), s.max(1).astype(np.float64)
        ok = (top >= min_score) & (self.coverage(texts, best) >= self.floor[best])
        return [self.labels[k] if x else REJECTED for k, x in zip(best.tolist(), ok.tolist())], top

    def presence(self, texts: pa.Array) -> np.ndarray:
        """0/1 matrix of texts and features; whole texts."""
        width = self.landmarks.shape[0] + 1
        out = np.zeros(len(texts) * width, np.uint8)
        for row, slot in self.slots(texts):
            out[row * width + np.where(slot < width, slot, 0)] = 1
        return out.reshape(len(texts), -1)[:, 1:]

    def score(self, texts: pa.Array) -> np.ndarray:
        p = self.presence(texts)
        size = np.maximum(p.sum(1, dtype=np.int32), 1)
        k = (p.astype(np.float32) @ self.landmarks) / np.sqrt(size, dtype=np.float32)[:, None]
        s = k @ self.weights + self.bias
        s[p.sum(1, dtype=np.int32) == 0] = -1
        return s


def _symbols(texts: list[str]) -> np.ndarray:
    """Lower-cased letters get symbols by frequency; everything that isn't a letter is one break."""
    cls, low = A.class_table(), A.lower_table()
    cps = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    cps = low[cps]
    cps = cps[cls[cps] == A.LETTER]
    u, c = np.unique(cps, return_counts=True)
    top = u[np.lexsort((u, -c))][:253]
    table = np.zeros(len(cls), np.uint8)
    table[cls == A.LETTER] = 255
    table[top] = np.arange(1, len(top) + 1)
    return table[low]


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, features: int = FEATURES, ridge: float = 1e-2) -> Model:
    """Fit on the given rows, all of them and whole. Needs one row at least."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    col = A.as_strings(pa.array(texts, pa.string()))
    m = Model(names, _symbols(texts), np.zeros(1 << 24, np.uint16), np.zeros((0, 0), np.float32), None, None, None, None)
    # n-grams by document frequency, those that tell languages apart first
    seen = []
    for lo, part in A.slices(col, FIT_CHARS):
        raw, off = A.string_parts(part)
        cps, coff, _ = A.codepoints(raw, off)
        code = sym = m.symbols[cps].astype(np.int64)
        row = np.repeat(np.arange(lo, lo + len(part)), np.diff(coff))
        for n in range(3):
            if n:
                code = (code[:-1] << 8) | sym[n:]
            ok = row[: len(code)] == row[n:] if n else np.ones(len(code), bool)
            seen.append(np.unique((code[ok] << 24) | row[n:][ok], return_counts=True))
    pairs, inv = np.unique(np.concatenate([x for x, _ in seen]), return_inverse=True)
    times = np.bincount(inv, np.concatenate([x for _, x in seen]), len(pairs))
    code, row = pairs >> 24, pairs & 0xFFFFFF
    u, inv = np.unique(code, return_inverse=True)
    by = np.zeros((len(u), len(names)))
    np.add.at(by, (inv, y[row]), 1)
    rate = by / np.maximum(np.bincount(y, minlength=len(names)), 1)
    spread = rate.max(1) - rate.min(1) if len(names) > 1 else rate.max(1)
    keep = u[np.lexsort((u, -spread))][: min(features, 65_000)]
    keep = keep[keep > 0]
    count = np.bincount(y, minlength=len(names))
    least = np.maximum(np.ceil(USUAL * count), 1)
    more = np.setdiff1d(u[(by >= least).any(1)], np.append(keep, 0))
    if len(keep) + len(more) > 0xFFFF:
        m.slot = m.slot.astype(np.uint32)
    m.slot[np.append(keep, more)] = np.arange(1, len(keep) + len(more) + 1)
    m.usual = np.zeros((len(keep) + len(more) + 1, len(names)), np.uint8)
    m.usual[m.slot[u]] = by >= least
    m.usual[0] = 0
    m.floor = _floor(inv[code > 0], row[code > 0], times[code > 0], by, least, y)
    m.landmarks = np.zeros((len(keep), 0), np.float32)
    p = np.concatenate([m.presence(A.as_strings(part)) for _, part in A.slices(col, FIT_CHARS)]).astype(np.float32)
    size = np.maximum(p.sum(1), 1)
    # landmarks: in turn of the languages, in the given order
    turn = np.argsort(np.array([np.sum(y[:i] == y[i]) for i in range(len(y))]), kind="stable")[:landmarks]
    land = p[turn] / np.sqrt(size[turn])[:, None]
    k = p @ land.T / np.sqrt(size)[:, None]
    kmm = k[turn].astype(np.float64)
    w, v = np.linalg.eigh((kmm + kmm.T) / 2)
    good = w > 1e-6 * max(w.max(), 1e-12)
    nystrom = v[:, good] / np.sqrt(w[good])
    z = k.astype(np.float64) @ nystrom
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, 0.0)
    mean_z, mean_t = z.mean(0), target.mean(0)
    a = (z - mean_z).T @ (z - mean_z) + ridge * len(z) / 10 * np.eye(z.shape[1])
    sol = np.linalg.solve(a, (z - mean_z).T @ (target - mean_t))
    m.landmarks = np.ascontiguousarray(land.T)
    m.weights = (nystrom @ sol).astype(np.float32)
    m.bias = (mean_t - mean_z @ sol).astype(np.float32)
    return m


def _floor(gram: np.ndarray, row: np.ndarray, times: np.ndarray, by: np.ndarray, least: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least coverage by label, from how often (``times``) each row has each n-gram.

    Between what rows reach in their own language without themselves and what they reach in another
    one; where these overlap, as low as loses LOST of the own ones. No floor for a language with one row.
    """
    n, names = len(y), by.shape[1]
    every = np.maximum(np.bincount(row, times, n), 1)
    reach = np.stack([np.bincount(row, times * (by[gram, k] - (y[row] == k) >= least[k]), n) / every for k in range(names)], 1)
    own = reach[np.arange(n), y]
    reach[np.arange(n), y] = -1
    other, most = reach.argmax(1), reach.max(1)  # with its language left out
    floor = np.zeros(names)
    for k in range(names):
        if (y == k).sum() > 1:
            floor[k] = low = np.quantile(own[y == k], LOST, method="lower")
            strange = most[(other == k) & (most >= 0)]
            if len(strange):
                floor[k] = min(low, (low + np.quantile(strange, CAUGHT)) / 2)
    return floor


def labelled_sample(df: DataFrame, text: str, label: str, key: str, per_label: int) -> tuple[list[str], list[str]]:
    """About ``per_label`` rows of each label, the same ones every time.

    A row is taken by its key's hash against a rate from the label's count, so what reaches
    the driver is bounded whatever the table's size.
    """
    t, l = F.col(f"`{text}`"), F.col(f"`{label}`")
    rows = df.where(t.isNotNull() & l.isNotNull() & (F.length(t) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy(l.cast("string").alias("l")).count().collect()}
    if not counts:
        return [], []
    u = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(17)), F.lit(1_000_000_007)) / 1_000_000_007.0
    rate = F.create_map([F.lit(x) for k, c in counts.items() for x in (k, min(1.0, per_label / c))])
    got = rows.where(u < F.element_at(rate, l.cast("string"))).select(u.alias("u"), t.alias("t"), l.cast("string").alias("l")).collect()
    got.sort(key=lambda r: (r.u, r.t, r.l))
    return [r.t for r in got], [r.l for r in got]


def train(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    texts, labels = labelled_sample(df, text, label, key, per_label)
    return fit(texts, labels) if texts else None


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, pred: str = "lang_pred", score: str = "lang_score", min_score: float = MIN_SCORE) -> DataFrame:
    """The columns ``keep`` (default: all) with the language and its score for every row.

    A text is rejected, with language "unknown", when its highest score is under ``min_score``
    or less of it is usual in its language than in texts of that language, or it has no known n-gram (empty texts, signs only), or when there is no model because no
    row was labelled; its score stays. A null text has null in both. Ties go to the label first in
    the alphabet. Kept columns named like a result are replaced.
    """
    names = [c for c in (keep if keep is not None else df.columns) if c.lower() not in (pred.lower(), score.lower())]
    t = fresh(df, "text_of")[0]
    src = df.select([df[f"`{c}`"] for c in names] + [df[f"`{text}`"].alias(t)])
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = src.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES and LANDMARKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = shared.value
        for b in batches:
            col = b.column(len(names))
            texts = A.as_strings(col)
            best, top = [], []
            for lo, part in A.slices(texts):
                for i in range(0, len(part), 512):
                    if m is None:
                        best += [REJECTED] * len(part.slice(i, 512))
                        top.append(np.full(len(part.slice(i, 512)), -1.0))
                        continue
                    found, high = m.identify(A.as_strings(part.slice(i, 512)), min_score)
                    best += found
                    top.append(high)
            null = np.asarray(col.is_null())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(best, pa.string(), mask=null), pa.array(np.concatenate(top) if top else np.zeros(0), mask=null)], names=schema.names)

    return src.mapInArrow(run, schema)
