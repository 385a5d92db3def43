import random
import re

import numpy as np
import pytest

from siftwell.llm import jaccard as J
from siftwell.llm.queries import op1_ngram_jaccard

SCHEMA = "doc_id long, text string, grams string, node string, id string"


def grams(t, n):
    w = [x.lower() for x in re.findall(r"[^\W_]+", t)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n, t):
    """All pairs within the threshold, closed under documents with the same set."""
    g = {d: grams(x, n) for d, x in rows if d is not None and x and grams(x, n)}
    return {(a, b): len(g[a] & g[b]) / len(g[a] | g[b]) for a in g for b in g if a < b and len(g[a] & g[b]) >= t * len(g[a] | g[b]) - 1e-12}


def expanded(pairs):
    """All pairs that the result stands for."""
    first = {b: a for a, b, j in pairs if j == 1.0}
    group = {}
    for b, a in first.items():
        group.setdefault(a, [a]).append(b)
    out = {}
    for a, m in group.items():
        out |= {(x, y): 1.0 for x in m for y in m if x < y}
    for a, b, j in pairs:
        if j < 1.0:
            out |= {(min(x, y), max(x, y)): j for x in group.get(a, [a]) for y in group.get(b, [b])}
    return out


def corpus(seed, groups=25, words=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgé") for _ in range(3)) for _ in range(200)]
    rows, d = [], 0
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.randint(2, words))]
        for _ in range(r.choice([1, 1, 2, 3, 8])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((d, " ".join(w).capitalize() + r.choice(["", ".", "\n"])))
            d += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "t"), [(5, 0.5), (2, 0.8), (1, 0.6)])
def test_against_brute_force(spark, n, t):
    rows = corpus(n)
    df = spark.createDataFrame([(d, x, "g", "n", "i") for d, x in rows], SCHEMA).repartition(3)
    got = expanded([(x.doc_a, x.doc_b, x.jaccard) for x in J.jaccard_join(df, n=n, t=t).collect()])
    want = brute(rows, n, t)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def brute_classes(rows, n, t):
    """(class, links) by key."""
    pairs = brute(rows, n, t)
    root = {d: d for d, _ in rows}
    links = dict.fromkeys(root, 0)

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in pairs:
        links[a], links[b] = links[a] + 1, links[b] + 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {d: (find(d), links[d]) for d in root}


@pytest.mark.parametrize(("n", "t", "block"), [(5, 0.5, 16_384), (2, 0.8, 3), (1, 0.6, 2)])
def test_classes_against_brute_force(spark, monkeypatch, n, t, block):
    """Every link counts once, copies with copies and near documents with every copy; also where regions are divided."""
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus(n)
    df = spark.createDataFrame([(d, x, "g", "n", "i") for d, x in rows], SCHEMA).repartition(3)
    assert {r.doc_id: (r.class_id, r.links) for r in J.classes(df, n=n, t=t).collect()} == brute_classes(rows, n, t)


def test_query_counts_every_link(spark, tmp_path):
    rows = [(i, "one two three four five six", "", "", "") for i in range(4)] + [(9, "one two three four five six seven", "", "", ""), (10, "other words stand here by themselves now", "", "", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.class_id, x.links) for x in op1_ngram_jaccard(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 4), 1: (0, 4), 2: (0, 4), 3: (0, 4), 9: (0, 4), 10: (10, 0)}


def test_keys_that_stand_twice(spark):
    a, b = "a b c d e f g h", "k l m n o p q r"
    rows = [(1, a, "", "", ""), (1, b, "", "", ""), (2, a, "", "", ""), (3, b, "", "", ""), (3, b + " s", "", "", ""), (1, a, "", "", ""), (None, a, "", "", ""), (4, "", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((x.doc_a, x.doc_b, round(x.jaccard, 6)) for x in J.jaccard_join(df).collect()) == [(1, 2, 1.0), (1, 3, 1.0)]
    got = sorted((x.doc_id or 0, x.class_id or 0, x.links) for x in J.classes(df).collect())
    assert got == [(0, 0, 0), (1, 1, 2), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 1, 2), (4, 4, 0)]


def clustered(r, groups, members, width, edits):
    sets = []
    for g in range(groups):
        base = r.choice(1_000_000, width, replace=False)
        for _ in range(members):
            s = base.copy()
            e = int(r.integers(0, edits + 1))
            s[r.choice(width, e, replace=False)] = r.integers(1_000_000, 2_000_000, e)
            sets.append(np.unique(np.append(s, 5_000_000 + g % 7)).astype(np.uint64))
    return [sets[i] for i in r.permutation(len(sets))]


def one_region(sets, pivots=None, side=None):
    n = len(sets)
    return J.Rows(np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64) if side is None else side, np.arange(n), np.array([len(s) for s in sets]), np.arange(n) % 3 + 1, sets, pivots or [np.zeros(1, np.int64)] * n)


def brute_pairs(sets, t):
    code = {g: i for i, g in enumerate(sorted({int(x) for s in sets for x in s}))}
    m = np.zeros((len(sets), len(code)), np.float32)
    for i, s in enumerate(sets):
        m[i, [code[int(x)] for x in s]] = 1
    x = (m @ m.T).astype(np.float64)
    size = m.sum(1)
    j = x / (size[:, None] + size[None, :] - x)
    return {(a, b) for a, b in zip(*np.nonzero(j >= t - 1e-12)) if a < b}


@pytest.mark.parametrize("t", [0.5, 0.6, 0.9])
@pytest.mark.parametrize("edits", [3, 30])
def test_cells_divide_and_are_exact(monkeypatch, t, edits):
    """Counted and named links of one region are those of all pairs; sets that gather around pivots are divided into cells."""
    monkeypatch.setattr(J, "LEAF", 16)
    r = np.random.default_rng(edits)
    sets = clustered(r, 25, 20, 40, edits)
    want = brute_pairs(sets, t)
    foreign = [np.array([0]) if r.random() < 0.7 else np.array(sorted({int(x) for x in r.integers(-3, 0, 2)}) + [0]) for _ in sets]
    for side in (None, r.integers(1, 3, len(sets))):
        for pivots in (None, foreign):
            rows = one_region(sets, pivots, side)
            here = {(a, b) for a, b in want if (side is None or side[a] != side[b]) and (pivots is None or not set(pivots[a][:-1]) & set(pivots[b][:-1]))}
            named = J.join_rows(rows, t, bulk=False)
            a, b, _ = named.named_pairs()
            got = [(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())]
            assert len(got) == len(here) and set(got) == here
            found = J.join_rows(rows, t)
            links = np.zeros(len(sets))
            root = np.arange(len(sets))
            for a, b in here:
                links[a], links[b] = links[a] + rows.weight[b], links[b] + rows.weight[a]
            for _ in range(len(sets)):
                before = root.copy()
                for a, b in here:
                    root[a] = root[b] = min(root[a], root[b])
                if (root == before).all():
                    break
            assert (found.links == links).all() and (found.roots(rows.node) == root).all()
            assert min(found.cells, named.cells) > (20 if edits == 3 else 0)


def test_cells_of_five_thousand_documents():
    """At the registered threshold and leaf size: the region is divided, and most pairs are settled without being compared."""
    sets = clustered(np.random.default_rng(3), 50, 100, 60, 8)
    rows = one_region(sets)
    compared, inter = [], J.Region.inter

    def counting(self, a, b):
        compared.append(len(a) * len(b))
        return inter(self, a, b)

    J.Region.inter = counting
    try:
        found = J.join_rows(rows, J.THRESHOLD)
    finally:
        J.Region.inter = inter
    assert found.cells > 50 and sum(compared) < 0.5 * len(sets) ** 2 / 2
    want = brute_pairs(sets, J.THRESHOLD)
    assert found.links.sum() == sum(rows.weight[a] + rows.weight[b] for a, b in want)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "", "", ""), (2, "", None, "", ""), (3, "...", "", None, ""), (None, long, "", "", ""), (4, long, "", "", ""), (5, long + " end", "", "", ""), (6, "one", "", "", ""), (7, "One!", "", "", ""), (7, "One!", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(x.doc_a, x.doc_b): round(x.jaccard, 3) for x in J.jaccard_join(df).collect()}
    assert got == {(4, 5): 1.0, (6, 7): 1.0}
    assert sorted(x.doc_id or 0 for x in J.near_dedup(df).collect()) == [0, 1, 2, 3, 4, 6]
    empty = spark.createDataFrame([], SCHEMA)
    assert J.jaccard_join(empty).collect() == [] and J.near_dedup(empty).collect() == []


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (9, 8), (10, 11), (11, 12), (12, 13), (13, 10)], "doc_a long, doc_b long")
    assert {(x.node, x.root) for x in J.components(pairs).collect()} == {(2, 1), (3, 1), (4, 1), (9, 8), (11, 10), (12, 10), (13, 10)}
