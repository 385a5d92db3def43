import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import arrays as A
from siftwell.llm import katz
from siftwell.llm.bpe import encoder

SCHEMA = "doc_id long, text string, keys string, chunk string, ids string"


class Brute:
    """The model by its definition, in dictionaries."""

    def __init__(self, docs, vocab):
        self.v, self.n = vocab, [Counter(), Counter(), Counter()]
        for t in docs:
            s = ["<", "<", *t, ">"]
            for i in range(2, len(s)):
                for k in range(3):
                    self.n[k][tuple(s[i - k : i + 1])] += 1
        self.d = [katz.discounts([sum(c == r for c in n.values()) for r in range(katz.K + 2)]) for n in self.n]
        self.follow = {}
        for k in (1, 2):
            for g in self.n[k]:
                self.follow.setdefault(g[:-1], []).append(g[-1])
        total = sum(self.n[0].values())
        p = {w[0]: self.d[0][min(c, katz.K + 1)] * c / total for w, c in self.n[0].items()}
        left = 1 - sum(p.values())
        if left < 1e-12:
            p = {w[0]: c / (total + 1) for w, c in self.n[0].items()}
            left = 1 - sum(p.values())
        self.uni, self.rest = p, left / (vocab + 1 - len(p))
        self.cache = {}

    def context(self, h):
        if h not in self.cache:
            least = (katz.MIN_BIGRAM, katz.MIN_TRIGRAM)[len(h) - 1]
            ws = self.follow.get(h, [])
            total = sum(self.n[len(h)][h + (w,)] for w in ws)
            kept = {w: self.n[len(h)][h + (w,)] for w in ws if self.n[len(h)][h + (w,)] >= least}
            p = {w: self.d[len(h)][min(c, katz.K + 1)] * c / total for w, c in kept.items()}
            left = 1 - sum(p.values())
            if left < 1e-9:
                p = {w: c / (total + 1) for w, c in kept.items()}
                left = 1 - sum(p.values())
            self.cache[h] = p, left / (1 - sum(self.p(w, h[1:]) for w in kept))
        return self.cache[h]

    def p(self, w, h):
        if not h:
            return self.uni.get(w, self.rest)
        if h not in self.cache and h not in self.follow:
            return self.p(w, h[1:])
        p, alpha = self.context(h)
        return p[w] if w in p else alpha * self.p(w, h[1:])

    def score(self, t):
        s = ["<", "<", *t, ">"]
        return sum(math.log(self.p(s[i], tuple(s[i - 2 : i]))) for i in range(2, len(s)))


def corpus():
    r = random.Random(2)
    words = ["the", "cat", "sat", "on", "a", "mat", "dög", "xylophone", "runs"]
    return [" ".join(r.choices(words, k=r.randint(0, 30), weights=range(9, 0, -1))) for _ in range(120)]


def ids(texts):
    e = encoder(None, "tiktoken")
    t, off = e.encode(A.as_strings(pa.array(texts)))
    return [t[a:b].tolist() for a, b in zip(off[:-1], off[1:])], len(e.tokens)


def test_against_brute_force(spark, monkeypatch):
    texts = corpus()
    toks, vocab = ids(texts)
    m = Brute(toks, vocab)
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in katz.lm_score(df).collect()}
    for i, t in enumerate(toks):
        assert got[i].n_tokens == len(t)
        assert got[i].log_prob == pytest.approx(m.score(t), abs=2e-3), texts[i]


def test_every_context_sums_to_one():
    toks, vocab = ids(corpus())
    c = katz.Coding(vocab)
    keys = c.keys(np.array([x for t in toks for x in t]), np.array([len(t) for t in toks]))
    keys, count = np.unique(keys, return_counts=True)
    uni_count = np.zeros(vocab + 1, np.int64)
    for t in toks:
        for w in t:
            uni_count[w] += 1
    uni_count[vocab] = len(toks)
    uni = katz.unigrams(uni_count, katz.discounts([1] * 7))
    assert abs(uni.sum() - 1) < 1e-9
    for d in (np.r_[1, 0.4, 0.7, 0.8, 0.9, 0.95, 1], np.ones(7)):
        m = katz.Bucket(c, keys, count, uni, d, d)
        b = np.uint64(c.bits)
        w3 = np.append(np.arange(vocab), c.eos).astype(np.uint64)
        for ctx in [*m.ctx[:: max(1, len(m.ctx) // 20)], (m.ctx[0] >> b) << b | np.uint64(7)]:  # the last one was never seen
            k = ((ctx >> b) << (b + b)) | ((ctx & np.uint64((1 << c.bits) - 1)) << b) | w3
            assert np.exp(m.log_p(k)).sum() == pytest.approx(1, abs=1e-6)


def test_edge_cases(spark):
    rows = [(1, None, "", "", ""), (2, "", "", None, ""), (None, "the cat", "", "", ""), (3, "the cat", "", "", ""), (3, "the cat", "", "", ""), (4, "long text " * 20_000, "", "", "")]
    got = sorted(((r.doc_id, r.n_tokens, r.log_prob) for r in katz.lm_score(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert len(got) == 6 and got[0] == (1, None, None) and got[1][1] == 0 and got[1][2] < 0
    assert got[2] == got[3]
    assert katz.lm_score(spark.createDataFrame([], SCHEMA)).collect() == []


def test_what_stands_twice_is_scored_apart(spark):
    """Of documents of rare words, those that the corpus has twice are far more probable: trigrams seen once count, discounted."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("bcdfghjklmnpqrstvwz") + r.choice("aeiou") for _ in range(3))
    texts = [" ".join(word() for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate([*texts, *texts[:15]])], SCHEMA)
    got = {x.doc_id: x.perplexity for x in katz.lm_score(df).collect()}
    once, twice = sorted(got[i] for i in range(15, 60)), sorted(got[i] for i in range(15))
    assert twice[7] < 0.8 * once[22] and twice[-1] < once[22]
