import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from siftwell.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, Topic int, tokens string"


def corpus(n=800, seed=4):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(["word"] * r.choice([1, 5, 40, 300]))
        if r.random() < 0.2:
            text += " | table"
        if r.random() < 0.1:
            text = "\n".join(text.split())
        out.append((i, text, r.choice(["en", "en", "de", None]), r.choice(["s0"] * 6 + ["s1", "s2"]), 1, "x"))
    return out + [(n, None, "en", "s0", 1, "x"), (n + 1, "", "en", "s1", 1, "x"), (None, "no key", "en", "s1", 1, "x"), (3, "long " * 200_000, "en", "s2", 1, "x")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = mixing.mix(df, rate="rate")
    assert got.columns == [*df.columns, "rate"]
    found = {(r.doc_id, r.text): r.rate for r in got.collect()}
    cells = pd.DataFrame([(s or "(none)", k or "(none)", t, len((t or "").split())) for _, t, k, s, _, _ in rows], columns=["source", "lang", "text", "tokens"])

    def topic(t):
        if t is None:
            return "prose"
        return "table" if " | " in t else "verse" if t.count("\n") * 120 > len(t) else "prose"

    cells["topic"] = cells["text"].map(topic)
    fit = cells.groupby(["source", "lang", "topic"], as_index=False)["tokens"].sum()
    fit = fit[fit.tokens > 0].astype({"tokens": float}).reset_index(drop=True)
    w = fit["tokens"].copy()
    goal = {}
    for d, p in mixing.POWERS.items():
        t = (fit.groupby(d)["tokens"].sum() / fit.tokens.sum()) ** p
        goal[d] = t / t.sum() * fit.tokens.sum()
    for _ in range(mixing.ROUNDS):
        for d in mixing.POWERS:
            w = w * fit[d].map(goal[d]) / w.groupby(fit[d]).transform("sum")
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * w / fit.tokens) * fit.tokens).sum() < mixing.SHARE * fit.tokens.sum() else (low, mid)
    rate = dict(zip(zip(fit.source, fit.lang, fit.topic), np.minimum(1, high * w / fit.tokens)))
    want = {}
    for i, t, k, s, _, _ in rows:
        if t:
            x = rate[s or "(none)", k or "(none)", topic(t)]
            u = int(hashlib.md5(f"{'' if i is None else i}:11".encode()).hexdigest()[:8], 16) / 2**32
            if u < x:
                want[i, t] = x
    assert found.keys() == want.keys() and max(abs(found[k] - want[k]) for k in want) < 1e-6


def test_marginals():
    r = np.random.default_rng(0)
    cells = pd.DataFrame([(a, b, c, int(r.integers(1, 1000))) for a in "xyz" for b in "pq" for c in "uv"], columns=["source", "lang", "topic", "tokens"])
    want = mixing.targets(cells, mixing.POWERS)
    fitted = mixing.rake(cells, want, 100)
    for d in mixing.POWERS:
        now = pd.Series(fitted).groupby(cells[d]).sum()
        assert np.allclose(now, want[d], rtol=1e-6)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_both_fits_agree(spark, limit):
    df = spark.createDataFrame(corpus(200), SCHEMA)
    a = {(r.doc_id, r.text) for r in mixing.mix(df).collect()}
    b = {(r.doc_id, r.text) for r in mixing.mix(df, driver_cells=limit, rounds=mixing.ROUNDS if limit else 5).collect()}
    assert a == b or (limit == 0 and len(a ^ b) < 0.05 * len(a))


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, None, 1, None), (2, "", "en", "s", 1, "x")], SCHEMA)).count() == 0
    all_in = mixing.mix(spark.createDataFrame([(1, "a b", "en", "s", 1, "x")] * 2, SCHEMA), share=1.0)
    assert all_in.count() == 2
