import random

import pytest

from siftwell.llm import lines as L

SCHEMA = "doc_id long, text string, drop string, l string"


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def mutated(r, s, n):
    s = list(s)
    for _ in range(n):
        i = r.randint(0, len(s))
        if r.random() < 0.4:
            s.insert(i, r.choice("abé"))
        elif s:
            i = min(i, len(s) - 1)
            s[i : i + 1] = r.choice(["", "c"])
    return "".join(s)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_distance_is_edit_distance(k):
    r = random.Random(k)
    a = ["".join(r.choice("abé") for _ in range(r.randint(0, 30))) for _ in range(400)]
    b = [mutated(r, s, r.randint(0, 5)) for s in a]
    assert L.within(a, b, k).tolist() == [edits(x, y) <= k for x, y in zip(a, b)]


def brute(rows, k, least):
    """rows: (doc_id, text); the remaining text of each, or None where the document goes."""
    earlier, out = [], {}
    for d, t in sorted((x for x in rows if x[1] is not None), key=lambda x: x[0]):
        kept = []
        for line in t.split("\n"):
            if len(line) >= least:
                if any(abs(len(e) - len(line)) <= k and edits(e, line) <= k for e in earlier):
                    earlier.append(line)
                    continue
                earlier.append(line)
            kept.append(line)
        out[d] = "\n".join(kept) if kept else None
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefg é") for _ in range(r.randint(5, 40))) for _ in range(30)]
    rows = []
    for d in range(60):
        rows.append((d, "\n".join(mutated(r, r.choice(base), r.choice([0, 0, 1, 2, 3, 4])) for _ in range(r.randint(1, 5)))))
    want = brute(rows, 2, 12)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(5)
    got = {x.doc_id: x.text for x in L.line_dedup(df, min_chars=12).collect()}
    assert got == {d: t for d, t in want.items() if t is not None}


def test_edge_cases(spark):
    long = "word " * 20_000
    rows = [(1, None, "x", None), (2, "", None, "q"), (3, long, "", ""), (4, long + "!", "", ""), (None, "this line is long enough to count", "", ""),
            (5, "this line is long enough to count\nshort", "", ""), (6, "twice the very same line here\ntwice the very same line here", "", ""), (6, "twice the very same line here\ntwice the very same line here", "", "")]
    out = sorted(((x.doc_id, x.text, x.drop, x.l) for x in L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert [x[0] for x in out] == [1, 2, 3, 5, 6, 6]
    assert out[3][1].startswith("this line") and out[4][1] == "twice the very same line here"
    assert L.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
