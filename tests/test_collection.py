"""The operators against a plain model over small nested documents."""

import json
import math
import random
import re
from decimal import Decimal

import pytest

from siftwell.functions.stem import stem
from siftwell.operators.collection import Collection, TokenizerConfig
from siftwell.plans import lang
from siftwell.plans.lang import And, Compare, Count, Not, Or, QueryError, Sort, parse

WORDS = "river stone river lamp Lamp copper-wire wört ALPHA beta7 alphabet lampshade".split()


def make(n=60, seed=3):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        d = {"title": " ".join(r.choices(WORDS, k=r.randrange(0, 6))), "size": r.choice([0, 1, 2.5, 3, 10, -4, 1e3])}
        if r.random() < 0.6:
            d["team"] = {r.choice(["a", "b"]): {"size": r.choice([1, 2, 60.0009, -0.0005, 41]), "tags": r.choices(WORDS, k=2)}}
        if r.random() < 0.3:
            d["units"] = r.choice(["volt", {"volt": "stone", "big_size": r.randrange(5)}, None, True])
        out.append(d)
    return out + [{}, {"size": 8.99e9, "deep": {"er": {"and": {"deeper": {"still": {"more": "lamp"}}}}}}]


def leaves(v, path=""):
    if isinstance(v, (dict, list)):
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            yield from leaves(x, f"{path}.{k}" if path else str(k))
    else:
        yield path, v


def text_of(v):
    if isinstance(v, bool) or v is None:
        return {True: "true", False: "false", None: "null"}[v]
    if isinstance(v, str):
        return v.strip().lower()
    return str(int(v)) if float(v).is_integer() else f"{Decimal(repr(float(v))):f}"


def toks(s):
    return re.findall("[a-z0-9]+", s.lower())


class Model:
    def __init__(self, docs):
        self.docs = {f"{i:03}": d for i, d in enumerate(docs)}
        self.leaves = {i: list(leaves(d)) for i, d in self.docs.items()}
        self.tokens = {i: [t for _, v in ls for t in toks(text_of(v))] for i, ls in self.leaves.items()}

    def any(self, ws):
        return sorted(i for i, t in self.tokens.items() if set(t) & set(ws))

    def keys(self):
        for i, ls in self.leaves.items():
            for p, v in ls:
                if isinstance(v, (int, float)) and not isinstance(v, bool):
                    yield i, p, int(v * 1000.0)

    def pairs(self, field, low, high, full=False):
        return sorted((i, p) for i, p, k in self.keys() if (p if full else p.split(".")[-1]) == field and (low is None or k >= low * 1000) and (high is None or k <= high * 1000))

    def bm25(self, weights, k1=1.2, b=0.75):
        dl = {i: len(t) for i, t in self.tokens.items() if t}
        avg = sum(dl.values()) / len(dl)
        out = {}
        for term, w in weights.items():
            df = len(self.any([term]))
            for i in self.any([term]):
                tf = self.tokens[i].count(term)
                out[i] = out.get(i, 0) + w * math.log((len(dl) - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[i] / avg))
        return out

    def candidates(self, query, k, squared):
        words = toks(query)
        grams = [w[i : i + n] for w in words for n in range(2, 6) for i in range(len(w) - n + 1)]
        vocab = {t for ts in self.tokens.values() for t in ts}
        rows = []
        for t in vocab:
            hits = sum(g in t for g in grams)
            if hits:
                rows.append((0.6 * hits / (len(words) ** 2 if squared else len(words)) + 0.4 * (1 - lev(" ".join(words), t) / len(t)), t))
        return {t: w for w, t in sorted(rows, reverse=True)[:k]}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def both(spark):
    docs = make()
    m = Model(docs)
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, d in m.docs.items()]
    c = Collection.from_json(spark.createDataFrame(rows, "id string, data string").repartition(3), "id", "data")
    return m, Collection(c.docs.cache())


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def pairs(df):
    return sorted((r.doc_id, r.path) for r in df.collect())


def test_tokens_and_fields(both):
    m, c = both
    assert {r.doc_id: list(r.tokens) for r in c.docs.collect()} == m.tokens
    assert sorted((r.doc_id, r.path, r.text) for r in c.fields.collect()) == sorted((i, p, text_of(v)) for i, ls in m.leaves.items() for p, v in ls)
    assert c.fields.where("text = '8990000000'").count() == 1


def test_words(both):
    m, c = both
    assert ids(c.words(["RIVER", "beta7"])) == m.any(["river", "beta7"]) != []
    assert ids(c.words(["copper-wire"])) == [] == ids(c.words([]))
    assert ids(c.and_words(["river", "Lamp"])) == sorted(set(m.any(["river"])) & set(m.any(["lamp"])))
    assert ids(c.and_words([])) == []
    assert ids(c.not_words(["river"])) == sorted(set(m.docs) - set(m.any(["river"])))
    assert ids(c.get("007")) == ["007"]
    assert c.doc_freq("lamp").first().df == len(m.any(["lamp"]))
    post = {(r.term, r.doc_id): (r.tf, list(r.field_paths)) for r in c.postings.collect()}
    assert {(t, i): n for (t, i), (n, _) in post.items()} == {(t, i): ts.count(t) for i, ts in m.tokens.items() for t in ts}
    for r in c.get_postings("lamp").collect():
        assert (r.tf, list(r.field_paths)) == post["lamp", r.doc_id]
    assert ids(c.term_in_field("lamp", "title")) == sorted(i for (t, i), (_, p) in post.items() if t == "lamp" and "title" in p)
    assert ids(c.term_in_segment("lamp", "tags")) == sorted(i for (t, i), (_, p) in post.items() if t == "lamp" and any("tags" in x.split(".") for x in p))
    vocab = {t for ts in m.tokens.values() for t in ts}
    assert {r.term for r in c.gram_terms("amp").collect()} == {t for t in vocab if "amp" in t}
    assert c.gram_terms("lampsh").count() == 0
    assert {r.term for r in c.prefix_terms("al").collect()} == {t for t in vocab if "al" in t}


@pytest.mark.parametrize("op, low, high", [("gt", 3, None), ("gte", 2, None), ("lt", None, 0), ("lte", None, 60)])
def test_compare(both, op, low, high):
    m, c = both
    n = low if low is not None else high
    got = pairs(getattr(c, op)("size", n))
    assert got == m.pairs("size", n + 1 if op == "gt" else low, n - 1 if op == "lt" else high) != []


def test_ranges(both):
    m, c = both
    assert pairs(c.range("team.a.size", 0, 50)) == m.pairs("team.a.size", 0, 50, full=True) != []
    assert pairs(c.range("a.size", 0, 50)) == [] == pairs(c.range("size", 5, 1)) == pairs(c.gt("team.a.size", 0))
    assert pairs(c.between("size", 1, 3)) == m.pairs("size", 1, 3)
    assert pairs(c.between("size", 1, 3, exclude=[2.5])) == [p for p in m.pairs("size", 1, 3) if p not in m.pairs("size", 2.5, 2.5)]
    assert set(pairs(c.gt("size", 2, strict=True))) - set(pairs(c.gt("size", 2))) == set(m.pairs("size", 2.001, 2.999))


def test_ranking(both):
    m, c = both
    for query in ("lmap river", "alpha", "q", ""):
        for squared in (False, True):
            want = m.bm25(m.candidates(query, 3, squared)) if query else {}
            rows = c.ngram_bm25(query, top_k=3, squared=squared).collect()
            assert {r.doc_id: round(r.score, 9) for r in rows} == {i: round(s, 9) for i, s in want.items()}
            assert [(-r.score, r.doc_id) for r in rows] == sorted((-r.score, r.doc_id) for r in rows)
    assert {r.doc_id: round(r.score, 9) for r in c.bm25(["lamp", "Lamp", "stone"]).collect()} == {i: round(s, 9) for i, s in m.bm25({"lamp": 2, "stone": 1}).items()}
    assert Collection(c.docs, TokenizerConfig()).ngram_bm25("lamp").count() == 0


def suffix_key(m, i, s):
    hits = sorted(((len(p), p), v) for p, v in m.leaves[i] if p.endswith(s) and isinstance(v, (int, float)) and not isinstance(v, bool))
    return hits[-1][1] if hits else None


def test_sorts(both):
    m, c = both

    def order(i):
        a, b = suffix_key(m, i, "b.size"), suffix_key(m, i, "size")
        return (a is not None, -(a or 0), b is None, b or 0, i)

    assert [r.doc_id for r in c.sort_by([("b.size", False), ("size", True)]).collect()] == sorted(m.docs, key=order)
    best = {i: [v for p, v in ls if p.split(".")[-1] == "size"] for i, ls in m.leaves.items()}
    assert [r.doc_id for r in c.sort_by_leaf([("size", True)]).collect()] == sorted(m.docs, key=lambda i: (not best[i], min(best[i], default=0), i))
    part = {i: max((int(v) for p, v in ls if "iz" in p and isinstance(v, (int, float))), default=None) for i, ls in m.leaves.items()}
    assert [r.doc_id for r in c.sort_by_substring("iz", False).collect()] == sorted((i for i in part if part[i] is not None), key=lambda i: (-part[i], i))
    among = c.words(["river"])
    keyed = sorted((k, i) for i, p, k in m.keys() if p == "size" and i in m.any(["river"]))
    assert [r.doc_id for r in c.sort_by_path("size", True, among).collect()] == [i for _, i in keyed]


def evaluate(m, e):
    if isinstance(e, Compare):
        if e.op == "=":
            return m.any([e.value.lower()])
        low, high = {">": (e.value + 1, None), ">=": (e.value, None), "<": (None, e.value - 1), "<=": (None, e.value)}[e.op]
        return sorted({i for i, _ in m.pairs(e.field, low, high)})
    if isinstance(e, Or):
        return evaluate(m, e.left) + evaluate(m, e.right)
    if isinstance(e, And):
        right = set(evaluate(m, e.right))
        return [i for i in evaluate(m, e.left) if i in right]
    return sorted(set(m.docs) - set(evaluate(m, e.inner)))


@pytest.mark.parametrize("text", [
    "x = river", "size > 1", "x = lamp OR size >= 2 OR x = river", "(x = lamp OR x = river) AND size <= 3", "size < 3 AND (x = lamp OR x = river)",
    "NOT x = lamp AND size > 0", "x = lamp and not x = river or big_size >= 0", "x = nothing",
])
def test_language(both, text):
    m, c = both
    want = sorted(evaluate(m, parse(text)))
    assert ids(c.query(text)) == want
    rows = c.query(f"COUNT {text}").collect()
    assert sorted(r.doc_id for r in rows) == want and all(r["count"] == len(want) for r in rows)
    assert lang.count(c, text).first()["count"] == len(want)
    got = [r.doc_id for r in c.query(f"{text} SORT BY ((size DESC), (b_size ASC))").collect()]
    key = lambda i: ((k := suffix_key(m, i, "size")) is not None, -(k or 0), i)
    assert got == sorted(want, key=key)


def test_parser():
    assert parse("a = x OR b = y AND NOT c = z") == Or(Compare("a", "=", "x"), And(Compare("b", "=", "y"), Not(Compare("c", "=", "z"))))
    assert parse("count (hp > 3) sort by ((hp asc),(attack desc))") == Sort(Count(Compare("hp", ">", 3)), (("hp", True), ("attack", False)))


@pytest.mark.parametrize("text", ["", "hp", "hp >", "hp > 3 foo", "SORT BY ((hp ASC))", "hp > 3 SORT BY (hp ASC)", "hp > 3 SORT BY ()", "hp > 3 SORT hp", "(hp > 3", "a.b = x", "hp > -1", 'name = "x"', "hp > 9223372036854775808", "x ! 3"])
def test_parse_errors(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize("text", ["hp = 3", "name > x", "NOT hp > 3", "NOT NOT a = x", "NOT (a = x OR b = y)"])
def test_compile_errors(both, text):
    with pytest.raises(QueryError):
        both[1].query(text)


def test_stemming(spark):
    for w, want in {"caresses": "caress", "ponies": "poni", "running": "run", "hoping": "hope", "nationalization": "nation", "generously": "generous", "happy": "happi", "skies": "sky", "agreed": "agre", "relational": "relat", "conditional": "condit", "is": "is"}.items():
        assert stem(w) == want, w
    df = spark.createDataFrame([(1, "Running ponies", None), (2, "run", "x")], "id long, t string, u string")
    c = Collection.from_table(df, "id", config=TokenizerConfig(use_stemming=True, min_ngram=2, max_ngram=3))
    assert ids(c.words(["runs"])) == [1, 2] and ids(c.words(["pony"])) == [1]
    assert [r.doc_id for r in c.get_postings("poni").collect()] == [1]
    assert ids(c.bm25(["running"])) == [1, 2]


def test_config():
    assert TokenizerConfig().ngrams is None and TokenizerConfig(max_ngram=3).ngrams == (1, 3) and TokenizerConfig(min_ngram=2).ngrams == (2, 2)
    with pytest.raises(ValueError):
        TokenizerConfig(min_ngram=5, max_ngram=3)


def test_depth_and_dates(spark):
    doc = {"A": "  Mixed Case ", "b": {"c": {"d": " Deep "}}, "when": "03/02/2021", "l": [1, [2, 3]]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "[1]"), (3, None), (4, "{broken")], "id long, j string")
    full = {(r.doc_id, r.path): r for r in Collection.from_json(df, "id", "j", date_paths=("when",)).fields.collect()}
    assert full[1, "A"].text == "mixed case" and full[1, "b.c.d"].text == "deep" and full[1, "l.1.0"].num == 2.0
    assert full[1, "when"].date == "2021-02-03" and full[1, "when"].vkey == 20210203
    assert {i for i, _ in full} == {1}
    cut = {r.path: r.text for r in Collection.from_json(df, "id", "j", max_depth=2).fields.collect()}
    assert cut["b.c.d"] == " Deep " and cut["A"] == "mixed case" and "l.1.0" in cut
    assert "b.c.d" not in {r.path for r in Collection.from_json(df, "id", "j", max_depth=1).fields.collect()}


def test_extreme_numbers(spark):
    df = spark.createDataFrame([(1, 1e30), (2, float("nan")), (3, -1e30), (4, 9.8), (5, None), (6, 6.626e-34), (7, -0.0005)], "id long, x double")
    got = {r.doc_id: r.vkey for r in Collection.from_table(df, "id").fields.collect()}
    assert got == {1: 2**63 - 1, 2: 0, 3: -(2**63), 4: 9800, 6: 0, 7: 0}


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "id long, doc_id string, leaves int, tokens double")
    c = Collection.from_table(df, "id")
    assert c.words(["a"]).count() == c.vocab.count() == c.ngram_bm25("abc").count() == c.query("x = a OR b > 1").count() == 0
    assert c.stats().first().n_docs == 0
    df = spark.createDataFrame([(1, "a b", 3, 4.0)], df.schema)
    assert ids(Collection.from_table(df, "id").query("leaves > 1 AND x = b")) == [1]


def test_types(spark):
    df = spark.sql("""SELECT 1 AS id, named_struct('a', array(1, 2), 'b', map('k', true)) AS s, DATE '2020-03-04' AS d, CAST(NULL AS STRING) AS n, array(named_struct('x', CAST(NULL AS INT))) AS l""")
    got = {r.path: (r.kind, r.text) for r in Collection.from_table(df, "id").fields.collect()}
    assert got == {"s.a.0": ("number", "1"), "s.a.1": ("number", "2"), "s.b.k": ("text", "true"), "d": ("date", "2020-03-04"), "l.0.x": ("text", "null")}


def test_plain_fields_are_as_leaves(spark):
    """The same table with its fields known to the plan, and with all of them nested in leaves."""
    r = random.Random(8)
    rows = [(i, r.choice([None, -3, 0, 4, 7]), r.choice([None, float("nan"), 0.0, -0.0004, 3.9999, 4.0, 4.5, 1e300, float("inf")]), r.choice(["Lamp 4", None, "", "river-lamp", "nan"]), r.choice([None, True])) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, size int, big_size double, name string, flag boolean").repartition(3)
    a = Collection.from_table(df, "id")
    b = Collection(a.docs)
    assert a.plain and not b.plain
    for n in (-3, 0, 3, 4, 5):
        for op in ("gt", "gte", "lt", "lte"):
            for field in ("size", "big_size"):
                assert pairs(getattr(a, op)(field, n)) == pairs(getattr(b, op)(field, n)), (op, field, n)
        assert pairs(a.between("big_size", -n, n)) == pairs(b.between("big_size", -n, n))
    assert pairs(a.between("size", -3, 7, exclude=[4])) == pairs(b.between("size", -3, 7, exclude=[4])) != []
    for words in (["lamp"], ["4"], ["nan"], ["true"], ["inf"], ["river-lamp"], ["3"]):
        assert ids(a.words(words)) == ids(b.words(words)) and ids(a.not_words(words)) == ids(b.not_words(words))
        assert sorted(map(str, a.get_postings(words[0]).collect())) == sorted(map(str, b.get_postings(words[0]).collect()))
    for fields in ([("size", True)], [("big_size", False), ("name", True)]):
        assert [x.doc_id for x in a.sort_by(fields).collect()] == [x.doc_id for x in b.sort_by(fields).collect()]
        assert [x.doc_id for x in a.sort_by_leaf(fields).collect()] == [x.doc_id for x in b.sort_by_leaf(fields).collect()]
    assert [x.doc_id for x in a.sort_by_substring("ig").collect()] == [x.doc_id for x in b.sort_by_substring("ig").collect()]
    for q in ("x = lamp OR size > 3 OR big_size < 2", "(x = lamp OR size > 3) AND big_size >= 0", "NOT x = lamp AND size <= 4", "big_size < 1 AND (size > 0 OR x = nan)"):
        assert ids(a.query(q)) == ids(b.query(q)) != []


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.sql("SELECT id, CAST(id % 50 AS INT) AS size, id / 7D AS x, DATE '2020-01-01' + CAST(id AS INT) AS d, 'a' AS t FROM range(1000)").write.parquet(f"{tmp_path}/t")
    c = Collection.from_table(spark.read.parquet(f"{tmp_path}/t"), "id")
    for df, want in ((c.gt("size", 40), "GreaterThanOrEqual(size,41)"), (c.between("x", 3, 5), "GreaterThanOrEqual(x,"), (c.date_between("d", "2020-02-01", "2020-02-03"), "GreaterThanOrEqual(d,"), (c.get(3), "EqualTo(id,3)")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert want in plan and "Exchange" not in plan
    assert "t:string" not in c.gt("size", 40)._jdf.queryExecution().executedPlan().toString()
