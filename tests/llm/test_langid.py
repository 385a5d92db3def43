import random

import numpy as np
import pyarrow as pa

from siftwell.llm import arrays as A
from siftwell.llm import langid

SYLLABLES = {"en": "the th er on an re he in ed nd ha at en es of or", "de": "der die sch ein ich und en ung cht ge ver ß ü", "es": "que el la de ción os as ado ñ á es ar", "fr": "le la les eau eux ou é è ç tion ment que"}
SCHEMA = "doc_id long, text string, lang string, LANG_PRED int, text_of int"


def text(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang].split(), k=r.randrange(1, 4))) for _ in range(n))


def kernel(a, b):
    """The blended-spectrum presence kernel by definition."""
    def grams(t):
        w = "".join(c.lower() if c.isalpha() else " " for c in t)
        return {w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)}

    x, y = grams(a), grams(b)
    return len(x & y) / (len(x) * len(y)) ** 0.5


def test_held_out_accuracy():
    r = random.Random(1)
    rows = [(text(r, lang, r.choice([5, 20, 100])), lang) for lang in SYLLABLES for _ in range(200)]
    r.shuffle(rows)
    m = langid.fit([t for t, _ in rows[:500]], [k for _, k in rows[:500]])
    s = m.score(A.as_strings(pa.array([t for t, _ in rows[500:]])))
    right = [m.labels[k] == want and x >= langid.MIN_SCORE for k, x, (_, want) in zip(s.argmax(1), s.max(1), rows[500:])]
    assert np.mean(right) > 0.97


def test_texts_of_a_language_without_labels_are_rejected():
    r = random.Random(5)
    for left in SYLLABLES:
        known = [k for k in SYLLABLES if k != left]
        m = langid.fit([text(r, k, 30) for k in known for _ in range(80)], [k for k in known for _ in range(80)])
        new = m.identify(A.as_strings(pa.array([text(r, left, 30) for _ in range(100)])))[0]
        assert np.mean([k == langid.REJECTED for k in new]) > 0.95
        want = [k for k in known for _ in range(60)]
        got = m.identify(A.as_strings(pa.array([text(r, k, 30) for k in want])))[0]
        assert np.mean([a == b for a, b in zip(got, want)]) > 0.97
    other = ["Кошка спит на стуле у окна, пока идёт дождь", "Kot śpi na krześle obok okna podczas deszczu"]
    assert m.identify(A.as_strings(pa.array(other)))[0] == [langid.REJECTED] * 2


def test_presence_counts_common_ngrams():
    r = random.Random(2)
    texts = [text(r, k, 6) for k in SYLLABLES for _ in range(4)]
    m = langid.fit(texts, [k for k in SYLLABLES for _ in range(4)], features=60_000)
    p = m.presence(A.as_strings(pa.array(texts))).astype(float)
    got = p @ p.T
    norm = got / np.sqrt(np.outer(got.diagonal(), got.diagonal()))
    want = np.array([[kernel(a, b) for b in texts] for a in texts])
    assert np.abs(norm - want).max() < 0.15 and np.corrcoef(norm.ravel(), want.ravel())[0, 1] > 0.98


def test_identify(spark):
    r = random.Random(3)
    rows = [(i, text(r, k, 30), k, 0, 0) for i, k in enumerate(list(SYLLABLES) * 30)]
    odd = [(200, None, "en", 0, 0), (201, "", None, 0, 0), (202, "12 34 !!", "fr", 0, 0), (None, text(r, "de", 20), None, 0, 0), (3, text(r, "en", 60_000), None, 0, 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    m = langid.train(df)
    got = langid.identify(df, m)
    assert got.columns == ["doc_id", "text", "lang", "text_of", "lang_pred", "lang_score"]
    by = {(x.doc_id, x.text): x for x in got.collect()}
    assert len(by) == len(rows + odd)
    assert all(by[i, t].lang_pred == k for i, t, k, _, _ in rows)
    assert by[200, None].lang_pred is None is by[200, None].lang_score
    assert by[201, ""].lang_pred == by[202, "12 34 !!"].lang_pred == langid.REJECTED
    assert by[None, odd[3][1]].lang_pred == "de" and by[3, odd[4][1]].lang_pred == "en"


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None, 0, 0)], SCHEMA)
    assert langid.train(df) is None
    assert [r.lang_pred for r in langid.identify(df, None).collect()] == [langid.REJECTED]
    none = spark.createDataFrame([], SCHEMA)
    assert langid.identify(none, langid.train(none)).count() == 0
    one = spark.createDataFrame([(1, "only one language here", "xx", 0, 0)], SCHEMA)
    assert [r.lang_pred for r in langid.identify(one, langid.train(one)).collect()] == ["xx"]
