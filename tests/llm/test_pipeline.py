"""The pipeline, stage by stage, against brute force on small documents."""

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from siftwell.llm import bpe, langid, lines, mixing

from .test_jaccard import brute as jaccard_pairs
from .test_langid import SYLLABLES, text
from .test_lines import brute as line_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(9)
    rows = []
    for i in range(120):
        lang = r.choice(list(SYLLABLES))
        t = "\n".join(text(r, lang, r.choice([6, 12, 30])) for _ in range(r.randrange(1, 4)))
        rows.append([i, t, lang, r.choice(["s0", "s0", "s1"])])
    for i in range(120, 150):  # exact and near copies, repeated lines
        _, t, lang, _ = rows[r.randrange(100)]
        other = r.choice([x[1] for x in rows[:100] if x[2] == lang])
        words = t.split(" ")
        words[r.randrange(len(words))] = {"en": "the", "de": "der", "es": "que", "fr": "eau"}[lang]
        rows.append([i, r.choice([t, " ".join(words), other + "\n" + t]), lang, "s1"])
    rows += [[150, None, "en", "s0"], [151, "", "en", "s0"], [152, "12 !! 34", None, None], [153, text(r, "en", 3000), None, None]]
    return [(*x, len(x[1]) if x[1] is not None else None) for x in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    found = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        if name != P.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found[name] = {r.doc_id: r for r in docs.collect()}

    # language: every labelled document in its language stays, with that language
    first = found["language"]
    assert given.keys() - first.keys() == {150, 151, 152}
    assert all(first[i].text == given[i].text and first[i].lang == (given[i].lang or "en") for i in first)
    # lines
    want = line_brute([(i, r.text) for i, r in first.items()], lines.MAX_EDITS, lines.MIN_CHARS)
    second = found["line_dedup"]
    assert {i: r.text for i, r in second.items()} == {i: t for i, t in want.items() if t is not None}
    assert all(r.n_chars == len(r.text) for r in second.values()) and len(second) < len(first)
    # near duplicates: of each connected group the lowest id stays
    root = {i: i for i in second}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in jaccard_pairs([(i, r.text) for i, r in second.items()], 5, 0.5):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    third = found["near_dedup"]
    assert third == {i: r for i, r in second.items() if find(i) == i}
    # mixing: by the rates of all of its input
    frame = pd.DataFrame([(r.source or "(none)", r.lang or "(none)", r.text) for r in third.values()], columns=["source", "lang", "text"])
    frame["tokens"] = frame["text"].str.split().str.len()
    frame["topic"] = ["verse" if t.count("\n") * 120 > len(t) else "listing" if "!!" in t else "prose" for t in frame["text"]]
    cells = mixing.fit_on_driver(frame.groupby(["source", "lang", "topic"], as_index=False)["tokens"].sum(), mixing.POWERS, mixing.SHARE, mixing.ROUNDS)
    rate = cells.set_index(["source", "lang", "topic"])["rate"]
    keep = {i for (i, r), row in zip(third.items(), frame.itertuples()) if int(hashlib.md5(f"{i}:11".encode()).hexdigest()[:8], 16) / 2**32 < rate[row.source, row.lang, row.topic]}
    assert found["mix_sources"] == {i: third[i] for i in keep}
    # encoding
    enc = bpe.encoder()
    last = found["encode"]
    assert last.keys() == keep
    for i in list(keep)[:20]:
        assert bpe.StreamDecoder(enc.tokens).push(last[i].token_ids) == third[i].text and last[i].roundtrip


def test_run(spark, folder):
    got = P.run(spark, folder)
    assert {"doc_id", "token_ids", "n_tokens", "roundtrip"} <= set(got.columns)
    assert got.where("not roundtrip").count() == 0 and got.count() > 20
    assert 4 <= len(P.STAGES) <= 5


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([(1, None, None, None, None)], SCHEMA).select(F.col("doc_id"), "text", "lang", "source", "n_chars").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_rejected_name():
    assert langid.REJECTED not in SYLLABLES
