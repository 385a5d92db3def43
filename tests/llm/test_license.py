import random

import pytest

from siftwell.llm import license as L

SCHEMA = "doc_id long, text string, p string, paragraph string, family string"


@pytest.fixture(scope="module")
def model():
    r = random.Random(4)
    vocab = ["".join(r.choice(["an", "th", "er", "é", "ou", "on"]) for _ in range(3)) for _ in range(300)]
    return L.fit([" ".join(r.choices(vocab, k=r.randint(2, 60))) for _ in range(1500)])


def test_held_out_accuracy(model):
    """Templates with damage that training didn't see, and ordinary sentences with licence words."""
    r = random.Random(99)
    filler = ["wording", "elsewhere", "tree", "été", "of", "the", "and"]
    right = total = 0
    for family, texts in L.TEMPLATES.items():
        for t in texts:
            for _ in range(10):
                total += 1
                right += model.classify([L._damaged(r, t, filler)])[0][0] == family
    assert right / total > 0.9
    plain = [" ".join(r.choices(filler, k=30) + [w]) for w in ["license", "rights", "permission", "copyright", "creative"]]
    assert [f for f, _, _ in model.classify(plain)] == ["none"] * len(plain)


def test_every_template_and_the_unknown_class(model):
    for family, texts in L.TEMPLATES.items():
        assert [f for f, _, _ in model.classify(texts)] == [family] * len(texts)
    assert model.classify(["Licensed under the Zebra Sharing License, version 9."])[0][0] == "unknown"


def test_probabilities_are_calibrated(model):
    r = random.Random(7)
    filler = ["wording", "elsewhere", "tree", "été", "of", "the"]
    rows = [(L._damaged(r, t, filler), f) for f, ts in L.TEMPLATES.items() for t in ts for _ in range(10)]
    p, _ = model.probabilities([x for x, _ in rows])
    hit = p.argmax(1) == [L.FAMILIES.index(f) for _, f in rows]
    assert abs(p.max(1).mean() - hit.mean()) < 0.1


def test_scan(spark, model):
    rows = [
        (1, "some text\nReleased under the MIT License.", "", "", ""), (2, None, "", "", ""), (3, "", "", None, ""), (4, "words " * 30_000 + "\n\nLicensed under CC BY-NC 4.0.", "", "", ""),
        (5, "rights and wrongs of the tree", "", "", ""), (None, "All rights reserved.", "", "", ""), (6, "All rights reserved.\nAll rights reserved.", "", "", ""),
    ]
    got = sorted(((r.doc_id, r.paragraph, r.family) for r in L.scan(spark.createDataFrame(rows, SCHEMA), model=model).collect()), key=str)
    assert got == sorted([(1, 1, "mit"), (4, 2, "cc-by-nc"), (None, 0, "proprietary"), (6, 0, "proprietary"), (6, 1, "proprietary")], key=str)
    assert L.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lines_without_a_licence_word_are_scored(spark, model):
    texts = ["Available under CC BY 4.0.", "Released under the BSD 3-Clause terms.", "plain sentence"]
    got = L.scan(spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA), model=model).collect()
    assert sorted((r.doc_id, r.family) for r in got) == [(0, "cc-by"), (1, "bsd")]


def test_marks_lose_nothing(model):
    """Whatever the classifier doesn't call "none" has a mark."""
    r = random.Random(11)
    vocabulary = sorted({g[0] for g in model.code})
    cut = [" ".join(w[i : i + r.randint(1, 8)]) for ts in [*L.TEMPLATES.values(), L.UNKNOWN] for t in ts for w in [t.split()] for i in range(len(w))]
    rows = cut + [" ".join(r.choices(vocabulary, k=r.randint(1, 12))) for _ in range(2000)] + [" ".join(r.choices(sorted(set(vocabulary) - model.marks), k=r.randint(1, 30))) for _ in range(2000)]
    found = [p for p, (f, _, _) in zip(rows, model.classify(rows)) if f != "none"]
    assert len(found) > 100 and all(model.marks & set(L.words(p)) for p in found)


def test_wrapped_licences(spark, model):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in the Software\nwithout restriction."
    gpl = "# This program is free software: you can redistribute it and/or modify it under\n# the terms of the GNU General Public License as published by the Free Software\n# Foundation, either version 3 of the License, or (at your option) any later version."
    texts = [mit, "Title\n\n" + gpl + "\n\nEnd", "Released under the MIT License.\nAll rights reserved.", mit.replace("\n", " ")]
    got = L.scan(spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA), model=model).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got) == [(0, 0, "mit"), (1, 2, "gpl"), (2, 0, "mit"), (2, 1, "proprietary"), (3, 0, "mit")]
