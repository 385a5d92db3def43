"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

Sparse word n-grams (1 to 3) feed a multinomial logistic regression over licence families and
"none". It is trained here, on the templates below with random damage and on paragraphs of the
corpus that have little of any template. Temperature scaling on held-out
paragraphs calibrates the probabilities; what is likely a licence but of no family for sure is
"unknown". A family stands only if the paragraph also covers one of its templates.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .common import picked, release

#: Sentences by which licences of each family are given in documents.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
#: The same licences by their names alone.
NAMES: dict[str, list[str]] = {
    "apache": ["Apache-2.0", "Apache License 2.0"],
    "mit": ["MIT License"],
    "gpl": ["GPL-3.0", "GPLv3", "GNU GPL v3", "GNU General Public License"],
    "lgpl": ["LGPL-2.1", "GNU Lesser General Public License"],
    "bsd": ["BSD-3-Clause", "BSD License"],
    "mpl": ["MPL-2.0", "Mozilla Public License 2.0"],
    "cc-by": ["CC BY 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0"],
    "cc-by-nc": ["CC BY-NC 4.0"],
    "cc0": ["CC0 1.0"],
}
#: Licence sentences of no family above, for the unknown class.
UNKNOWN = [
    "Licensed under the terms of the license agreement that comes with this product.",
    "This file is distributed under a license of its own.",
    "See the license for the specific language governing permissions.",
    "Licensed under the Example Community License, version 1.",
    "Use is subject to license terms.",
    "SPDX-License-Identifier: LicenseRef-Example",
    "You may copy this text under the conditions of the publisher's licence.",
]
FAMILIES = ["none", *TEMPLATES, "unknown"]
#: Corpus paragraphs that the classifier is fitted on, about, and copies of each template.
SAMPLE = 4000
COPIES = 40
#: A family needs this probability, and this share of a template's n-grams.
MIN_PROBABILITY, MIN_COVER = 0.5, 0.6
#: A sampled paragraph with this share of a template's n-grams is no example of "none".
MAX_SHARED = 0.25
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def ngrams(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


@dataclass
class Model:
    code: dict[tuple[str, ...], int]  # n-gram -> feature
    weights: np.ndarray  # features x families
    bias: np.ndarray
    temperature: float
    covers: list[tuple[int, set[int]]]  # family, features of a template, the sentences first and then the names
    sentences: int  # how many of these are sentences
    marks: set[str]  # a paragraph without one of these words can only be "none"

    def probabilities(self, paragraphs: list[str]) -> tuple[np.ndarray, list[set[int]]]:
        feats = [{self.code[g] for g in ngrams(words(p)) if g in self.code} for p in paragraphs]
        z = np.stack([self.bias + self.weights[sorted(f)].sum(0) / np.sqrt(len(f) + 1) for f in feats]) if feats else np.zeros((0, len(FAMILIES)))
        return _softmax(z / self.temperature), feats

    def classify(self, paragraphs: list[str]) -> list[tuple[str, float, float]]:
        """Family, its probability and the best cover of one of its templates."""
        p, feats = self.probabilities(paragraphs)
        out = []
        for q, f in zip(p, feats):
            k = int(q.argmax())
            if FAMILIES[k] == "none":
                out.append(("none", float(q[k]), 0.0))
                continue
            cover, family = max(((len(c & f) / len(c), -fam) for fam, c in self.covers), default=(0.0, 0))
            own = max((len(c & f) / len(c) for fam, c in self.covers if fam == k), default=0.0)
            if FAMILIES[k] != "unknown" and q[k] >= MIN_PROBABILITY and own >= MIN_COVER:
                out.append((FAMILIES[k], float(q[k]), own))
            elif 1 - q[0] >= MIN_PROBABILITY:
                out.append(("unknown", float(1 - q[0]), cover))
            else:
                out.append(("none", float(q[0]), cover))
        return out


    def find(self, text: str) -> list[tuple[int, str, float, float]]:
        """(line number, family, probability, cover) of licences in lines, and in runs of lines without a blank one.

        A run counts, at its first line, for a family that none of its lines gives (or only by its name, where the run has
        a sentence of it), or as unknown where none gives a licence. Lines that are mostly in a template of
        the run's family and give no other one are part of it.
        """
        lines = text.split("\n")
        marked = [not self.marks.isdisjoint(words(x)) for x in lines]
        own = {i: (i, *got) for i, got in self._hits([(i, lines[i]) for i, x in enumerate(marked) if x])}
        runs, lo = [], 0
        for i in range(len(lines) + 1):
            if i == len(lines) or not lines[i].strip():
                if i - lo > 1 and any(marked[lo:i]):
                    runs.append(((lo, i), "\n".join(lines[lo:i])))
                lo = i + 1
        out = []
        for (lo, hi), (family, p, cover) in self._hits(runs):
            have = {own[i][1] for i in range(lo, hi) if i in own}
            if family == "unknown":
                if not have:
                    out.append((lo, family, p, cover))
                continue
            whole = {i for i in range(lo, hi) if i in own and own[i][1] == family and self._sentence(lines[i], family)}
            if whole or (family in have and not self._sentence("\n".join(lines[lo:hi]), family)):
                continue
            for i in range(lo, hi):
                if i in own and own[i][1] in ("unknown", family) and self._part(lines[i], family):
                    del own[i]
            out.append((lo, family, p, cover))
        return sorted([*own.values(), *out])

    def _sentence(self, text: str, family: str) -> bool:
        """Whether a text has a whole sentence of the family, not only its name."""
        feats = {self.code[g] for g in ngrams(words(text)) if g in self.code}
        return any(len(c & feats) >= MIN_COVER * len(c) for fam, c in self.covers[: self.sentences] if FAMILIES[fam] == family)

    def _hits(self, paragraphs: list) -> list:
        """(key, (family, probability, cover)) of the (key, paragraph) that give a licence."""
        return [(k, got) for (k, _), got in zip(paragraphs, self.classify([p for _, p in paragraphs])) if got[0] != "none"]

    def _part(self, line: str, family: str) -> bool:
        grams = ngrams(words(line))
        feats = {self.code[g] for g in grams if g in self.code}
        return any(len(c & feats) >= MIN_COVER * len(grams) for fam, c in self.covers if FAMILIES[fam] == family)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return e / e.sum(1, keepdims=True) if len(z) else z


def _damaged(r: random.Random, text: str, filler: list[str]) -> str:
    """A template as it may be met: cut, with other words around or in it, or with other numbers."""
    w = text.split()
    for _ in range(r.choice([0, 0, 0, 1, 2])):
        i = r.randrange(len(w))
        if r.random() < 0.5:
            w[i] = r.choice(filler)
        elif len(w) > 3:
            del w[i]
    return " ".join(r.choices(filler, k=r.choice([0, 0, 0, 3, 12])) + w + r.choices(filler, k=r.choice([0, 0, 0, 3, 12])))


def _tells(copy: str, template: str, family: str) -> bool:
    """Whether a damaged template still says which family it is of: half of it, and one of the words that only that family has."""
    have, given = ngrams(words(copy)), ngrams(words(template))
    others = {w for f, ts in [*TEMPLATES.items(), *NAMES.items(), ("unknown", UNKNOWN)] if f != family for t in ts for w in words(t)}
    own = set(words(template)) - others
    return len(have & given) >= len(given) / 2 and (not own or bool(own & set(words(copy))))


def fit(negatives: list[str], seed: int = 5, rounds: int = 400) -> Model:
    r = random.Random(seed)
    filler = [w for p in negatives for w in p.split()] or ["lorem"]
    rows: list[tuple[str, int]] = [(p, 0) for p in negatives]
    for family, texts in [*TEMPLATES.items(), ("unknown", UNKNOWN)]:
        for t in texts:
            copies = [t if i < 3 else _damaged(r, t, filler) for i in range(COPIES)]
            rows += [(c, FAMILIES.index(family)) for c in copies if _tells(c, t, family)]
    for family, texts in NAMES.items():
        rows += [(" ".join([*r.choices(filler, k=r.choice([0, 0, 3, 12])), t, *r.choices(filler, k=r.choice([0, 0, 3, 12]))]), FAMILIES.index(family)) for t in texts for _ in range(COPIES)]
    # licence words in ordinary sentences are no licence
    vocabulary = sorted({w for ts in [*TEMPLATES.values(), *NAMES.values(), UNKNOWN] for t in ts for w in words(t)})
    bare = [w for w in vocabulary if not any(w in words(t) and len(words(t)) == 1 for ts in NAMES.values() for t in ts)]
    joining = [w for w in bare if sum(w in {x for t in ts for x in words(t)} for ts in [*TEMPLATES.values(), UNKNOWN]) > 2 and not w.startswith("licen")]
    mixed = filler + joining * (len(filler) // (len(joining) or 1))
    two = sorted({g for ts in [*TEMPLATES.values(), UNKNOWN] for t in ts for g in ngrams(words(t)) if len(g) == 2 and set(g) <= set(bare) and set(g) & set(joining)})
    for w in [*[(w,) for w in bare * 12], *two * 4]:
        plain = r.choices(r.choice([mixed, mixed, joining or filler]), k=r.choice([2, 8, 15, 30]))
        rows.append((" ".join([*plain, *w, *r.choices(bare, k=r.choice([0, 0, 1]))]), 0))
    code: dict[tuple[str, ...], int] = {}
    for ts in [*TEMPLATES.values(), *NAMES.values(), UNKNOWN]:
        for t in ts:
            for g in ngrams(words(t)):
                code.setdefault(g, len(code))
    m = Model(code, np.zeros((len(code), len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0, [], 0, set())
    r.shuffle(rows)
    y = np.array([k for _, k in rows])
    x = np.zeros((len(rows), len(code)), np.float32)
    for i, (p, _) in enumerate(rows):
        f = sorted({code[g] for g in ngrams(words(p)) if g in code})
        x[i, f] = 1 / np.sqrt(len(f) + 1)
    held = np.arange(len(rows)) % 5 == 0
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    w, b = np.zeros((len(code), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    xt, tt = x[~held], target[~held]
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):  # gradient descent with momentum
        g = (_softmax(xt @ w + b) - tt) / len(xt)
        vw, vb = 0.9 * vw - 4.0 * (xt.T @ g + 2e-5 * w), 0.9 * vb - 4.0 * g.sum(0)
        w, b = w + vw, b + vb
    m.weights, m.bias = w, b
    z, k = x[held] @ w + b, y[held]
    losses = {t: -np.log(_softmax(z / t)[np.arange(len(k)), k] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    m.temperature = min(losses, key=losses.get)
    m.covers = [(FAMILIES.index(f), {code[g] for g in ngrams(words(t))}) for f, ts in [*TEMPLATES.items(), *NAMES.items()] for t in ts]
    m.sentences = sum(map(len, TEMPLATES.values()))
    m.marks = _marks(m, negatives)
    return m


def _marks(m: Model, negatives: list[str]) -> set[str]:
    """Words that a paragraph needs one of for any family to score above "none".

    By the weights: a family is ahead only if its n-grams' gains over "none" make up for the bias, and for no
    family can those n-grams do so that are made of other words alone. Frequent words are left out first.
    """
    grams = list(m.code)
    gain = np.maximum(m.weights[:, 1:] - m.weights[:, :1], 0).astype(np.float64)
    short = (m.bias[0] - m.bias[1:]).astype(np.float64) - 1e-4  # float32 sums
    vocabulary = {g[0] for g in grams if len(g) == 1}
    seen: dict[str, int] = {}
    for p in negatives:
        for w in set(words(p)) & vocabulary:
            seen[w] = seen.get(w, 0) + 1
    inside, has = np.zeros(len(grams), bool), {w: [i for i, g in enumerate(grams) if w in g] for w in vocabulary}
    out: set[str] = set()
    for w in sorted(vocabulary, key=lambda w: (-seen.get(w, 0), len(has[w]), w)):
        new = [i for i in has[w] if all(x == w or x in out for x in grams[i])]
        inside[new] = True
        best = np.sort(gain[inside], 0)[::-1].cumsum(0)
        if (best / np.sqrt(np.arange(2, len(best) + 2))[:, None] <= short).all():
            out.add(w)
        else:
            inside[new] = False
    return vocabulary - out


def _any_of(words: set[str]) -> str:
    """A pattern of any of the words that tries each first letter once, then each second one, and so on."""
    after: dict[str, set[str]] = {}
    for w in words:
        if w:
            after.setdefault(w[0], set()).add(w[1:])
    parts = [re.escape(c) + _any_of(rest) for c, rest in sorted(after.items())]
    if not parts:
        return "" if words else "(?!)"
    return "(?:" + "|".join(parts) + ")" + ("?+" if "" in words else "")


def sample_paragraphs(docs: DataFrame, n: int = SAMPLE) -> list[str]:
    """About ``n`` paragraphs: one of each document, by the key's hash, at a rate from the count. Those that have much of a
    template are no example of "none"; ordinary ones with a licence's words are."""
    total = docs.count()
    if not total:
        return []
    u = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1_000_000_007)) / 1_000_000_007.0
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 8)
    some = docs.where(u < min(1.0, n / total)).select("id", F.get(lines, F.pmod(F.xxhash64("id"), F.greatest(F.size(lines), F.lit(1))).cast("int")).alias("p"))
    got = [(r.p, str(r.id)) for r in some.where("p is not null").collect()]
    known = [ngrams(words(t)) for ts in [*TEMPLATES.values(), *NAMES.values(), UNKNOWN] for t in ts]
    return [p for p, _ in sorted(got, key=lambda x: (x[1], x[0])) for grams in [ngrams(words(p))] if not any(len(k & grams) >= MAX_SHARED * len(k) for k in known)]


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None) -> DataFrame:
    """A row (key, paragraph, family, probability, cover) for each paragraph that gives a licence.

    Paragraphs are lines and runs of lines that no blank line divides, numbered from 0 by their (first) line, whole
    texts; what is wrapped over lines has the row of its run (``Model.find``). ``family`` "unknown" is a licence of no
    known family or one that its templates don't confirm. Texts without a licence, null and empty ones
    have no row; rows with equal or null keys are scanned one by one. Narrow: no shuffle.
    """
    docs = picked(df, id=key, text=text)
    model = model or fit(sample_paragraphs(docs))
    shared = df.sparkSession.sparkContext.broadcast(model)  # templates' n-grams: fixed size
    schema = T.StructType([T.StructField(key, docs.schema["id"].dataType), T.StructField("paragraph", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("cover", T.DoubleType())])
    # The classifier's marks by themselves, in the JVM: only texts with one can have anything but "none".
    rows = docs.where(F.concat(F.lit(" "), F.lower("text")).rlike("[^a-z\\p{L}\\p{N}]" + _any_of(model.marks) + "(?![\\p{L}\\p{N}])"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = shared.value
        for b in batches:
            got = [(i, *x) for i, t in enumerate(b.column(1).to_pylist()) for x in m.find(t)]
            at, paragraph, family, p, cover = zip(*got) if got else ((),) * 5
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(paragraph, pa.int32()), pa.array(family, pa.string()), pa.array([round(x, 4) for x in p], pa.float64()), pa.array([round(x, 4) for x in cover], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema)
