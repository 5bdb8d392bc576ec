"""Licence families named in texts: a trained paragraph classifier, confirmed by templates.

DataFrame functions only. A paragraph is a line, or a run of neighbouring lines joined, as
notices are mostly wrapped; a blank line ends a run. Its features are the words and
word pairs it shares with a vocabulary drawn from short licence notices. Logistic
regressions, one for each family, are trained on pieces of the notices against paragraphs sampled from the
corpus; Platt scaling on the held-out half of both calibrates them, and a paragraph no family reaches with the
calibrated probability asked for is of the unknown class. A prediction counts when
the paragraph also shares enough word pairs with a notice of that family; families whose name
it lacks, or whose name it holds as part of another's, don't stand for election: notices of kin licences differ in little else.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.common import let, whole_text

# The usual short notices of the licence families.
TEMPLATES = {
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "CC-BY-ND": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
}
# Words and word pairs one of which stands in every notice of the family, and those that name another one next to it.
NAMES = {
    "AGPL": ("affero general", "agpl"),
    "Apache-2.0": ("version 2.0", "apache 2.0"),
    "BSD": ("bsd", "source and", "binary forms"),
    "CC-BY": ("attribution", "cc by"),
    "CC-BY-NC": ("attribution noncommercial", "by nc"),
    "CC-BY-ND": ("attribution noderivatives", "attribution noderivs", "by nd"),
    "EPL": ("eclipse public", "epl"),
    "GPL": ("gnu general", "gpl"),
    "ISC": ("isc", "without fee"),
    "LGPL": ("lesser general", "library general", "lgpl"),
    "MIT": ("mit", "of charge", "to deal"),
    "MPL-2.0": ("mozilla public", "mpl"),
    "Unlicense": ("unencumbered software", "unlicense"),
}
OTHERS = {
    "CC-BY": ("attribution noncommercial", "attribution noderivatives", "attribution noderivs", "by nc", "by nd"),
    "CC-BY-ND": ("attribution noncommercial", "by nc"),
}
FAMILIES = tuple(TEMPLATES)

#: Corpus documents (expected number, by a hash) and paragraphs (at most) that
#: stand for the unknown class in training.
SAMPLE_DOCS = 400
SAMPLE_PARAGRAPHS = 4_000
STEPS = 300
RATE = 0.5
RIDGE = 1e-3
#: Calibrated probability and share of a notice's word pairs that a finding needs.
SURE = 0.5
CONFIRM = 0.5

_SPLIT = "[^a-z0-9.]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: F.regexp_replace(w, r"\.", "") != "")


def _plain_words(text: str) -> list[str]:
    return [w.rstrip(".") or w for w in re.split(_SPLIT, text.lower()) if w.replace(".", "")]


def grams(words: Column) -> Column:
    """Distinct words without their last dots, and pairs of neighbours."""
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"\.+$", ""))
    return let(bare, lambda w: F.when(F.size(w) < 2, F.array_distinct(w)).otherwise(F.array_distinct(F.concat(
        w, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))))))


def _plain_grams(words: list[str]) -> set[str]:
    words = [w.rstrip(".") for w in words]
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def _pairs(text: str) -> list[str]:
    return sorted(g for g in _plain_grams(_plain_words(text)) if " " in g)


#: All notices' word pairs, and the words over which a run's pairs may lie: twice the longest notice, as what marks comment lines may be words.
PAIRS = sorted({p for ts in TEMPLATES.values() for t in ts for p in _pairs(t)})
REACH = 2 * max(len(_plain_words(t)) for ts in TEMPLATES.values() for t in ts)


@dataclass(frozen=True)
class Model:
    """Vocabulary, gate words, and for each family its weights, bias and Platt scale."""

    vocabulary: tuple[str, ...]
    gate: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]
    scale: tuple[tuple[float, float], ...]


def _regressions(x, y):
    """Weights and biases, a column for each family, of logistic regressions on presence features (a row each, 0 or 1),
    by gradient steps with class balance. ``y``: 1 where a row is of the family."""
    import numpy as np
    n = y.sum(axis=0)
    share = np.where(y == 1, 1 / (2 * np.maximum(1, n)), 1 / (2 * np.maximum(1, len(y) - n)))
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    for _ in range(STEPS):
        d = share * (1 / (1 + np.exp(-np.clip(x @ w + b, -500, 500))) - y)
        w, b = w - RATE * (RIDGE * w + x.T @ d), b - RATE * d.sum(axis=0)
    return w, b


def _platt(scores, y) -> tuple[float, float]:
    """a, c such that sigmoid(a * score + c) is calibrated on held-out scores (targets drawn in by one half-count)."""
    import numpy as np
    n = [int((y == k).sum()) for k in (0, 1)]
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    share = np.where(y == 1, 1 / (2 * max(1, n[1])), 1 / (2 * max(1, n[0])))
    a, c = 1.0, 0.0
    for _ in range(500):
        d = share * (1 / (1 + np.exp(-np.clip(a * scores + c, -500, 500))) - target)
        a, c = max(1e-3, a - 0.5 * float((d * scores).sum())), c - 0.5 * float(d.sum())
    return a, c


def fit(unknown: list[str], seed: int = 7) -> Model:
    """Model from the notices and ``unknown`` paragraphs; the same paragraphs give the same model."""
    import numpy as np
    rng = random.Random(seed)
    notices: list[tuple[set[str], int]] = []
    for f, family in enumerate(FAMILIES):
        for template in TEMPLATES[family]:
            words = _plain_words(template)
            notices += [(_plain_grams(words), f)] * 2
            for _ in range(10):  # what surrounds or cuts a notice in real texts
                a = rng.randrange(0, max(1, len(words) // 5))
                piece = words[a:len(words) - rng.randrange(0, max(1, len(words) // 5))]
                around = _plain_words(rng.choice(unknown)) if unknown else []
                k = rng.randrange(0, 6)
                notices.append((_plain_grams([*around[:k], *piece]), f))
    # Sampled paragraphs that are notices themselves, or pieces of wrapped ones, must not teach the opposite.
    pairs = [set(_pairs(t)) for ts in TEMPLATES.values() for t in ts]
    negatives = [g for g in (_plain_grams(_plain_words(t)) for t in sorted(unknown)) if not any(_of_notice(g, p) for p in pairs)]
    seen: dict[str, int] = {}
    for g in negatives:
        for x in g:
            seen[x] = seen.get(x, 0) + 1
    # All words and pairs of the notices, common or not: the regression weights them.
    vocabulary = sorted(set().union(*(_plain_grams(_plain_words(t)) for ts in TEMPLATES.values() for t in ts)))
    at = {x: i for i, x in enumerate(vocabulary)}
    rows = [*notices, *((g, -1) for g in negatives)]
    rng.shuffle(rows)
    features = np.zeros((len(rows), len(vocabulary)))
    for k, (g, _) in enumerate(rows):
        features[k, [at[x] for x in g if x in at]] = 1
    y = (np.array([f for _, f in rows])[:, None] == np.arange(len(FAMILIES))).astype(int)
    w, bias = _regressions(features[::2], y[::2])
    held = features[1::2] @ w + bias
    scale = [_platt(held[:, f], y[1::2, f]) for f in range(len(FAMILIES))]
    return Model(tuple(vocabulary), _gate(seen), tuple(map(tuple, w.T.tolist())), tuple(bias.tolist()), tuple(scale))


def _of_notice(grams: set[str], pairs: set[str]) -> bool:
    """Whether a paragraph has enough pairs of a notice, or consists of them for the most part."""
    own, shared = sum(" " in g for g in grams), len(pairs & grams)
    return shared >= CONFIRM * len(pairs) or (own >= 3 and 2 * shared >= own)


def _gate(seen: dict[str, int]) -> tuple[str, ...]:
    """Words of which every paragraph has one that can be confirmed, whatever was sampled: fewer than the share needed of each
    notice's pairs are without them. ``seen``, how many sampled paragraphs have a word, only chooses the rarer ones."""
    gate: set[str] = set()
    for ts in TEMPLATES.values():
        for pairs in map(_pairs, ts):
            for w in sorted({w for p in pairs for w in p.split(" ")}, key=lambda w: (seen.get(w, 0), w)):
                if sum(gate.isdisjoint(p.split(" ")) for p in pairs) < CONFIRM * len(pairs):
                    break
                gate.add(w)
    return tuple(sorted(gate))


def train(docs: DataFrame) -> Model:
    """Model whose unknown class is a bounded sample of the paragraphs of ``docs``."""
    total = docs.count()
    texts = docs.select(whole_text().alias("text"))
    h = F.pmod(F.xxhash64(F.lit("licences"), "text"), F.lit(1 << 40))
    if total > SAMPLE_DOCS:
        texts = texts.filter(h < int((1 << 40) * SAMPLE_DOCS / total))
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line").between(3, 5000)).distinct()
    rows = lines.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_PARAGRAPHS).collect()
    return fit([r["line"] for r in rows])


def _numbers(values) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def classify(line: Column, model: Model) -> Column:
    """struct<family, probability, similarity> of a paragraph; family null for the unknown class or an unconfirmed prediction.

    Of families with equal probability the last by name counts.
    """
    vocabulary = F.array(*[F.lit(x) for x in model.vocabulary])

    def linear(at: Column, weights, bias: float) -> Column:
        table = _numbers(weights)
        return F.aggregate(at, F.lit(bias), lambda z, i: z + F.get(table, i))

    def named(own: Column, family: str) -> Column:
        held = F.arrays_overlap(own, F.array(*[F.lit(x) for x in NAMES[family]]))
        return held & ~F.arrays_overlap(own, F.array(*[F.lit(x) for x in OTHERS[family]])) if family in OTHERS else held

    def predict(own: Column) -> Column:
        def probabilities(features: Column) -> Column:
            places = F.transform(features, lambda x: F.array_position(vocabulary, x).cast("int") - 1)
            return let(places, lambda at: F.array(*[
                F.struct(F.when(named(own, FAMILIES[k]), 1 / (1 + F.exp(-(a * linear(at, w, b) + c)))).otherwise(0.0).alias("p"), F.lit(k).alias("k"))
                for k, (w, b, (a, c)) in enumerate(zip(model.weights, model.bias, model.scale, strict=True))]))

        similar = F.array(*[F.greatest(*[F.size(F.array_intersect(own, F.array(*[F.lit(x) for x in _pairs(t)]))) / len(_pairs(t)) for t in TEMPLATES[f]])
                            for f in FAMILIES])
        names = F.array(*[F.lit(f) for f in FAMILIES])
        return let(probabilities(F.array_intersect(own, vocabulary)), lambda p: let(F.array_max(p), lambda best: let(
            F.get(similar, best["k"]), lambda s: F.struct(
                F.when((best["p"] >= SURE) & (s >= CONFIRM), F.get(names, best["k"])).alias("family"),
                best["p"].alias("probability"), s.alias("similarity")))))

    return let(grams(words_of(line)), predict)


def _runs(lines: Column) -> Column:
    """array<struct<a, b>>: the runs of two or more neighbouring lines, a to b from 0, whose word pairs can confirm a notice.

    The pairs of notices are looked up once in all the words; a run goes from a
    line to another that such pairs begin and end on, less than ``REACH`` words on.
    """
    def bare(line: Column) -> Column:
        return F.transform(words_of(line), lambda w: F.regexp_replace(w, r"\.+$", ""))

    # A blank line is one empty word, which is in no pair.
    words = F.flatten(F.transform(lines, lambda x, i: let(bare(x), lambda ws: F.transform(
        F.when(F.size(ws) > 0, ws).otherwise(F.array(F.lit(""))), lambda w: F.struct(w.alias("w"), i.alias("line"))))))

    def hits(ws: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda p: let(F.get(ws, p), lambda x: let(F.get(ws, p + 1), lambda y: F.struct(
            F.concat_ws(" ", x["w"], y["w"]).alias("pair"), x["line"].alias("a"), y["line"].alias("b"), p.alias("p")))))
        return F.when(F.size(ws) > 1, F.filter(pairs, lambda x: x["pair"].isin(PAIRS)))

    def confirmable(pairs: Column) -> Column:
        out = F.lit(False)
        for ts in TEMPLATES.values():
            for t in ts:
                own = _pairs(t)
                out = out | (F.size(F.array_intersect(pairs, F.array(*[F.lit(x) for x in own]))) >= CONFIRM * len(own))
        return out

    def runs(h: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(h) - 1)
        last = F.filter(steps, lambda j: F.coalesce(F.get(h, j + 1)["a"] != F.get(h, j)["a"], F.lit(True)))

        def ending(j: Column) -> Column:
            near = F.slice(h, F.greatest(j + 2 - REACH, F.lit(1)), F.lit(3 * REACH))
            ends = F.filter(F.slice(h, j + 1, F.lit(REACH)), lambda y: (y["b"] > F.get(h, j)["a"]) & (y["p"] < F.get(h, j)["p"] + REACH))
            spans = F.transform(F.array_distinct(F.transform(ends, lambda y: y["b"])), lambda b: F.struct(F.get(h, j)["a"].alias("a"), b.alias("b")))
            return F.filter(spans, lambda r: confirmable(F.transform(
                F.filter(near, lambda x: (x["a"] >= r["a"]) & (x["b"] <= r["b"])), lambda x: x["pair"])) & ~F.exists(
                    F.slice(lines, r["a"] + 1, r["b"] - r["a"] + 1), lambda x: F.size(words_of(x)) == 0))

        return F.flatten(F.transform(last, ending))

    none = F.array().cast("array<struct<a:int,b:int>>")
    return let(let(words, hits), lambda h: F.when(F.size(h) > 1, runs(h)).otherwise(none))


def _settled(found: Column) -> Column:
    """The findings that stay, most similar and then shortest first: none that shares a line with one of its family
    that stays, and none that is a piece of a more similar one that stays (a line of a wrapped notice can look like another family)."""
    ranked = F.array_sort(F.transform(found, lambda x: F.struct((-x["similarity"]).alias("_s"), (x["b"] - x["a"]).alias("_n"), x["a"].alias("_a"), x.alias("x"))))

    def add(kept: Column, r: Column) -> Column:
        x = r["x"]
        beaten = F.exists(kept, lambda y: ((y["family"] == x["family"]) & (y["a"] <= x["b"]) & (y["b"] >= x["a"]))
                          | ((y["a"] <= x["a"]) & (y["b"] >= x["b"]) & (y["similarity"] > x["similarity"])))
        return F.when(beaten, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(ranked, F.array().cast("array<struct<a:int,b:int,family:string,probability:double,similarity:double>>"), add)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, families (distinct, sorted), n_found, found: array<struct<paragraph, family, probability, similarity>> per document.

    Paragraphs are the lines, counted from 0, and the runs of neighbouring lines, counted by their first;
    a notice is found once, in the paragraph most similar to it. Whole texts are read; lines without any gate
    word have too few of any notice's pairs to be confirmed, so only others are classified. A null or
    empty text has no paragraphs; repeated rows stay; further columns are not read.
    """
    gate = F.array(*[F.lit(x) for x in model.gate])

    def touched(t: Column) -> Column:
        bare = F.transform(F.split(F.lower(t), _SPLIT), lambda w: F.regexp_replace(w, r"\.+$", ""))
        return F.arrays_overlap(bare, gate)

    def units(lines: Column) -> Column:
        single = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("text"), i.alias("a"), i.alias("b"))), lambda x: touched(x["text"]))
        joined = F.transform(_runs(lines), lambda r: F.struct(
            F.array_join(F.slice(lines, r["a"] + 1, r["b"] - r["a"] + 1), " ").alias("text"), r["a"].alias("a"), r["b"].alias("b")))
        return F.concat(single, joined)

    none = F.array().cast("array<struct<paragraph:int,family:string,probability:double,similarity:double>>")
    d = docs.select("doc_id", whole_text().alias("_text"))
    d = d.select("doc_id", F.when(touched(F.col("_text")), let(F.split("_text", "\n"), units)).alias("_units"))
    found = F.filter(F.transform("_units", lambda x: let(classify(x["text"], model), lambda c: F.struct(
        x["a"].alias("a"), x["b"].alias("b"), c["family"].alias("family"), c["probability"].alias("probability"), c["similarity"].alias("similarity")))),
        lambda x: x["family"].isNotNull())
    found = F.array_sort(F.transform(_settled(found), lambda x: F.struct(x["a"].alias("paragraph"), x["family"], x["probability"], x["similarity"])))
    return (d.select("doc_id", F.coalesce(F.when(F.size("_units") > 0, found), none).alias("found"))
             .select("doc_id", F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))).alias("families"),
                     F.size("found").cast("long").alias("n_found"), "found"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, licences (families, comma-joined, empty when none), n_found, probability (highest; null when none)."""
    rows = scan(docs, train(docs))
    return rows.select("doc_id", F.array_join("families", ",").alias("licences"), "n_found",
                       F.array_max(F.transform("found", lambda x: x["probability"])).alias("probability"))
