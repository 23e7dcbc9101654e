"""Licence notices: a sparse word n-gram logistic regression over paragraphs, confirmed by comparison with templates.

The classifier is trained here, on the driver, from the templates below, whose number bounds the sample, and from texts that
talk of licences without granting one. Its features are word 1- to 3-grams with a word that is not a common one; an L1
penalty leaves few of them with weight. ``covers`` are words of which each n-gram that speaks for a licence more than for
the unknown class has at least one, so a paragraph without any of them is ``unknown`` by the sums and needs no row. Scoring is a join of a paragraph's weighted n-grams with the weight table, whose size is fixed by the templates.
"""

from __future__ import annotations

import collections
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Notices by family, in words that their licences fix: short grants and sentences of the licences themselves.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Released under CC0 1.0 Universal Public Domain Dedication.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "All rights reserved. Unauthorized copying is prohibited.", "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited."],
}
#: Texts of the unknown class.
OTHER = [
    "You need a driving license to rent a car.", "The license fee was paid last year.", "The software is old.", "He lost his licence in the city.", "The public was free to enter.",
    "Apache helicopters flew over the town.", "A student at MIT wrote the paper.", "The general spoke in public.", "All rights matter.", "The copyright office opens at nine.",
    "The version of the story was new.", "They released the bird.", "A creative mind works in common rooms.", "The foundation gave money to the school.", "Permission was asked for and not given.",
    "The source of the river is in the hills.", "A mozilla is no animal.", "Terms of the contract were read aloud.", "The work is done.", "BSD users met in the hall.", "GNU live in herds.", "cc the manager by mail.",
    "The warranty of the washing machine ended in May.", "Sign the form and send a copy of the file to the office.", "The library is open and the program of the evening is free.", "Food was distributed under the bridge.",
    "Which license should we choose for the project?", "The court spoke of the rights of any person.", "Conditions of use are on the next page.", "The purpose of the notice was not clear.", "The hotel is licensed to sell beer.",
    "Distribution of the leaflets is permitted in the park.", "The binary system has two digits.", "We compared the GPL, the MIT licence and the Apache licence in a lecture.", "Files of the charity are in the basement.", "The domain of the function is the real line.",
]
#: Words that make no feature on their own.
COMMON = "a an and any are as at be but by can for from has have in is it its may must not of on one or that the this to under use was we were which with without you your all above following either none new each if no more here see only over other into he his they she should shall last next two".split()
#: Words of the longest n-gram.
LONGEST = 3
#: A family counts from this probability on, and is confirmed from this share of a template's word pairs on.
MIN_PROBABILITY = 0.5
MIN_LIKENESS = 0.7
#: A paragraph that is a part of a template confirms it only if it has this many word pairs.
FRAGMENT = 5
#: L1 penalty, folds of templates in calibration and steps of the fit.
PENALTY, FOLDS, STEPS = 0.0004, 4, 250
#: Ends of paragraphs: a line end behind a sentence's end, or lines without a letter or digit.
BREAK = r"\n[^\p{L}\p{N}]*\n|(?<=[.!?])[ \t\r]*\n"


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams(tokens: list[str]) -> set[str]:
    """Distinct n-grams of up to three words with a word of letters that is not a common one."""
    runs = [tokens[k : k + n] for n in range(1, LONGEST + 1) for k in range(len(tokens) - n + 1)]
    return {" ".join(r) for r in runs if any(_telling(w) for w in r)}


def _telling(word: str) -> bool:
    return len(word) > 1 and not word.isdigit() and word not in COMMON


def pairs(tokens: list[str]) -> set[str]:
    """Distinct pairs of adjacent words."""
    return {" ".join(tokens[k : k + 2]) for k in range(len(tokens) - 1)}


def key(gram: str) -> int:
    """What ``xxhash64`` of Spark SQL gives for the n-gram."""
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return h - 2**64 if h >> 63 else h


@dataclass(frozen=True)
class Model:
    families: list[str]
    bias: np.ndarray
    weights: dict[str, np.ndarray]
    temperature: float
    covers: list[str]


def _variants(text: str) -> list[str]:
    """The text, with words around it, and runs of eight of its words if it is long."""
    tokens = words(text)
    cut = [" ".join(tokens[k : k + 8]) for k in range(0, len(tokens) - 4, 4)] if len(tokens) >= 16 else []
    return [text, f"Notice: {text}", f"The code is here. {text} See the file for more.", *cut]


@lru_cache(maxsize=1)
def train() -> Model:
    """Multinomial logistic regression with an L1 penalty (accelerated proximal gradients), then calibration.

    The temperature is fitted to the likelihood of whole templates and other texts, bare and with words around, of which a
    fit has seen no variant: every fourth of a family's templates and of the other texts in turn.
    """
    families = [*TEMPLATES, UNKNOWN]
    rows, group, whole = [("", len(TEMPLATES))] * 4, [-1] * 4, [False] * 4
    for k, texts in enumerate([*TEMPLATES.values(), OTHER]):
        for n, text in enumerate(texts):
            found = _variants(text)
            rows += [(v, k) for v in found]
            group += [n % FOLDS] * len(found)
            whole += [j < 3 for j in range(len(found))]
    vocabulary = sorted({g for text, _ in rows for g in grams(words(text))})
    index = {g: k for k, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
    x[:, -1] = 1
    for r, (text, _) in enumerate(rows):
        for g in grams(words(text)):
            x[r, index[g]] = 1
    y, group = np.eye(len(families), dtype=np.float32)[[k for _, k in rows]], np.array(group)
    share = 1 / y.sum(0)[y.argmax(1)]  # every family weighs the same

    def fit(use: np.ndarray) -> np.ndarray:
        a, b, c = x[use], y[use], (share[use] / share[use].sum())[:, None]
        step = 1 / np.linalg.norm(a * np.sqrt(c), 2) ** 2
        w = v = np.zeros((x.shape[1], len(families)), np.float32)
        t = 1.0
        for _ in range(STEPS):
            new = v - step * (a.T @ (c * (_softmax(a @ v) - b)))
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * PENALTY, 0)
            s = (1 + np.sqrt(1 + 4 * t * t)) / 2
            w, v, t = new, new + (t - 1) / s * (new - w), s
        return w

    held = np.zeros_like(y)
    for k in range(FOLDS):
        held[group == k] = x[group == k] @ fit(np.flatnonzero(group != k))
    temperatures = np.geomspace(0.2, 5, 60)
    losses = [-(share * np.log((_softmax(held / t) * y).sum(1) + 1e-12))[whole].sum() for t in temperatures]
    w = fit(np.arange(len(rows))).astype(float)
    weights = {g: w[k] for g, k in index.items() if np.any(w[k])}
    telling = [set(g.split()) for g, v in weights.items() if v[:-1].max() > v[-1]]
    return Model(families, w[-1], weights, float(temperatures[int(np.argmin(losses))]), _covers(telling))


def _covers(sets: list[set[str]]) -> list[str]:
    """Words that are not common ones, greedily few, of which each set has one."""
    left, out = [{w for w in s if _telling(w)} for s in sets], []
    while left:
        counts = collections.Counter(w for s in left for w in s)
        out.append(min(counts, key=lambda w: (-counts[w], w)))
        left = [s for s in left if out[-1] not in s]
    return sorted(out)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _keys(tokens: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, n), " ")))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph, family, probability, likeness, confirmed for each paragraph with a word of ``covers``.

    Paragraphs end at a line end behind ``.``, ``!`` or ``?`` and at lines without a letter or digit, so a notice over
    several lines is one; they are numbered from 0. Words are runs of ASCII letters and digits in any case, so comment
    marks and underscores are none. ``probability`` is that of the likeliest family, ``unknown`` among them (of equal ones
    the first of ``TEMPLATES``). ``likeness`` is the largest share of word pairs of one of its templates that stand in the
    paragraph or, for paragraphs with ``FRAGMENT`` pairs or more, of the paragraph's that stand in the template.
    ``family`` is ``unknown`` if no licence reaches the least probability or no template confirms it; ``confirmed`` is
    false then. Null and empty texts have no rows, repeated rows have theirs each, null ids stay; an empty table gives
    none. Only the two named columns are read, so others may have any name.
    """
    spark = docs.sparkSession
    model = train()
    families, known = model.families, [sorted(pairs(words(t))) for f in TEMPLATES.values() for t in f]
    # one row a paragraph; rows with the same id and text are counted instead of numbered, which a rerun could do otherwise
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    found = found.select("doc_id", F.sha2("text", 256).alias("document"), F.posexplode(F.split("text", BREAK)).alias("paragraph", "text"))
    found = found.withColumn("tokens", F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: t != ""))
    found = found.where(F.arrays_overlap("tokens", F.split(F.lit(" ".join(model.covers)), " ")))
    two = _keys(F.col("tokens"), 2)
    every = F.concat(_keys(F.col("tokens"), 1), two, _keys(F.col("tokens"), 3))
    template_pairs = sorted({key(p) for t in known for p in t})
    found = found.select(
        "doc_id",
        "document",
        "paragraph",
        F.array_intersect(every, _longs([key(g) for g in model.weights])).alias("features"),
        F.array_intersect(two, _longs(template_pairs)).alias("seen"),
        F.size(F.array_distinct(two)).alias("n_pairs"),
    )
    table = spark.createDataFrame([(key(g), [float(v) for v in w]) for g, w in sorted(model.weights.items())], "feature bigint, weights array<double>")
    by = ["doc_id", "document", "paragraph", "seen", "n_pairs"]
    scored = found.select(*by, F.posexplode_outer("features").alias("nth", "feature"))
    scored = scored.join(F.broadcast(table), "feature", "left")  # the weights' number is fixed by the templates
    names = [f"z{k}" for k in range(len(families))]
    copies = F.sum(F.when(F.coalesce("nth", F.lit(0)) == 0, 1).otherwise(0))
    scored = scored.groupBy(*by).agg(copies.alias("copies"), *[F.coalesce(F.sum(F.get("weights", k)), F.lit(0.0)).alias(n) for k, n in enumerate(names)])
    z = F.array(*[(F.col(n) / F.col("copies") + float(b)) / model.temperature for n, b in zip(names, model.bias, strict=True)])
    scored = scored.select(*by, "copies", z.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    scored = scored.withColumn("best", F.array_position("z", F.col("top")).cast("int") - 1).withColumn("probability", F.round(1 / total, 6))
    likeness: Column = F.lit(0.0)
    for k, family in enumerate(TEMPLATES):
        likeness = F.when(F.col("best") == k, F.greatest(F.lit(0.0), *[_share(sorted(pairs(words(t)))) for t in TEMPLATES[family]])).otherwise(likeness)
    scored = scored.withColumn("likeness", F.round(likeness, 6))
    confirmed = (F.col("best") < len(families) - 1) & (F.col("probability") >= MIN_PROBABILITY) & (F.col("likeness") >= MIN_LIKENESS)
    name = F.element_at(F.array(*map(F.lit, families)), F.col("best") + 1)
    out = scored.select("doc_id", "paragraph", F.when(confirmed, name).otherwise(UNKNOWN).alias("family"), "probability", "likeness", confirmed.alias("confirmed"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return out.drop("copy")


def _share(template: list[str]) -> Column:
    """Share of the template's pairs in the paragraph or, if that has enough, of its own pairs in the template."""
    same = F.size(F.array_intersect("seen", _longs([key(p) for p in template])))
    whole = same / F.lit(len(template))
    return F.when(F.col("n_pairs") >= FRAGMENT, F.greatest(whole, same / F.col("n_pairs"))).otherwise(whole)
