"""License scans: which licence families the paragraphs of a document name.

Paragraphs (lines with words) are classified by logistic regression over
sparse word 1-, 2- and 3-grams, trained on variants of the notices below
against ordinary sentences. One class is ``unknown``, everything that is no
notice of a family; the temperature of the probabilities and the least
probability of a family are calibrated on variants of notices and sentences
that a model has not seen, each part of them left out in turn. A
predicted family counts as confirmed only if the paragraph holds enough of one
of that family's notices, word run by word run, or is itself a part of one: a
cut notice or a line of a wrapped one. Such lines are also compared together
with the lines around them, up to an empty line, and adjacent ones of a family
are one licence.

Training is a few hundred short texts on the driver. Scanning is DataFrame
functions alone: the grams of a paragraph meet the model's, a table bounded by
the notices below that is broadcast, and what meets is added up per paragraph
in the task that read it. Paragraphs without any gram of the model are unknown.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import once

# Notices of licence families, as their publishers word them.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the 3-clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "https://creativecommons.org/licenses/by/4.0/",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "https://creativecommons.org/licenses/by-nc/4.0/",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright 2021 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form without the prior written permission of the publisher.",
    ],
}
# Sentences that share words with notices but are none.
ORDINARY = [
    "The driver's license expired last year and had to be renewed at the office.",
    "Researchers at MIT released a study about the weather in the north.",
    "The Apache helicopter landed near the river before noon.",
    "Permission to enter the building was granted by the guard at the gate.",
    "The phone comes with a warranty of two years and a free case.",
    "The public library is free and open to any person on any day.",
    "All rooms are reserved for the conference, so we have to stay elsewhere.",
    "She used the following list of conditions to describe the weather.",
    "Human rights and the rights of workers were discussed in the assembly.",
    "The general public may visit the works of the foundation in any form.",
    "The new version of the program was published with a notice to all users.",
    "A creative person finds common attributes in works of any kind.",
    "The software is distributed to schools and can be used without a fee.",
    "He read the source of the story and wrote a copy by hand.",
    "The commercial was shown on television four times in one evening.",
    "The terms of the agreement were not made public by the company.",
    "The file is stored in the system, and a copy was sent to the author.",
    "With the law as it is, the court may not use this in its ruling.",
    "In the beginning it was part of a form that the office had to sign.",
    "The town lies by the sea, and most of its houses are of stone.",
    "Wir haben das Haus am Fluss gesehen und sind dann nach Hause gegangen.",
    "La maison est au bord de la rivière et les enfants jouent dans le jardin.",
    "La casa está cerca del río y los niños juegan en el jardín por la tarde.",
    "The mean of the values is larger than the median in most of the groups.",
]
UNKNOWN = "unknown"
# Words too common to be features by themselves.
COMMON = set("a an and any as at be by for from in is it its no not of on or that the this to was were with you i we he she they are has have had can may one all s".split())
#: Words of the longest gram; share of a notice's word runs that confirms it; variants per notice; seed.
GRAMS, CONFIRM, VARIANTS, SEED = 3, 0.6, 24, 7
#: Parts of the sources that are left out in turn to calibrate.
FOLDS = 3
#: Words that a part of a notice has at least, as in training; lines before and after that may belong to the same notice.
PART, AROUND = 8, 7
#: Share of held-out ordinary texts that may be taken for a family.
FALSE_ALARMS = 0.005


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams_of(words: list[str]) -> set[str]:
    found = {" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}
    return {g for g in found if not COMMON.issuperset(g.split())}


def _variants(rng: random.Random, text: str, filler: list[str], n: int) -> list[list[str]]:
    """A text as found in the wild: inside other words, cut, with words lost."""
    base, out = words_of(text), [words_of(text)]
    for _ in range(n - 1):
        words = [w for w in base if rng.random() > 0.06] or base
        if len(words) > 12 and rng.random() < 0.4:
            words = words[: rng.randrange(8, len(words))]
        before, after = ([rng.choice(filler) for _ in range(rng.choice((0, 0, 2, 6)))] for _ in range(2))
        out.append(before + words + after)
    return out


class Model:
    """The classes, the grams with their weights, and what calibration found."""

    def __init__(self) -> None:
        rng = random.Random(SEED)
        self.classes = [UNKNOWN, *sorted(NOTICES)]
        filler = [w for s in ORDINARY for w in words_of(s)]
        #: (class, words, number of the source): variants of one source are never on both sides of a fold.
        rows: list[tuple[int, list[str], int]] = []
        sources = 0
        for family, notices in NOTICES.items():
            for notice in notices:
                rows += [(self.classes.index(family), v, sources) for v in _variants(rng, notice, filler, VARIANTS)]
                sources += 1
        notice_words = [w for texts in NOTICES.values() for t in texts for w in words_of(t)]
        for sentence in ORDINARY:
            rows += [(0, v, sources) for v in _variants(rng, sentence, filler, VARIANTS)]
            sources += 1
        for k in range(40 * VARIANTS):  # single words of notices in other surroundings
            words = [rng.choice(filler) for _ in range(rng.randrange(3, 40))]
            words[rng.randrange(len(words))] = rng.choice(notice_words)
            rows.append((0, words, sources + k))
        rng.shuffle(rows)
        unseen, truth = [], []
        for k in range(FOLDS):
            test = [r for r in rows if r[2] % FOLDS == k]
            self._learn([r for r in rows if r[2] % FOLDS != k])
            x, y = self._matrix(test)
            unseen.append(x @ self.weights + self.bias)
            truth.append(y)
        self._calibrate(np.concatenate(unseen), np.concatenate(truth))
        self._learn(rows)

    def _learn(self, rows: list[tuple[int, list[str], int]]) -> None:
        """The grams that notices among ``rows`` have, and their weights."""
        counts: dict[str, int] = {}
        known: set[str] = set()
        for c, words, _ in rows:
            found = grams_of(words)
            known |= found if c else set()
            for g in found:
                counts[g] = counts.get(g, 0) + 1
        of_notices = {g for texts in NOTICES.values() for t in texts for g in grams_of(words_of(t))} & known
        self.index = {g: i for i, g in enumerate(sorted(g for g, n in counts.items() if n >= 3 and g in of_notices))}
        self.weights, self.bias = self._fit(rows)

    def _features(self, words: list[str]) -> list[int]:
        return [self.index[g] for g in grams_of(words) if g in self.index]

    def _matrix(self, rows: list[tuple[int, list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(self.index)), np.float32)
        for k, (_, words, _) in enumerate(rows):
            x[k, self._features(words)] = 1
        return x, np.array([c for c, _, _ in rows])

    def _fit(self, rows: list[tuple[int, list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        """Multinomial logistic regression: gradient steps with momentum, then weights near nought are dropped."""
        x, y = self._matrix(rows)
        target = np.eye(len(self.classes), dtype=np.float32)[y]
        w, b = np.zeros((x.shape[1], len(self.classes)), np.float32), np.zeros(len(self.classes), np.float32)
        b[0] = 1
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(250):
            p = _softmax(x @ w + b)
            vw = 0.9 * vw - 2.0 * (x.T @ (p - target) / len(x) + 1e-4 * w)
            vb = 0.9 * vb - 2.0 * (p - target).mean(0)
            w, b = w + vw, b + vb
        w[np.abs(w) < 0.05] = 0
        return w.astype(float), b.astype(float)

    def _calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        """The temperature and the least probability, from texts whose sources the fold's model has not seen."""
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
        self.temperature = min((0.25 * 1.15**k for k in range(24)), key=loss)
        p = _softmax(logits / self.temperature)
        wrong = np.sort(p[y == 0, 1:].max(1))
        allowed = int(FALSE_ALARMS * len(wrong))
        self.least = float(wrong[len(wrong) - 1 - allowed])  # what one in 1 / FALSE_ALARMS unseen ordinary texts exceeds
        said = np.where(p[:, 1:].max(1) >= self.least, p[:, 1:].argmax(1) + 1, 0)
        #: Of texts of unseen sources: how many get their class, and how many of the families' do.
        self.accuracy, self.recall_unseen = float((said == y).mean()), float((said == y)[y > 0].mean())

    def predict(self, text: str) -> tuple[str, float]:
        """The class of one paragraph and its probability, as the scan computes it."""
        logits = (self.bias + self.weights[self._features(words_of(text))].sum(0)) / self.temperature
        p = _softmax(logits[None])[0]
        best = int(p[1:].argmax()) + 1
        return (self.classes[best], float(p[best])) if p[best] >= self.least else (UNKNOWN, float(p[0]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@cache
def model() -> Model:
    return Model()


def _tables(spark: SparkSession, own: Model) -> tuple[DataFrame, DataFrame]:
    """The grams with their weights, and the notices with their word runs: both of a size that the notices above bound."""
    used = [(g, [float(v) for v in own.weights[i]]) for g, i in own.index.items() if own.weights[i].any()]
    grams = spark.createDataFrame(used, "gram string, w array<double>")
    notices = [(family, _runs(words_of(t))) for family, texts in NOTICES.items() for t in texts]
    return F.broadcast(grams), F.broadcast(spark.createDataFrame(notices, "family string, runs array<string>"))


def _runs(words: list[str]) -> list[str]:
    n = min(GRAMS, len(words))
    return sorted({" ".join(words[i : i + n]) for i in range(len(words) - n + 1)})


def paragraph_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, key, at, family, probability, held, whole, confirmed) of each line that is predicted to be a family's notice.

    whole: the line has enough of a notice by itself; otherwise it is confirmed
    as a part of one, by its own words or with the lines around it.
    """
    spark, own = docs.sparkSession, model()
    grams, notices = _tables(spark, own)
    # Every gram of the model has a word of its own; texts without such a word hold no gram, and need no more.
    own_word = sorted({w for g in own.index for w in g.split()} - COMMON)
    docs = docs.where(F.exists(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w.isin(own_word)))
    lines = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("key"), F.posexplode_outer(F.split(text, "\n")).alias("at", "line"))
    words = once(lines, "w", F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9]+"), F.lit(0))).drop("line")

    def runs(k: int, w: str = "w"):
        n = F.size(w)
        joined = lambda i: F.concat_ws(" ", *(F.get(F.col(w), i + j) for j in range(k)))
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), joined)).otherwise(F.array().cast("array<string>"))

    all_grams = F.array_distinct(F.concat(F.col("w"), *(runs(k) for k in range(2, GRAMS + 1))))
    met = words.select("d", "key", "at", F.explode_outer(all_grams).alias("gram")).join(grams, "gram")
    sums = [F.sum(F.get("w", F.lit(c))).alias(f"s{c}") for c in range(len(own.classes))]
    scored = met.groupBy("d", "key", "at").agg(*sums)
    logits = [(F.col(f"s{c}") + float(own.bias[c])) / own.temperature for c in range(len(own.classes))]
    families = F.array(*(F.struct(z.alias("z"), F.lit(name).alias("family")) for z, name in zip(logits[1:], own.classes[1:])))
    scored = once(scored.select("d", "key", "at", F.array(*logits).alias("z"), F.array_max(families).alias("best")), "top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top")))
    best = scored.select("d", "key", "at", F.col("best.family").alias("family"), (F.exp(F.col("best.z") - F.col("top")) / total).alias("probability"))
    best = best.where(F.col("probability") >= own.least)

    # The few lines that are left meet the notices of their family, on their own words again and on those around them.
    sources = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("key"), F.split(text, "\n").alias("ls"))
    at = F.col("at")
    blank = lambda line: ~F.lower(line).rlike("[a-z0-9]")
    before = F.aggregate(F.slice("ls", F.greatest(at - AROUND, F.lit(0)) + 1, F.least(at, F.lit(AROUND))), F.lit(""), lambda a, x: F.when(blank(x), F.lit("")).otherwise(F.concat(a, F.lit(" "), x)))
    after = F.aggregate(F.reverse(F.slice("ls", at + 2, F.lit(AROUND))), F.lit(""), lambda a, x: F.when(blank(x), F.lit("")).otherwise(F.concat(x, F.lit(" "), a)))
    line = F.get("ls", at)
    found = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    of = best.withColumnsRenamed({"d": "of_d", "key": "of_key"})
    own_words = sources.join(of, F.col("d").eqNullSafe(F.col("of_d")) & (F.col("key") == F.col("of_key"))).select("d", "key", "at", "family", "probability", found(line).alias("w"), found(F.concat_ws(" ", before, line, after)).alias("near"))
    grams_in = lambda w: F.concat(F.col(w), *(runs(k, w) for k in range(2, GRAMS + 1)))
    own_words = own_words.withColumn("own", F.array_distinct(runs(GRAMS))).withColumn("g", grams_in("w")).withColumn("gn", grams_in("near"))
    compared = own_words.join(notices, "family")
    share = lambda g: F.size(F.array_intersect("runs", g)) / F.size("runs")
    part = F.when(F.size("w") >= PART, F.try_divide(F.size(F.array_intersect("runs", "own")), F.size("own"))).otherwise(F.lit(0.0))
    compared = compared.withColumn("held", share("g")).withColumn("part", F.greatest(share("gn"), part))
    scored = compared.groupBy("d", "key", "at", "family", "probability").agg(F.max("held").alias("held"), F.max("part").alias("part"))
    return scored.withColumn("whole", F.col("held") >= CONFIRM).withColumn("confirmed", F.col("whole") | (F.col("part") >= CONFIRM)).drop("part")


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_paragraphs, n_licenses, families, family, probability and n_unconfirmed.

    n_paragraphs counts lines with a word of ASCII letters or digits;
    n_licenses those whose predicted family the notices confirm, where adjacent
    lines that are parts of a family's notice are one, n_unconfirmed the other
    predicted ones; ``families`` is the confirmed families, sorted,
    joined by commas (empty if none), ``family`` that of the largest
    probability (``unknown`` if none). Null and empty texts have no
    paragraphs. Rows of one id and text get the same result. Columns of
    ``docs`` named like an added one are replaced.
    """
    docs = docs.drop("n_paragraphs", "n_licenses", "n_unconfirmed", "families", "family", "probability")
    found = paragraph_licenses(docs, doc_id, text)
    yes = F.col("confirmed")
    per = found.groupBy(F.col("d").alias("__d"), F.col("key").alias("__k")).agg(
        F.sum(F.col("whole").cast("long")).alias("__n"),
        F.collect_set(F.when(yes & ~F.col("whole"), F.struct("family", "at"))).alias("__p"),  # of one document, so bounded by its text
        F.sum((~yes).cast("long")).alias("__u"),
        F.array_sort(F.collect_set(F.when(yes, F.col("family")))).alias("__f"),
        F.max(F.when(yes, F.struct("probability", "family"))).alias("__b"),
    )
    lines = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda s: F.lower(s).rlike("[a-z0-9]")))
    base = docs.withColumn("__key", F.xxhash64(text)).withColumn("n_paragraphs", lines.cast("long"))
    joined = base.join(per, base[doc_id].eqNullSafe(per["__d"]) & (base["__key"] == per["__k"]), "left")
    starts = F.size(F.filter("__p", lambda p: ~F.array_contains("__p", F.struct(p["family"].alias("family"), (p["at"] - 1).alias("at")))))
    return (
        joined.withColumn("n_licenses", F.coalesce(F.col("__n") + starts, F.lit(0)).cast("long"))
        .withColumn("n_unconfirmed", F.coalesce("__u", F.lit(0)).cast("long"))
        .withColumn("families", F.coalesce(F.array_join("__f", ","), F.lit("")))
        .withColumn("family", F.coalesce("__b.family", F.lit(UNKNOWN)))
        .withColumn("probability", F.round("__b.probability", 6))
        .drop("__d", "__k", "__key", "__n", "__p", "__u", "__f", "__b")
    )


