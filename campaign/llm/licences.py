"""Licence scan: a trained paragraph classifier with an unknown class and a template check.

Paragraphs (lines with a word) are sparse vectors of words and word pairs, hashed into BUCKETS. A multinomial
logistic regression tells licence families, an unknown class and ordinary lines apart; it is fitted to
notices and their parts, to notices of other licences, and to lines of the corpus. Half of the last two is
held out: it sets how sure a family must be, and how far ordinary lines are favoured. A predicted family
counts if the paragraph also covers enough words of one of its templates; else the paragraph is unknown.

The weights are folded into the plan as literals, so every line is scored where it is read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import let, plain_words

ORDINARY, UNKNOWN = "ordinary", "unknown"
BUCKETS = 1 << 15
ORDINARY_ROWS = 1000
SAMPLED_ROWS = 2000
COVERAGE = 0.5
#: Share of held-out ordinary lines that may be taken for a licence.
FALSE_ALARMS = 0.002
#: Short notices in common use, by family.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0", "This project is licensed under the terms of the Apache 2.0 license."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "Distributed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "creative_commons": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 License.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC-BY-4.0", "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution license."],
    "creative_commons_nc": ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL, version 2 or later.", "Licensed under the terms of the GNU GPL v3."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", "SPDX-License-Identifier: MIT", "This project is licensed under the MIT License - see the LICENSE file for details."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced or distributed without the prior written permission of the publisher."],
}


#: Notices of other licences or of none in particular; every second one is held out.
UNFAMILIAR = [
    "Licensed under the European Union Public Licence, version 1.2.",
    "Distributed under the Boost Software License, Version 1.0.", "Released under the ISC License.",
    "This file is licensed under the zlib License.", "You may distribute this under the terms of the Artistic License.",
    "Made available under the terms of the Eclipse Public License, version 2.0.", "Released under the Eclipse Distribution License.",
    "Subject to the Common Development and Distribution License, version 1.1.", "Licensed under the Academic Free License, version 3.0.",
    "This is free and unencumbered software released into the public domain.", "This work is in the public domain.",
    "Do what you want under the terms of the WTFPL.", "You may use this work under the terms of its own licence.",
    "Licensed under the SIL Open Font License, Version 1.1.", "This font is licensed under the Ubuntu Font Licence.",
    "Licensed under the Open Database License.", "This data is made available under the Open Data Commons Attribution License.",
    "Free for personal use only; commercial use needs a licence from the author.", "Free for use under terms that the owner sets.",
    "Use of this software is governed by the licence agreement that came with it.", "This item is licensed by its owner under terms of its own.",
    "Licensed under the PostgreSQL License.", "Licensed under the Python Software Foundation License, version 2.",
    "SPDX-License-Identifier: EUPL-1.2", "SPDX-License-Identifier: LicenseRef-Own",
    "GNU licence", "Dual licensed, see the licence files for terms.",
]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row_hash, place, line): lines, numbered from 0 in the whole text."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_hash"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("place", "line"))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row_hash, place, words): lines as words."""
    return _lines(docs, id_col, text_col).select("id", "row_hash", "place", plain_words(F.col("line")).alias("words"))


def hashed(words: Column) -> Column:
    """The distinct hashed words and pairs of a paragraph."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    both = lambda h: F.array_distinct(F.concat(
        F.transform(h, bucket), F.slice(F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: bucket(F.xxhash64(a, b))), 1, F.greatest(F.size(h) - 1, F.lit(0)))
    ))
    return let(F.transform(words, lambda x: F.xxhash64(x)), both)


def _notices() -> list[tuple[str, str]]:
    """(family, text): the notices, whole and as parts of eight words or more, and those of other licences."""
    out = []
    for family, texts in sorted(TEMPLATES.items()):
        for text in texts:
            words = text.split()
            spans = {(0, len(words))} | {(s, min(len(words), s + 12)) for s in range(0, max(1, len(words) - 11), 4)} if len(words) > 12 else {(0, len(words))}
            out += [(family, " ".join(words[a:b])) for a, b in sorted(spans)]
    return out + [(UNKNOWN, text) for text in UNFAMILIAR]


def _listed(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(number, text) of the module's own texts."""
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, texts))).alias("number", "text"))


def _literal(values: np.ndarray) -> Column:
    """An array of doubles as one literal, which Spark folds."""
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values)), ",").cast("array<double>")


class Model:
    """Weights by class and feature, biases by class, the least probability of a family, and the templates as (number, family, words). Classes are ordinary, unknown and the families."""

    def __init__(self, spark: SparkSession, classes: list[str], weights: np.ndarray, bias: np.ndarray, threshold: float):
        self.classes, self.weights, self.bias, self.threshold = classes, weights, bias, threshold
        own = [(family, text) for family, texts in sorted(TEMPLATES.items()) for text in texts]
        words = _listed(spark, [text for _, text in own]).select("number", F.array_distinct(plain_words(F.col("text"))).alias("words")).collect()
        self.templates = [(r["number"], own[r["number"]][0], r["words"]) for r in words]
        # only features with weights have rows in the tables; one literal tells which row
        known = np.flatnonzero(weights.any(axis=0))
        place = np.full(BUCKETS, -1)
        place[known] = np.arange(len(known))
        self._place = F.split(F.lit(",".join(map(str, place))), ",").cast("array<int>")
        self._most = _literal((weights[1:, known] - weights[0, known]).max(axis=0) + 1e-6)  # rounded up
        self._tables = [_literal(w) for w in weights[:, known]]

    def _sum(self, places: Column, table: Column) -> Column:
        return F.aggregate(places, F.lit(0.0), lambda a, x: a + F.coalesce(F.get(table, x), F.lit(0.0)))

    def may_be_licence(self, found: Column) -> Column:
        """False only for features whose likeliest class is ordinary: even the best class for each feature falls short."""
        total = self._sum(F.transform(found, lambda x: F.get(self._place, x)), self._most)
        return total / F.sqrt(F.size(found)) + F.lit(float(max(self.bias[1:]) - self.bias[0]) + 1e-6) > 0

    def scores(self, found: Column) -> Column:
        """The classes' scores, whose softmax are their probabilities."""
        one = lambda places, table, b: self._sum(places, table) / F.sqrt(F.size(found)) + F.lit(float(b))
        return let(F.transform(found, lambda x: F.get(self._place, x)), lambda p: F.array(*(one(p, t, b) for t, b in zip(self._tables, self.bias, strict=True))))


def _fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Weights (features, classes), each class weighing alike; the last feature is the bias."""
    target = np.eye(classes)[y]
    share = (1 / np.maximum(1, target.sum(axis=0)))[y][:, None]
    w = v = np.zeros((x.shape[1], classes))
    step = 1.0 / (0.5 * np.linalg.eigvalsh((x * share) @ x.T)[-1] + 1e-3) if len(x) < x.shape[1] else 1.0 / (0.5 * np.linalg.norm(x * np.sqrt(share), 2) ** 2 + 1e-3)
    for k in range(rounds):
        slope = x.T @ (share * (_softmax(x @ v) - target)) + 1e-3 * v
        new = v - step * slope
        v, w = new + k / (k + 3) * (new - w), new
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ordinary_rows: int = ORDINARY_ROWS, sampled_rows: int = SAMPLED_ROWS, rounds: int = 400) -> Model:
    """Fitted to the notices above and to at most `ordinary_rows` ordinary lines, those of least hash in about `sampled_rows` rows at most.

    Every second ordinary line and every second notice of another licence is held out. The threshold is
    the greatest probability of a family among these, at least 0.5 and at most 0.95; the bias of ordinary lines is raised
    until at most FALSE_ALARMS of the held-out ones have another likeliest class.
    """
    spark = docs.sparkSession
    labelled = _notices()
    own = {r["number"]: r["f"] for r in _listed(spark, [text for _, text in labelled]).select("number", hashed(plain_words(F.col("text"))).alias("f")).collect()}
    share = int((1 << 30) * min(1.0, sampled_rows / max(1, docs.count())))
    some = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < share)
    lines = paragraphs(some, id_col, text_col).where((F.size("words") >= 4) & ~F.exists("words", lambda w: w.rlike("licen[cs]|rights|reserved|copyright")))
    plain = lines.select(F.xxhash64("words").alias("number"), "words").groupBy("number").agg(F.first("words").alias("words")).orderBy("number").limit(ordinary_rows)
    ordinary = [r["f"] for r in plain.select("number", hashed(F.col("words")).alias("f")).orderBy("number").collect()]
    classes = [ORDINARY, UNKNOWN, *sorted(TEMPLATES)]
    others = [k for k, (family, _) in enumerate(labelled) if family == UNKNOWN]
    fit = [(classes.index(family), own[k]) for k, (family, _) in enumerate(labelled) if k not in others[1::2]] + [(0, f) for f in ordinary[::2]]
    held = [(1, own[k]) for k in others[1::2]] + [(0, f) for f in ordinary[1::2]]
    known = sorted({f for c, found in fit if c for f in found})
    column = {f: k for k, f in enumerate(known)}

    def matrix(rows: list) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros((len(rows), len(known) + 1)), np.zeros(len(rows), int)
        for k, (c, found) in enumerate(rows):
            y[k], x[k, -1] = c, 1
            for f in found:
                if f in column:
                    x[k, column[f]] = 1 / np.sqrt(len(found))
        return x, y

    w = _fit(*matrix(fit), len(classes), rounds)
    x, y = matrix(held)
    z = x @ w
    over = (z[:, 1:].max(axis=1) - z[:, 0])[y == 0]
    raised = max(0.0, float(np.quantile(over, 1 - FALSE_ALARMS, method="higher")) + 1e-6) if len(over) else 0.0
    w[-1, 0] += raised
    z[:, 0] += raised
    p = _softmax(z)[:, 2:]
    weights = np.zeros((len(classes), BUCKETS))
    weights[:, known] = w[:-1].T
    return Model(spark, classes, weights, w[-1], min(max(0.5, float(p.max()) if p.size else 0.5), 0.95))


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id, row_hash, place, family, probability, template, covered): paragraphs confirmed as licence notices, or unknown ones.

    `unknown` are paragraphs whose likeliest class is unknown, or a family that is below the threshold or
    not confirmed by a template. Paragraphs for which a bound of their score shows that they are ordinary
    are passed over, which changes no result. Nothing is shuffled.
    """
    # one expression by line, since Spark would evaluate the parts of several filters anew
    spoken = let(plain_words(F.col("line")), lambda w: F.when(F.size(w) > 0, let(hashed(w), lambda f: F.when(model.may_be_licence(f), w))))
    lines = _lines(docs, id_col, text_col).select("id", "row_hash", "place", spoken.alias("words")).where("words is not null").withColumn("f", hashed(F.col("words")))
    best = lambda z: (F.array_position(z, F.array_max(z)) - 1).cast("int")
    chance = lambda z: 1 / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(z)))
    found = lines.select("id", "row_hash", "place", "words", let(model.scores(F.col("f")), lambda z: F.struct(best(z).alias("best"), chance(z).alias("probability"))).alias("s"))
    found = found.where("s.best > 0").select("id", "row_hash", "place", "words", F.get(F.array(*map(F.lit, model.classes)), F.col("s.best")).alias("guess"), "s.probability")
    shared = lambda t, own: F.struct((F.size(F.array_intersect(F.array(*map(F.lit, own)), "words")) / len(own)).alias("covered"), F.lit(-t).alias("t"))
    by_family = F.lit(None).cast("struct<covered:double,t:int>")
    for family in sorted(TEMPLATES):
        by_family = F.when(F.col("guess") == family, F.array_max(F.array(*(shared(t, w) for t, f, w in model.templates if f == family)))).otherwise(by_family)
    compared = found.select("id", "row_hash", "place", "guess", "probability", let(by_family, lambda m: m).alias("m"))
    sure = F.coalesce((F.col("probability") >= model.threshold) & (F.col("m.covered") >= coverage), F.lit(False))
    return compared.select("id", "row_hash", "place", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", F.when(sure, -F.col("m.t")).alias("template"), F.coalesce("m.covered", F.lit(0.0)).alias("covered"))


def by_document(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, licences (distinct families, sorted, comma-joined), n_notices and n_unknown.

    Null and empty texts have none; rows that repeat each get the same result.
    """
    found = find(docs, model, id_col, text_col)
    per = found.groupBy("id", "row_hash").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))), ",").alias("licences"),
        F.count_if(F.col("family") != UNKNOWN).alias("n_notices"),
        F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"),
    )
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_hash"))
    joined = rows.join(per, rows["row_hash"].eqNullSafe(per["row_hash"]) & rows["id"].eqNullSafe(per["id"]), "left")
    zero = F.lit(0).cast("long")
    return joined.select(rows["id"].alias(id_col), F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_notices", zero).alias("n_notices"), F.coalesce("n_unknown", zero).alias("n_unknown"))
