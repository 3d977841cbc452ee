"""Licence scans: a trained paragraph classifier in DataFrame operations.

Texts are split into paragraphs: at blank lines, and within a block at line ends that aren't wraps. A multinomial logistic
regression on sparse word n-grams (one to three words) scores every paragraph of every text, without a gate before it. Its
classes are the licence families, ``unknown`` (notices of licences that aren't listed) and ``none`` (other text).
Probabilities are calibrated by a temperature fitted to out-of-fold scores, where no fold's model has seen the fold's
templates. A predicted family must be confirmed by a template: enough of the template's word pairs must come in the
paragraph; what isn't confirmed is unknown. Scoring is a projection: no shuffle, no join with the texts.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Short notices of licence families, as their texts or users print them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "Distributed under Apache-2.0", "Apache License 2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license", "BSD License"),
    "cc_by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "Creative Commons Attribution-ShareAlike 4.0", "Licensed under CC BY-SA 4.0"),
    "cc_by_nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL version 2", "GNU GPL v3"),
    "lgpl": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    "mit": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", "License: MIT", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0", "Distributed under MPL-2.0"),
    "proprietary": ("All rights reserved. No part of this publication may be reproduced or transmitted without prior written permission", "Copyright. All rights reserved", "This document is confidential and proprietary", "All rights reserved"),
    "public_domain": ("This work is in the public domain", "CC0 1.0 Universal Public Domain Dedication", "SPDX-License-Identifier: CC0-1.0", "This is free and unencumbered software released into the public domain"),
}
#: Notices of other licences, which train the unknown class.
OTHERS = ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0", "Licensed under the Academic Free License version 3.0", "This package is distributed under the Artistic License", "Distributed under the Boost Software License, Version 1.0", "This Font Software is licensed under the SIL Open Font License, Version 1.1", "This database is made available under the Open Database License", "The contents of this file are subject to the terms of the Common Development and Distribution License", "Licensed under the European Union Public Licence", "Licensed under the zlib license", "The origin of this software must not be misrepresented; altered source versions must be plainly marked as such", "Use is subject to license terms", "SPDX-License-Identifier: Zlib", "See the file LICENSE for the license terms")
#: Training paragraphs of no licence: talk about licences and rights.
NEGATIVES = ("You need a driving license to rent a car", "the license plate was found", "a license to kill", "terms of service and privacy", "the general public was free to use the work", "he asked for permission and it was granted", "the software is sold with a warranty", "a copy of the document is in the source", "version two of the public work was released", "all the rights of man", "conditions are met with or without reason", "this work is under way", "permitted use of the form is subject to terms", "my driving license", "the public and the domain of the king")
#: Words that are no n-gram by themselves, nor with each other.
STOP = frozenset("a all an and any are as at be by for from has have i in is it its may more no not of on one or see so that the their this to was were which with you your 0 1 2 3".split())
UNKNOWN, NONE = "unknown", "none"
CLASSES = (*TEMPLATES, UNKNOWN, NONE)
#: Corpus paragraphs with one of these words aren't taken for training rows of ``none``; scoring doesn't look at them.
RIGHTS = ("license", "licenses", "licensed", "licence", "licenced", "copyright", "copyrighted", "permission", "permitted", "redistribution", "redistribute", "distributed", "spdx", "rights", "warranty", "gpl", "cc", "cc0", "domain")
#: Corpus paragraphs among the training rows of ``none``: so many at most (of the least hashes), of so many words at most.
MAX_NEGATIVES, MAX_NEGATIVE_WORDS = 600, 400
#: A family needs this share of some template's word pairs.
MIN_OVERLAP = 0.5
#: Lines up to so long can be wrapped.
WRAP = 120
_MARK = "\x1e"
_TOKEN = re.compile(r"[a-z0-9]+")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _ngrams(text: str) -> list[str]:
    w = _TOKEN.findall(text.lower())
    return sorted({" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1) if not STOP.issuperset(w[i : i + k])})


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text, white space made single spaces.

    A line end within a block is a wrap, and no paragraph's end, if the next line's first word would not have fitted into
    the block's width, or if the line doesn't end a sentence and the next begins in lower case."""
    clean = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _MARK + "\r", " \n"), r"\n[\x20\x09-\x0D]*\n", "\n\n")
    lines = F.transform(F.split(clean, "\n\n+"), lambda b: F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    sized = F.transform(lines, lambda b: F.struct(b.alias("lines"), F.coalesce(F.array_max(F.transform(b, lambda x: F.length(x))), F.lit(0)).alias("width")))

    def joined(b: Column) -> Column:
        def line(x: Column, i: Column) -> Column:
            before = F.get(b["lines"], i - 1)
            wrapped = (b["width"] <= WRAP) & (F.length(before) + 1 + F.length(F.substring_index(x, " ", 1)) > b["width"])
            goes_on = x.rlike(r"^\p{Ll}") & ~before.rlike(r"[.!?:;|]$")
            return F.when(i == 0, x).when(wrapped | goes_on, F.concat(F.lit(" "), x)).otherwise(F.concat(F.lit(_MARK), x))

        return F.array_join(F.transform(b["lines"], line), "")

    flat = F.array_join(F.filter(F.transform(sized, joined), lambda x: x != ""), _MARK)
    return F.split(F.regexp_replace(flat, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "), _MARK)


def paragraph_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph number from 0, text) of every paragraph that isn't empty."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(paragraphs(F.col(text_col))).alias("paragraph", "text")).where("text <> ''")


def training_rows(corpus: list[str], seed: int = 5, copies: int = 16) -> list[tuple[str, str, int]]:
    """(text, class, group): templates in varied form (cut ends, lost words, words or corpus text around them), other
    notices, talk about rights, and corpus paragraphs without a word of RIGHTS. A template's rows are one group."""
    rnd, out = random.Random(seed), []
    filler = "the of a project file author 2019 2024 see code data this work and for more is by".split()
    plain = [t for t in sorted(corpus) if not set(_TOKEN.findall(t.lower())) & set(RIGHTS)]

    def varied(text: str, k: int) -> str:
        w = text.split()
        if k:
            if len(w) > 8:
                a = rnd.randint(0, len(w) // 3)
                w = w[a : a + rnd.randint(len(w) // 2, len(w))]
            w = [x for x in w if rnd.random() > 0.04] or w
            w = rnd.choices(filler, k=rnd.randint(0, 4)) + w + rnd.choices(filler, k=rnd.randint(0, 6))
        if plain and k % 4 == 1:
            w = rnd.choice(plain).split() + w
        return " ".join(w)

    for family, texts in [*TEMPLATES.items(), (UNKNOWN, OTHERS)]:
        for g, text in enumerate(texts):
            out += [(varied(text, k), family, g) for k in range(copies)]
    for g, text in enumerate(NEGATIVES):
        for _ in range(copies):
            w = [x for x in text.split() if rnd.random() > 0.1]
            out.append((" ".join(rnd.choices(filler, k=rnd.randint(0, 8)) + w + rnd.choices(filler, k=rnd.randint(0, 8))), NONE, g))
    return out + [(t, NONE, g) for g, t in enumerate(plain)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, k: int, l2: float = 0.05, rounds: int = 120) -> np.ndarray:
    """Weights (features and the intercept, by class) of a multinomial logistic regression; accelerated gradient descent."""
    a = np.hstack([x, np.ones((len(x), 1), np.float32)])
    bound = 0.5 * (a * a.sum(1, keepdims=True)).sum(0)[:, None] + l2  # each weight has a safe step of its own
    target = np.eye(k, dtype=np.float32)[y]
    w = v = np.zeros((a.shape[1], k), np.float32)
    t = 1.0
    for _ in range(rounds):
        grad = a.T @ (_softmax(a @ v) - target) + l2 * v
        new = v - grad / bound
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + np.float32((t - 1) / nt) * (new - w), new, nt
    return w


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The scale of scores at which out-of-fold rows are likeliest."""
    tries = np.geomspace(0.25, 4.0, 33)
    loss = [-np.log(np.maximum(_softmax(z * s)[np.arange(len(y)), y], 1e-12)).mean() for s in tries]
    return float(tries[int(np.argmin(loss))])


def train(corpus: list[str], folds: int = 3) -> tuple[list[str], np.ndarray]:
    """(n-grams, calibrated weights by n-gram and class; the last row is the intercept)."""
    rows = training_rows(corpus)
    grams = [_ngrams(t) for t, _, _ in rows]
    names = sorted({g for ts in (*TEMPLATES.values(), OTHERS, NEGATIVES) for t in ts for g in _ngrams(t)})
    index = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, gs in enumerate(grams):
        x[i, [index[g] for g in gs if g in index]] = 1
    y = np.array([CLASSES.index(f) for _, f, _ in rows])
    fold = np.array([g % folds for _, _, g in rows])
    apart = np.zeros((len(rows), len(CLASSES)))
    for f in range(folds):
        w = fit(x[fold != f], y[fold != f], len(CLASSES))
        apart[fold == f] = x[fold == f] @ w[:-1] + w[-1]
    return names, fit(x, y, len(CLASSES)).astype(float) * temperature(apart, y)


def _pairs(text: str) -> set[tuple[str, str]]:
    w = _TOKEN.findall(text.lower())
    return set(zip(w, w[1:], strict=False))


def _overlap(text: str, template: str) -> float:
    want = _pairs(template)
    return len(want & _pairs(text)) / max(1, len(want))


def literal(values: list, kind: str) -> Column:
    """A table as one constant, however long (the optimizer reads the text once)."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def finder(keys: list[int], buckets: int = 4093) -> Callable[[Column], Column]:
    """A column function from a key to its place in ``keys``, null for others, by short lists of keys."""
    lists: list[list[int]] = [[] for _ in range(buckets)]
    places: list[list[int]] = [[] for _ in range(buckets)]
    for i, k in enumerate(keys):
        lists[k % buckets].append(k)
        places[k % buckets].append(i)
    known, at = literal(lists, "array<array<bigint>>"), literal(places, "array<array<int>>")

    def find(key: Column) -> Column:
        bucket = F.pmod(key, F.lit(buckets)).cast("int")
        return F.get(F.get(at, bucket), (F.array_position(F.get(known, bucket), key) - 1).cast("int"))

    return find


def once(column: Column) -> Column:
    """The same value, computed once however often it is used (plans are merged across projections, not across this)."""
    return F.explode(F.array(column))


class Scorer:
    """Class scores and template overlaps of a column of words, as expressions over constant tables. Words are numbered;
    an n-gram is the number that its words' numbers make."""

    def __init__(self, spark: SparkSession, names: list[str], weights: np.ndarray) -> None:
        known = {g: weights[i] for i, g in enumerate(names)}
        grams = [*names, *sorted({" ".join(p) for ts in TEMPLATES.values() for t in ts for p in _pairs(t)} - set(names))]
        words = sorted({w for g in grams for w in g.split()})
        number = {w: i + 1 for i, w in enumerate(words)}
        if len(words) >= 1 << 12:
            raise ValueError("a word's number has twelve bits")
        hashed = spark.range(1).select(F.posexplode(literal(words, "array<string>")).alias("i", "w")).select("i", F.xxhash64("w").alias("h")).orderBy("i").collect()
        self.word = finder([r.h for r in hashed])
        self.gram = finder([sum(number[w] << 12 * k for k, w in enumerate(reversed(g.split()))) for g in grams])
        self.place = {g: i for i, g in enumerate(grams)}
        self.base = literal([round(float(v), 6) for v in weights[-1]], "array<double>")
        self.table = literal([[round(float(v), 6) for v in known.get(g, np.zeros(len(CLASSES)))] for g in grams], "array<array<double>>")

        # no class can beat none unless the margins of what a paragraph may hold add up to it: an n-gram's margin, if
        # positive, is put on the word of it that has the largest, so that common words promise little
        margin = {g: float((known[g][:-1] - known[g][-1]).max()) if g in known else 0.0 for g in grams}
        promise = dict.fromkeys(words, 0.0)
        for g in grams:
            best = max(g.split(), key=lambda w: (margin.get(w, 0.0), w))
            promise[best] += margin[g] if g == best else max(0.0, margin[g])
        self.promise = literal([0.0, *(round(promise[w], 6) for w in words)], "array<double>")
        self.need = float((weights[-1][:-1] - weights[-1][-1]).max()) + 1e-3

    def numbers(self, words: Column) -> Column:
        """Each word's number; 0 for words in no n-gram."""
        return F.transform(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.coalesce(self.word(h) + 1, F.lit(0)).cast("bigint"))

    def may_be_listed(self, numbers: Column) -> Column:
        """False only where ``none`` is certain, by an upper bound from single words."""
        met = F.array_distinct(F.filter(numbers, lambda x: x > 0))
        return F.aggregate(met, F.lit(self.need), lambda acc, x: acc + F.get(self.promise, x.cast("int"))) >= 0

    def keys(self, numbers: Column) -> Column:
        """Numbers of the runs of one to three known words, each once."""
        follow = lambda xs, ys: F.zip_with(xs, ys, lambda x, y: F.when((x > 0) & (y > 0), x * (1 << 12) + y % (1 << 12)).otherwise(F.lit(0).cast("bigint")))
        rest = lambda xs, k: (F.slice(xs, 1, F.greatest(F.size(xs) - k, F.lit(0))), F.slice(xs, 1 + k, F.greatest(F.size(xs) - k, F.lit(0))))

        def runs(ones: Column) -> Column:
            two = follow(*rest(ones, 1))
            three = F.transform(F.array(two), lambda t: follow(*rest(t, 1)))[0]
            return F.concat(ones, two, three)

        return F.array_distinct(F.filter(F.flatten(F.transform(F.array(numbers), runs)), lambda x: x > 0))

    def found(self, keys: Column) -> Column:
        """Places of the n-grams among the known ones."""
        return F.filter(F.transform(keys, self.gram), lambda x: x.isNotNull())

    def scores(self, found: Column) -> Column:
        """Log odds by class, up to a constant."""
        return F.aggregate(found, self.base, lambda acc, i: F.zip_with(acc, F.get(self.table, i), lambda a, b: a + b))

    def overlap(self, found: Column, family: str) -> Column:
        """The largest share of a template's word pairs that the paragraph has."""
        want = [[self.place[" ".join(p)] for p in sorted(_pairs(t))] for t in TEMPLATES[family]]
        return F.greatest(F.lit(0.0), *[F.size(F.array_intersect(found, literal(w, "array<int>"))) / F.lit(float(len(w))) for w in want])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence statement: id, paragraph (its number, from 0), family, probability, overlap, text.

    Every paragraph is classified; those of class ``none`` aren't listed. The family is the likeliest class, if one of
    its templates has at least MIN_OVERLAP of its word pairs in the paragraph, else ``unknown``; probability is the
    likeliest class's. Null and empty texts give no rows. Repeated rows each give theirs, ties between classes go to the
    one listed first; an empty table gives none; other columns are left out, whatever they are called."""
    rows = paragraph_rows(docs, id_col, text_col)
    short = rows.select("text").where(F.length("text") - F.length(F.replace("text", F.lit(" "))) < MAX_NEGATIVE_WORDS)
    sample = short.orderBy(F.xxhash64("text"), "text").limit(MAX_NEGATIVES).collect()
    scorer = Scorer(docs.sparkSession, *train([r.text for r in sample]))
    rows = rows.select("*", once(scorer.numbers(words_of(F.col("text")))).alias("numbers")).where(F.exists("numbers", lambda x: x > 0) & scorer.may_be_listed(F.col("numbers")))
    known = rows.select("id", "paragraph", "text", once(scorer.found(scorer.keys(F.col("numbers")))).alias("found")).where(F.size("found") > 0)
    scored = known.select("*", once(scorer.scores(F.col("found"))).alias("z"))
    best = scored.withColumn("top", F.array_max("z")).withColumn("best", F.array_position("z", F.col("top")).cast("int"))
    family = F.element_at(F.lit(list(CLASSES)), F.col("best"))
    listed = best.where(F.col("best") != CLASSES.index(NONE) + 1).withColumn("family", family)
    share = F.coalesce(*[F.when(F.col("family") == c, scorer.overlap(F.col("found"), c)) for c in TEMPLATES], F.lit(0.0))
    listed = listed.withColumn("overlap", share)
    p = 1 / F.aggregate(F.transform("z", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda a, b: a + b)
    return listed.select(F.col("id").alias(id_col), "paragraph", F.when(F.col("overlap") >= MIN_OVERLAP, F.col("family")).otherwise(UNKNOWN).alias("family"), F.round(p, 6).alias("probability"), F.round("overlap", 6).alias("overlap"), "text")
