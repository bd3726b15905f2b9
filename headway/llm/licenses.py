"""License scans in DataFrame functions and Spark's own learners only.

A sparse logistic regression over word uni- and bigrams (elastic net) tells
licence families from ordinary paragraphs. It learns from the templates below,
thinned and set into corpus text, and from at most MAX_UNKNOWN corpus
paragraphs (by hash) as the unknown class, a third of which is held back. The
probability a licence must reach is set so that at most one in a thousand of
all distinct paragraphs of the corpus would pass, not counting those learned
from and those that match a template. What passes is confirmed by comparison with the templates of
the predicted family. Every paragraph (line with a visible character) of every
whole text is judged inside its row: no shuffle, no Python.

Defined results: null and empty texts have no paragraphs and no families;
repeated rows are scanned each.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import save_table

# Notices by which licence families announce themselves.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "Released under the GNU GPL version 2 or later.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc_by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc_by_nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public_domain": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
FAMILIES = list(TEMPLATES)

#: Corpus paragraphs the unknown class is learned from, with the third held back; variants made of each template.
MAX_UNKNOWN, VARIANTS = 4_500, 30
#: Share of a template's n-grams that a paragraph must hold to be confirmed, or to be kept out of the unknown class.
CONFIRM = 0.6
#: Share of all ordinary paragraphs not learned from that may pass as licences, before confirmation.
PASSING = 0.001


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Lines with a visible character."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.trim(p) != "")


def words_of(paragraph: Column) -> Column:
    """Lower-cased words."""
    return F.filter(F.split(F.lower(paragraph), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct hashes of words and of pairs of neighbours."""
    return let(words, lambda w: F.array_distinct(F.concat(
        F.transform(w, lambda x: F.xxhash64(x)),
        F.transform(F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
                    lambda x, i: F.xxhash64(F.get(w, i), x)))))


def _constant(value, ddl: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), ddl)


def templates(spark: SparkSession) -> DataFrame:
    """label (from 1), number, words and grams of every template."""
    rows = [{"label": i, "number": j, "text": t} for i, f in enumerate(FAMILIES, 1) for j, t in enumerate(TEMPLATES[f])]
    table = spark.range(1).select(F.inline(_constant(rows, "array<struct<label:int,number:int,text:string>>")))
    return table.select("label", "number", words_of(F.col("text")).alias("words"),
                        grams_of(words_of(F.col("text"))).alias("grams"))


def likest(grams: Column, known: Column, label: Column | None = None) -> Column:
    """Largest share of a template's n-grams that are among `grams`, of one family or of all."""
    of = known if label is None else F.filter(known, lambda t: t["label"] == label)
    return F.array_max(F.transform(of, lambda t: F.size(F.array_intersect(t["grams"], grams)) / F.size(t["grams"])))


class LicenseModel:
    """Weights by n-gram, bias, least probability and template n-grams."""

    def __init__(self, weights: dict[int, list[float]], bias: list[float], limit: float, known: list[dict]):
        self.bias, self.limit, self.known = bias, limit, known
        size = 1 << max(4, len(weights).bit_length() + 1)
        slots: list[list[dict]] = [[] for _ in range(size)]
        for h, w in weights.items():
            slots[h & (size - 1)].append({"h": h, "w": w})
        self.slots = slots

    def probabilities(self, grams: Column) -> Column:
        """Probability of unknown and of each family; null where no n-gram is known to the model."""
        table = _constant(self.slots, "array<array<struct<h:bigint,w:array<double>>>>")
        hits = F.filter(F.transform(grams, lambda g: F.get(F.filter(
            F.get(table, g.bitwiseAND(F.lit(len(self.slots) - 1)).cast("int")), lambda x: x["h"] == g), F.lit(0))),
            lambda x: x.isNotNull())
        bias = _constant(self.bias, "array<double>")

        def soft(z: Column) -> Column:
            return let(F.array_max(z), lambda top: let(F.transform(z, lambda x: F.exp(x - top)), lambda e: F.transform(
                e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))))

        return let(hits, lambda h: F.when(F.size(h) > 0, let(F.aggregate(
            h, bias, lambda a, x: F.zip_with(a, x["w"], lambda p, q: p + q)), soft)))

    def judged(self, paragraph: Column) -> Column:
        """Struct of label, p and match; null for ordinary paragraphs."""
        known = _constant(self.known, "array<struct<label:int,grams:array<bigint>>>")

        def found(grams: Column) -> Column:
            def best(p: Column) -> Column:
                top = F.array_max(F.slice(p, F.lit(2), F.lit(len(FAMILIES))))
                return F.when(p.isNotNull() & (top >= self.limit) & (top > F.get(p, F.lit(0))), let(
                    F.array_position(F.slice(p, F.lit(2), F.lit(len(FAMILIES))), top).cast("int"), lambda label: F.struct(
                        label.alias("label"), top.alias("p"), likest(grams, known, label).alias("match"))))

            return let(self.probabilities(grams), best)

        return let(grams_of(words_of(paragraph)), found)


def fit(docs: DataFrame, text: str = "text") -> LicenseModel:
    """The trained and calibrated model."""
    spark = docs.sparkSession
    known = [{"label": r.label, "grams": list(r.grams)} for r in templates(spark).sort("label", "number").collect()]
    vocab = sorted({g for k in known for g in k["grams"]})
    every = docs.select(F.explode(paragraphs(F.col(text))).alias("p")).select("p", F.xxhash64("p").alias("h"))
    least = every.select("h").distinct().orderBy("h").limit(MAX_UNKNOWN)      # hashes are shuffled, texts are not
    sample = every.join(least, "h").groupBy("h").agg(F.min("p").alias("p")).select("h", words_of(F.col("p")).alias("words"))
    sample = sample.withColumn("grams", grams_of(F.col("words")))
    other = sample.where(likest(F.col("grams"), _constant(known, "array<struct<label:int,grams:array<bigint>>>")) < CONFIRM)
    other = other.withColumn("number", F.row_number().over(Window.orderBy("h")))      # MAX_UNKNOWN rows at most
    other = save_table(other.withColumn("held", F.col("number") % 3 == 0), "license-sample")
    count = max(1, other.count())

    # Variants: words left out at random, every second one inside a paragraph of the corpus.
    v = templates(spark).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    v = v.withColumn("words", F.filter("words", lambda w, i: (F.col("k") < 2) | (
        F.pmod(F.xxhash64(w, i, F.col("k")), F.lit(10)) > 0)))
    v = v.withColumn("at", F.when(F.col("k") % 2 == 1, 1 + F.pmod(F.xxhash64("label", "number", "k"), F.lit(count))))
    host = other.where("not held").select(F.col("number").cast("long").alias("at"), F.slice("words", 1, 12).alias("before"))
    v = v.join(host, "at", "left").select("label", grams_of(F.concat(
        F.coalesce("before", F.array().cast("array<string>")), "words")).alias("grams"))
    plain = other.where("not held").select(F.lit(0).alias("label"), "grams").unionByName(
        spark.range(1).select(F.lit(0).alias("label"), F.array().cast("array<bigint>").alias("grams")))
    table = _constant(vocab, "array<bigint>")
    rows = v.unionByName(plain).select(F.col("label").cast("double").alias("label"), array_to_vector(F.transform(
        table, lambda g: F.array_contains(F.col("grams"), g).cast("double"))).alias("features"))
    rows = save_table(rows, "license-training")
    learner = LogisticRegression(family="multinomial", maxIter=60, regParam=0.001, elasticNetParam=0.5, standardization=False)
    model = learner.fit(rows)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = {g: [float(x) for x in w[:, i]] for i, g in enumerate(vocab) if w[:, i].any()}
    out = LicenseModel(weights, [float(x) for x in b], 0.5, known)
    tops = ordinary(every, out).join(other.where("not held").select("h"), "h", "left_anti")
    limit = tops.agg(F.percentile_approx("top", 1 - PASSING, 10_000)).first()[0]
    out.limit = max(0.5, limit or 0.0)
    return out


def ordinary(lines: DataFrame, model: LicenseModel) -> DataFrame:
    """h and largest family probability of each distinct line (p, h) that matches no template; only these are shuffled.

    Templates are compared from a probability of a half: no limit lies below.
    """
    known = _constant(model.known, "array<struct<label:int,grams:array<bigint>>>")

    def judged(grams: Column) -> Column:
        top = F.coalesce(F.array_max(F.slice(model.probabilities(grams), 2, len(FAMILIES))), F.lit(0.0))
        return let(top, lambda t: F.when((t < 0.5) | (likest(grams, known) < CONFIRM), t))

    tops = lines.select("h", let(grams_of(words_of(F.col("p"))), judged).alias("top"))
    # No filter on the result: it would be evaluated a second time for it, and max skips nulls.
    return tops.groupBy("h").agg(F.max("top").alias("top"))


def scan_licenses(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """`carry` columns with n_paragraphs and found: paragraph number, family, p and match of predicted licences."""
    model = fit(docs, text)
    names = F.array(*(F.lit(f) for f in FAMILIES))
    lines = paragraphs(F.col(text))
    found = let(lines, lambda ps: F.struct(F.size(ps).cast("long").alias("n"), F.filter(
        F.transform(ps, lambda p, i: F.struct(i.alias("paragraph"), model.judged(p).alias("v"))),
        lambda x: x["v"].isNotNull()).alias("hits")))
    hits = F.transform(F.col("r")["hits"], lambda x: F.struct(
        x["paragraph"].alias("paragraph"), F.get(names, x["v"]["label"] - 1).alias("family"),
        x["v"]["p"].alias("p"), x["v"]["match"].alias("match")))
    keep = [c for c in carry if c not in ("n_paragraphs", "found")]
    return docs.select(*keep, found.alias("r")).select(*keep, F.col("r")["n"].alias("n_paragraphs"), hits.alias("found"))


def op9_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: paragraphs, predicted and confirmed ones, confirmed families, best probability."""
    r = scan_licenses(docs.select("doc_id", "text"), ["doc_id"])
    sure = F.filter("found", lambda x: x["match"] >= CONFIRM)
    return r.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_predicted"), "found", sure.alias("sure")).select(
        "doc_id", "n_paragraphs", "n_predicted", F.size("sure").cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("sure", lambda x: x["family"]))), ",").alias("families"),
        F.round(F.array_max(F.transform("sure", lambda x: x["p"])), 6).alias("confidence"))
