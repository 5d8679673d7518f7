"""Licence scan: a trained paragraph classifier over word n-grams, confirmed by comparison with templates.

A multinomial logistic regression over the words and word pairs of the templates
tells licence families from ordinary prose. It is trained on varied templates and
on a bounded sample of the corpus's own paragraphs. Its probabilities are
calibrated on variants left out of training; a paragraph that looks like a
licence but reaches no family's threshold, or that no template confirms, is
``unknown``. Built-in functions and Spark's own linear models only.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayline.llm.common import free_name

# fixed values: usual short notices of licence families
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2.0", "Licensed under the GNU General Public License, version 2."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0 1.0)."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced or distributed without prior written permission."),
)

NONE, UNKNOWN = "none", "unknown"


def words(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, with inner dots (version numbers); short ones count too."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+|\.(?![a-z0-9])"), lambda w: w != "")


def grams(ws: Column) -> Column:
    """The different words and word pairs."""
    n = F.size(ws)
    pairs = F.when(n > 1, F.zip_with(F.slice(ws, 1, F.greatest(n - 1, F.lit(0))), F.slice(ws, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.concat(ws, F.coalesce(pairs, F.array().cast("array<string>"))))


@dataclass
class LicenceModel:
    """``weights``: gram to one number per class; ``threshold``: least calibrated probability of a family."""

    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    threshold: float
    held_out_accuracy: float


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(f).alias("family"), F.lit(t).alias("text")) for i, (f, t) in enumerate(templates)])
    return spark.range(1).select(F.inline(rows))


def training_rows(docs: DataFrame, text: str, most: int, variants: int, templates=TEMPLATES) -> DataFrame:
    """``label``, ``grams`` and ``fold`` (0: calibration) of varied templates and of sampled paragraphs.

    The sample holds at most ``most`` paragraphs of the corpus, those with the
    smallest hashes; such as share a third of a template's word pairs are left
    out, as they may be licences. A variant drops words of a template and stands
    between runs of words of a sampled paragraph.
    """
    spark = docs.sparkSession
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line")).where(F.length("line") > 20)
    row = F.pmod(F.xxhash64("line"), F.lit(1 << 40))
    n = lines.count()
    # evenly spread hashes: four times the wanted number lie below this bound, and only those are sorted
    near = lines.where(row <= int((1 << 40) * min(1.0, 4 * most / max(1, n)))).distinct()
    sample = near.orderBy(F.xxhash64("line"), "line").limit(most).select(words(F.col("line")).alias("ws"), F.pmod(F.xxhash64("line"), F.lit(997)).alias("no"))
    forms = [r["g"] for r in template_table(spark, templates).select(F.filter(grams(words(F.col("text"))), lambda g: g.contains(" ")).alias("g")).collect()]
    alike = F.greatest(F.lit(0.0), *[F.size(F.array_intersect("g", F.array(*map(F.lit, f)))) / max(1, len(f)) for f in forms])
    prose = sample.withColumn("g", grams(F.col("ws"))).where(alike < 1 / 3)
    negative = prose.select(F.lit(NONE).alias("label"), F.col("g").alias("grams"), F.pmod(F.xxhash64("ws"), F.lit(4)).cast("int").alias("fold"))
    around = prose.select(F.pmod("no", F.lit(variants)).cast("int").alias("v"), "ws").groupBy("v").agg(F.min("ws").alias("ws"))
    varied = template_table(spark, templates).select("template", "family", words(F.col("text")).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("v"))
    varied = varied.join(around, "v", "left").withColumn("ws", F.coalesce("ws", F.array().cast("array<string>")))
    drop = F.filter("t", lambda w, i: F.pmod(F.xxhash64("template", "v", i), F.lit(100)) >= F.pmod("v", F.lit(4)) * 8)
    cut = F.pmod(F.xxhash64("template", "v"), F.lit(30)).cast("int")
    mixed = F.when(F.col("v") % 2 == 0, drop).otherwise(F.concat(F.slice("ws", 1, cut), drop, F.expr("slice(ws, 31, 20)")))
    positive = varied.select(F.col("family").alias("label"), grams(mixed).alias("grams"), F.pmod(F.xxhash64("template", "v"), F.lit(4)).cast("int").alias("fold"))
    return negative.unionByName(positive)


def train(docs: DataFrame, text: str = "text", most: int = 2000, variants: int = 40, strength: float = 1e-3, templates=TEMPLATES) -> LicenceModel:
    """Fit on at most ``most`` sampled paragraphs and ``variants`` forms of each template, calibrate on a quarter of them.

    The vocabulary is the templates' words and word pairs, so the model's size is
    fixed by the templates. The temperature minimises the calibration rows'
    log-loss; the threshold is the least probability from which at least 99 in
    100 of the accepted calibration rows have the right family.
    """
    spark = docs.sparkSession
    vocabulary = [r[0] for r in template_table(spark, templates).select(F.explode(grams(words(F.col("text"))))).distinct().orderBy("col").collect()]
    classes = [NONE, *sorted({f for f, _ in templates})]
    rows = training_rows(docs, text, most, variants, templates)
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("double") - 1
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    data = vectors.transform(rows.withColumn("y", label)).select("y", "features", "fold").persist()
    model = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", regParam=strength, maxIter=60).fit(data.where("fold <> 0"))
    held = model.transform(data.where("fold = 0")).select("y", "rawPrediction").collect()
    data.unpersist()
    matrix, bias = model.coefficientMatrix.toArray(), list(model.interceptVector.toArray())
    # a class that no fitted row had is left out of the model's end; templates give every class rows
    matrix, classes = matrix[: len(classes)], classes[: len(bias)]
    logits = [(int(r["y"]), list(r["rawPrediction"])) for r in held]

    def probabilities(z: list[float], t: float) -> list[float]:
        top = max(z)
        e = [math.exp((v - top) / t) for v in z]
        return [v / sum(e) for v in e]

    def loss(t: float) -> float:
        return -sum(math.log(max(1e-12, probabilities(z, t)[y])) for y, z in logits)

    temperature = min([0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0], key=loss) if logits else 1.0
    seen = sorted(((max(p), p.index(max(p)) == y) for y, z in logits if (p := probabilities(z, temperature)).index(max(p)) > 0), reverse=True)
    threshold, right = 0.5, 0
    for i, (p, ok) in enumerate(seen, 1):
        right += ok
        if right >= 0.99 * i:
            threshold = max(0.3, p)
    accuracy = sum(z.index(max(z)) == y for y, z in logits) / max(1, len(logits))
    weights = {g: [float(v) for v in matrix[:, k]] for k, g in enumerate(vocabulary)}
    return LicenceModel(classes, weights, [float(b) for b in bias], temperature, threshold, accuracy)


def _bound(found: Column, values: dict[str, float]) -> Column:
    """At least the sum of the values of the grams in an array: each counts as the next of a few levels."""
    levels = [2.0 ** (p / 2) for p in range(-6, 16)]
    groups = {high: [g for g, v in values.items() if low < v <= high] for low, high in zip([0.0, *levels], [*levels, math.inf], strict=True)}

    def value(gram: Column) -> Column:
        out = F.lit(0.0)
        for high, gs in groups.items():
            out = F.when(gram.isin(gs), high).otherwise(out) if gs else out
        return out

    return F.aggregate(found, F.lit(0.0), lambda total, g: total + value(g))


#: a line that ends a sentence, and a text that has a line of another kind which is not its last
ENDED = r"""[.!?]["')\]\s]*$"""
GOES_ON = r"""[^.!?"')\]\s]["')\]\s&&[^\n]]*\n"""


def wrapped(lines: Column) -> Column:
    """Runs of two lines or more that read on, as structs ``no`` (of the first line) and ``n``.

    A line reads on into the next one if both have words and it does not end a
    sentence, as in a notice wrapped at some width. ``lines`` is used several
    times: give a plain column or a lambda's variable.
    """

    def opens(line: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        reads_on = (i > 0) & ~before.rlike(ENDED) & before.rlike("[A-Za-z0-9]") & line.rlike("[A-Za-z0-9]")
        return F.struct(i.alias("no"), (~reads_on).alias("first"))

    starts = F.transform(F.filter(F.transform(lines, opens), lambda s: s["first"]), lambda s: s["no"])
    after = F.concat(F.slice(starts, 2, F.size(lines)), F.array(F.size(lines)))
    return F.filter(F.zip_with(starts, after, lambda a, b: F.struct(a.alias("no"), (b - a).alias("n"))), lambda r: r["n"] > 1)


def paragraphs(text: Column) -> Column:
    """All lines of a text and its runs of lines that read on: ``no``, ``run`` and the words ``ws``."""

    def cut(lines: Column) -> Column:
        each = F.transform(lines, lambda x, i: F.struct(i.alias("no"), F.lit(False).alias("run"), words(x).alias("ws")))
        joined = F.transform(wrapped(lines), lambda r: F.struct(r["no"].alias("no"), F.lit(True).alias("run"), words(F.array_join(F.slice(lines, r["no"] + 1, r["n"]), " ")).alias("ws")))
        return F.when(text.rlike(GOES_ON), F.concat(each, joined)).otherwise(each)

    # bound by a lambda, the lines are split once
    return F.get(F.transform(F.array(F.split(text, "\n")), cut), F.lit(0))


def scan(docs: DataFrame, model: LicenceModel, ident: str = "doc_id", text: str = "text", confirm: float = 0.6, templates=TEMPLATES) -> DataFrame:
    """A row per document: its licence ``family`` (or ``unknown``, ``none``) and the paragraph that shows it.

    Every line that is not blank is a paragraph and is read whole, and so is every
    run of lines that read on (:func:`wrapped`); a run counts only if a template
    confirms it and no line is as sure, under the number of its first line. Most cannot win
    against ``none`` whatever the exact sum is: for each gram an upper bound of
    what it adds to any family's lead is summed, and only paragraphs that may
    make up for the biases are opened and scored exactly. ``similarity`` is the
    share of the best template's grams, of the predicted family, that the
    paragraph has; from ``confirm`` on it confirms the family. Families of equal
    probability: the first by name. ``n_paragraphs`` counts lines. Null and empty
    texts have no paragraphs and family ``none``.
    """
    spark = docs.sparkSession
    k = len(model.classes)
    lead = {g: max(0.0, *(w[c] - w[0] for c in range(1, k))) for g, w in model.weights.items()}
    wanted = model.bias[0] - max(model.bias[1:])
    # a pair needs both its words: its lead goes to the longer, mostly rarer one, for a first test by words alone
    by_word = {g: v for g, v in lead.items() if " " not in g}
    first = dict(by_word)
    for g, v in lead.items():
        if " " in g:
            first[max(g.split(" "), key=lambda w: (len(w), by_word[w]))] += v

    def may_win(p: Column) -> Column:
        return _bound(F.array_distinct(F.filter(p["ws"], lambda w: w.isin(list(by_word)))), first) >= wanted

    def opened(filled: Column) -> Column:
        likely = F.filter(filled, may_win)
        known = F.transform(likely, lambda p: F.struct(p["no"].alias("no"), p["run"].alias("run"), F.filter(grams(p["ws"]), lambda g: g.isin(list(model.weights))).alias("grams")))
        return F.struct(F.size(F.filter(filled, lambda p: ~p["run"])).alias("n"), F.filter(known, lambda p: _bound(p["grams"], lead) >= wanted).alias("ps"))

    row, par = free_name(docs, "_row"), F.col("p")
    lines = docs.select(F.col(ident).alias("doc_id"), F.monotonically_increasing_id().alias(row), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # words are split once, though both the number of lines and the open ones need them
    found = F.get(F.transform(F.array(F.filter(paragraphs(F.col("text")), lambda p: F.size(p["ws"]) > 0)), opened), F.lit(0))
    cut = lines.select("doc_id", row, found.alias("f")).select("doc_id", row, F.col("f.n").alias("n_paragraphs"), F.explode_outer("f.ps").alias("p"))
    table = json.dumps([{"gram": g} | {f"w{c}": w[c] for c in range(k)} for g, w in sorted(model.weights.items())])
    kind = "array<struct<gram string, " + ", ".join(f"w{c} double" for c in range(k)) + ">>"
    weights = spark.range(1).select(F.inline(F.from_json(F.lit(table), kind)))  # as long as the templates' vocabulary
    scored = (
        cut.select("doc_id", row, "n_paragraphs", par["no"].alias("no"), par["run"].alias("run"), par["grams"].alias("grams"), F.explode_outer(par["grams"]).alias("gram"))
        .join(F.broadcast(weights), "gram", "left")
        .groupBy("doc_id", row, "n_paragraphs", "no", "run")
        .agg(F.first("grams").alias("grams"), *[F.coalesce(F.sum(f"w{c}"), F.lit(0.0)).alias(f"z{c}") for c in range(k)])
    )
    z = [(F.col(f"z{c}") + model.bias[c]) / model.temperature for c in range(k)]
    top = F.greatest(*z)
    e = [F.exp(v - top) for v in z]
    total = sum(e[1:], e[0])
    scored = scored.withColumn("probs", F.transform(F.array(*e), lambda v: v / total))
    best = F.array_position("probs", F.array_max("probs")).cast("int") - 1
    names = F.array(*map(F.lit, model.classes))
    scored = scored.withColumn("best", best).withColumn("predicted", F.get(names, F.col("best"))).withColumn("probability", F.array_max("probs"))
    # a left-out paragraph and a paragraph-free document have no number and are none
    looks_so = F.col("no").isNotNull() & (F.col("best") > 0)
    # only predicted licences are held against the templates of their family
    forms = [r["g"] for r in template_table(spark, templates).orderBy("template").select(grams(words(F.col("text"))).alias("g")).collect()]
    likes = [
        F.struct(F.when(F.col("predicted") == f, F.size(F.array_intersect("grams", F.array(*map(F.lit, g)))) / max(1, len(g))).otherwise(-1.0).alias("s"), F.lit(-i).alias("i"))
        for i, ((f, _), g) in enumerate(zip(templates, forms, strict=True))
    ]
    scored = scored.withColumn("like", F.when(looks_so, F.greatest(*likes)))
    is_licence = looks_so & (~F.col("run") | (F.col("like.s") >= confirm))
    sure = (F.col("probability") >= model.threshold) & (F.col("like.s") >= confirm)
    one = F.struct(
        F.when(~is_licence, 0).when(sure, 2).otherwise(1).alias("rank"), (~F.col("run")).alias("line"), F.when(is_licence, F.col("probability")).alias("probability"), (-F.col("no")).alias("no"),
        F.when(sure, F.col("predicted")).otherwise(UNKNOWN).alias("family"), F.col("predicted").alias("nearest"), F.col("like.s").alias("similarity"), (-F.col("like.i")).alias("template"),
    )
    per = scored.groupBy("doc_id", row, "n_paragraphs").agg(
        F.max(one).alias("b"),
        F.count(F.when(is_licence, 1)).alias("n_licence_paragraphs"),
        F.sort_array(F.collect_set(F.when(is_licence & sure, F.col("predicted")))).alias("families"),
    )
    found = F.col("b.rank") > 0
    return per.select(
        "doc_id", "n_paragraphs", "n_licence_paragraphs", F.when(found, F.col("b.family")).otherwise(NONE).alias("family"), "families",
        F.when(found, F.col("b.nearest")).alias("nearest_family"), F.when(found, F.round("b.probability", 6)).alias("probability"),
        F.when(found, -F.col("b.no")).alias("paragraph_no"), F.when(found, F.col("b.similarity")).alias("similarity"),
        F.when(found, F.col("b.template")).alias("template"), (F.col("b.rank") == 2).alias("confirmed"),
    )
