"""License scan (DataFrame and SQL functions only).

A multinomial logistic regression over sparse word 1- to 3-grams, trained on notices derived from
the templates below, alone and amid prose, and on prose without a licence, names the licence
family of a paragraph (the lines between two blank ones; a notice may wrap).  Its softmax is
calibrated by a temperature fitted on other wordings and other prose than it was trained on;
paragraphs whose best calibrated probability stays under ``cut``, or whose best class is the
unknown class, are unknown.  A named family counts only if the paragraph shares at least
``overlap`` of the smaller side's 3-grams with one of the family's templates.

Rows are the paragraphs with a 3-gram of a template.  No other can reach an overlap, so the
family of every other paragraph is unknown whatever the classifier says: nothing is lost.
Defined results: null text counts as empty; a document without such a paragraph has no row;
repeated document rows give repeated rows; of classes that tie the first by name wins; empty
tables give an empty result; other columns are ignored, whatever their names; whole texts are
read whatever their length, and only grams with a weight leave a paragraph's row.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices as their publishers word them.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher."),
]
NEGATIVES = [
    "the driver showed a licence and the officer let the car go", "the license plate of the truck was hard to read", "she asked for permission to leave the room early",
    "public domain experts met in the source of the river", "this work is done and the version was late", "under the terms of the deal the general sold the house",
    "copyright law was the topic of the second lecture", "a fishing license costs less than the boat", "software of this kind is sold in every shop", "the foundation published a report on free trade",
    "you may use the door on the left", "redistribution of land was the aim of the reform", "the creative class likes common rooms", "attribution of the painting is open to doubt",
    "the author has rights to a share of the profit", "the warranty of the lamp covers two years", "the use of force is not permitted here", "no part of the plan was reproduced by the press",
    "apache helicopters flew over the valley", "he studied at mit and moved to the coast", "the bar lost its liquor licence in version two of the story", "free of charge the guide took any person along",
]
#: Other wordings and other prose, for calibration only.
HELD_NOTICES = [
    ("apache", "Distributed under the terms of the Apache License 2.0."), ("apache", "You may obtain a copy of the License; unless required by law, use of this file follows the Apache License."),
    ("mit", "This project is MIT licensed."), ("mit", "Permission is granted, free of charge, to deal in this software without restriction, as the MIT License says."),
    ("bsd", "Use of this source code is governed by a BSD-style license."), ("bsd", "Redistribution in source and binary forms is permitted under the BSD terms."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."), ("gpl", "Distributed under the GNU GPL, version 3 or later."),
    ("lgpl", "This library falls under the GNU Lesser General Public License."), ("agpl", "Released under the GNU Affero General Public License v3."),
    ("mpl", "Licensed under the Mozilla Public License 2.0."), ("cc-by", "Available under a Creative Commons Attribution 4.0 licence."),
    ("cc-by-sa", "Shared under Creative Commons Attribution-ShareAlike 4.0."), ("cc-by-nc", "For non-commercial use, see CC BY-NC 4.0."),
    ("cc0", "Dedicated to the public domain under CC0 1.0."), ("isc", "Permission to use, copy, modify and distribute with or without fee is granted by the ISC licence."),
    ("epl", "Available under the Eclipse Public License v2."), ("unlicense", "Released into the public domain, free and unencumbered."),
    ("proprietary", "All rights reserved. Do not reproduce without written permission."),
]
HELD_PROSE = [
    "the licence of the pub was taken away after the fire", "the public was free to enter the domain of the duke", "general practice is to use the source of the spring",
    "permission was granted by the court in the end", "he used the software without any fee for a year", "the terms were made available to the press on monday", "this program was shown on the second channel",
    "the mozart of the north was born here", "eclipse watchers met on the hill at noon", "creative work is seldom common in this trade", "a copy of the letter lies in the drawer",
    "the apache people lived in the south", "version two of the plan was under review", "they modify the engine and distribute the parts", "the rights of the tenant were reserved for later",
    "without restriction the goats ate the hedge", "in binary terms a one is a switch that is on", "the work was licensed as a tavern song",
]
UNKNOWN = "unknown"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def grams(w: str, n: int) -> Column:
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(F.col(w), i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))


def template_grams() -> list[str]:
    out = set()
    for _, text in TEMPLATES:
        w = [x for x in re.split(r"[^a-z0-9]+", text.lower()) if x]
        out |= {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}
    return sorted(out)


def _fixed(known: list[str]) -> Column:
    """A fixed list of grams as one literal."""
    return F.split(F.lit("|".join(known)), r"\|")


def _has_template_gram(text: Column) -> Column:
    known = template_grams()
    first = sorted({g.split()[0] for g in known})

    def at(w: Column, i: Column) -> Column:
        return F.get(w, i).isin(first) & F.concat_ws(" ", *[F.get(w, i + k) for k in range(3)]).isin(known)

    # the array binds the words, so that they are split once
    return F.exists(F.array(tokens(text)), lambda w: F.exists(F.sequence(F.lit(0), F.size(w)), lambda i: F.coalesce(at(w, i), F.lit(False))))


def _features(df: DataFrame) -> DataFrame:
    return df.withColumn("w", tokens(F.col("text"))).withColumn("grams", F.array_distinct(F.concat(grams("w", 1), grams("w", 2), grams("w", 3))))


def inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def training_rows() -> list[dict]:
    """Notices cut, wrapped and set amid prose by rule, and prose; held rows are the calibration's own."""
    out = []
    for k, (family, text) in enumerate(TEMPLATES):
        w = text.split()
        one, two = NEGATIVES[k % len(NEGATIVES)], NEGATIVES[(k * 7 + 3) % len(NEGATIVES)]
        variants = [text, text.upper(), f"Copyright 2020 the authors. {text}", f"{text} See the file for details.", " ".join(w[1:]), " ".join(w[:-1]), f"note {text.lower()} thanks", f"(c) 2019 {text} no warranty", f"{one}. {text}", f"{one}. {text} {two}."]
        out += [{"label": family, "text": v, "held": False} for v in variants]
    for i, text in enumerate(NEGATIVES):
        out += [{"label": UNKNOWN, "text": v, "held": False} for v in (text, text + " on the way home", "and " + text, f"{text}. {NEGATIVES[(i * 5 + 1) % len(NEGATIVES)]}")]
    out += [{"label": f, "text": t, "held": True} for f, t in HELD_NOTICES]
    return out + [{"label": UNKNOWN, "text": t, "held": True} for t in HELD_PROSE]


#: Temperatures tried, a tenth to a hundred.
GRID = [10 ** (k / 20 - 1) for k in range(61)]


_MODELS: dict[str, dict] = {}


def train(spark: SparkSession) -> dict:
    """{families, weights: {gram: [per family]}, bias, temperature}; fitted once a session on the fixed table above."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    if (key := spark.sparkContext.applicationId) in _MODELS:
        return _MODELS[key]
    names = sorted({f for f, _ in TEMPLATES} | {UNKNOWN})
    rows = [r | {"y": float(names.index(r["label"]))} for r in training_rows()]
    data = _features(inline(spark, rows, "label string, text string, held boolean, y double")).coalesce(1).cache()
    vec = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(data.filter("not held"))
    seen = vec.transform(data)
    lr = LogisticRegression(labelCol="y", regParam=0.002, maxIter=60).fit(seen.filter("not held"))
    held = [(list(r.rawPrediction), int(r.y)) for r in lr.transform(seen.filter("held")).select("rawPrediction", "y").collect()]

    def loss(t: float) -> float:
        total = 0.0
        for raw, y in held:
            top = max(raw)
            total -= (raw[y] - top) / t - math.log(sum(math.exp((x - top) / t) for x in raw))
        return total

    matrix, bias = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    model = {"families": names, "bias": [float(x) for x in bias], "temperature": min(GRID, key=loss), "weights": {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(vec.vocabulary)}}
    data.unpersist()
    _MODELS[key] = model
    return model


def scan(docs: DataFrame, cut: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """(doc_id, paragraph, n_words, predicted, probability, overlap, family): one row per paragraph with a 3-gram of a template; paragraphs count from 0."""
    spark = docs.sparkSession
    model = train(spark)
    names = model["families"]
    paras = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paras = paras.select("doc_id", F.xxhash64("text").alias("row_key"), F.posexplode(F.split("text", r"\n(?:[ \t\r]*\n)+", -1)).alias("paragraph", "text")).filter(_has_template_gram(F.col("text")))
    paras = _features(paras).withColumn("g3", F.array_distinct(grams("w", 3)))
    kept = [F.size("w").alias("n_words"), F.array_intersect("grams", _fixed(list(model["weights"]))).alias("grams"), F.size("g3").alias("n3"), F.array_intersect("g3", _fixed(template_grams())).alias("g3")]
    paras = paras.select("doc_id", "row_key", "paragraph", *kept)  # what no weight and no template knows stays behind
    weights = F.broadcast(inline(spark, [{"gram": g, "wt": w} for g, w in model["weights"].items()], "gram string, wt array<double>"))  # a fixed table
    # copies of a row would add up; they are scored once and given back their number
    one = paras.groupBy("doc_id", "row_key", "paragraph").agg(F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("n_words", "grams", "n3", "g3")])
    hit = one.withColumn("gram", F.explode_outer("grams")).join(weights, "gram", "left")
    held = ["times", "n_words", "n3", "g3"]
    score = hit.groupBy("doc_id", "row_key", "paragraph").agg(*[F.first(c).alias(c) for c in held], *[F.sum(F.coalesce(F.get("wt", F.lit(i)), F.lit(0.0))).alias(f"s{i}") for i in range(len(names))])
    raw = F.array(*[(F.col(f"s{i}") + b) / model["temperature"] for i, b in enumerate(model["bias"])])
    score = score.select("doc_id", "row_key", "paragraph", *held, raw.alias("raw")).withColumn("top", F.array_max("raw"))
    score = score.withColumn("at", F.array_position("raw", F.col("top")).cast("int")).withColumn("probability", 1 / F.aggregate("raw", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    score = score.withColumn("predicted", F.when(F.col("probability") >= cut, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("at"))).otherwise(UNKNOWN))
    shapes = _features(inline(spark, [{"predicted": f, "text": t} for f, t in TEMPLATES], "predicted string, text string")).select("predicted", F.array_distinct(grams("w", 3)).alias("t3"))
    shapes = F.broadcast(shapes.groupBy("predicted").agg(F.collect_list("t3").alias("templates")))  # as many rows as families
    joined = score.join(shapes, "predicted", "left")
    like = F.array_max(F.transform(F.coalesce("templates", F.array().cast("array<array<string>>")), lambda t: F.size(F.array_intersect(t, F.col("g3"))) / F.greatest(F.least(F.size(t), F.col("n3")), F.lit(1))))
    joined = joined.withColumn("overlap", F.coalesce(like, F.lit(0.0)))
    out = joined.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.col("n_words").cast("long").alias("n_words"), "predicted", "probability", "overlap", F.when(F.col("overlap") >= overlap, F.col("predicted")).otherwise(UNKNOWN).alias("family"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return out.drop("copy")
