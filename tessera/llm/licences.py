"""Licence scans by a trained paragraph classifier (DataFrame functions and Spark ML transformers only).

Lines, and paragraphs of the lines between blank ones, become sparse vectors of words and word
pairs; a multinomial logistic regression tells how likely each licence family is. A limit on
the probability of any family, calibrated on rows that the fit has not seen, sends doubtful
text away, and every family stands only where one of its templates is found in the text;
what passes without one is unknown.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import cut

#: Notices of licence families as they are published, in short form; fixed values.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "Proprietary": (
        "All rights reserved. No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "Copyright. All rights reserved.",
    ),
}
#: Sentences that speak of licences, or share their words, without granting one.
OTHER = (
    "The driver showed a licence and the officer let the car go.",
    "Version 2.0 of the software was released in spring with a new license dialog.",
    "The general public is free to use the library in terms of the new rules.",
    "Permission to build was granted by the town in compliance with the law.",
    "The museum is open to the public and free of charge for any person under sixteen.",
    "She reserved a table for two and signed a copy of the book.",
    "He was licensed to practise medicine under the laws of the state.",
    "The foundation published its report on free software and source code.",
    "Common creative work needs attribution from the people who use it.",
    "The file contains the following conditions for the use of the form.",
)
#: Words between spaces that name a family, as in SPDX expressions.
IDS = {
    family: t.split(": ")[1].lower().removesuffix("-only").removesuffix("-or-later") for family, group in TEMPLATES.items() for t in group if t.startswith("SPDX")
}
ONE_ID = "(?:" + "|".join(x.replace(".", "\\.") + "(?:-only|-or-later)?" for x in IDS.values()) + ")"
#: "All rights reserved" stands beside many licences and grants nothing.
RESERVED = "Proprietary"
#: Two ids or more side by side or joined by or, and: a choice of licences, which needs no other words.
LISTED = f"(?<![^ ]){ONE_ID}(?:(?: or| and)? {ONE_ID})+(?![^ ])"
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *TEMPLATES)
#: Words and pairs that the training rows hold in so many rows; others have no weight, so unseen text says nothing.
FEATURES, LEAST_ROWS = 1 << 14, 4
#: Training rows a template, of which one in HELD_OUT calibrates; unknown rows in all. These bound the fit.
VARIANTS, UNKNOWN_ROWS, HELD_OUT = 24, 1200, 5
#: Share of unlicensed held-out rows that may pass the limit; share of a template's word pairs that a paragraph must hold.
FALSE_SHARE, TEMPLATE_SHARE = 0.01, 0.6
#: A licence must at least be likelier than none, however well the calibration rows are told apart.
LEAST_LIMIT = 0.5
SEED = 11


def training_rows() -> list[tuple[str, int, bool]]:
    """(paragraph, class, held out): templates with words lost, added and wrapped in other text; other text alone."""
    r = random.Random(SEED)
    syllable = lambda: r.choice("bcdfghlmnprstvw") + r.choice("aeiou")
    noise = lambda least, most: " ".join("".join(syllable() for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most)))
    every = [w for group in TEMPLATES.values() for t in group for w in t.split()]
    rows: list[tuple[str, int]] = []
    for label, family in enumerate(FAMILIES):
        for template in TEMPLATES.get(family, ()):
            for i in range(VARIANTS):
                w = template.split()
                if i and len(w) > 6:
                    w = [x for x in w if r.random() > 0.06]
                text = " ".join(w)
                if i % 3 == 1:
                    text = f"Copyright (c) {r.randint(1990, 2026)} {noise(1, 3)}. {text}"
                if i % 4 == 2:
                    text = f"{noise(1, 25)}. {text} {noise(0, 12)}"
                if i % 6 == 5:
                    text = text.upper()
                rows.append((text, label))
    for i in range(UNKNOWN_ROWS):
        kind = i % 4
        if kind == 0:
            rows.append((noise(1, 60), 0))
        elif kind == 1:
            rows.append((" ".join(r.choice(every) if r.random() < 0.3 else noise(1, 1) for _ in range(r.randint(2, 40))), 0))
        elif kind == 2:
            rows.append((f"{noise(0, 10)} {r.choice(OTHER)} {noise(0, 10)}", 0))
        else:
            rows.append((r.choice(OTHER), 0))
    r.shuffle(rows)
    return [(text, label, i % HELD_OUT == 0) for i, (text, label) in enumerate(rows)]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits, points inside and hyphens."""
    plain = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}.-]+|\\.(?![\\p{L}\\p{N}])", " ")
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def pairs(w: Column) -> Column:
    """Neighbouring words as one string."""
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def grams(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with w (words), p (word pairs) and g (words and pairs)."""
    return paired(rows.withColumn("w", tokens(F.col(text))))


def paired(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", pairs(F.col("w"))).withColumn("g", F.concat("w", "p"))


def fit(spark: SparkSession) -> tuple[CountVectorizerModel, LogisticRegressionModel, float]:
    """Vocabulary, model, and the least probability of all families together that is believed."""
    rows = spark.createDataFrame(training_rows(), "text string, label int, held boolean").coalesce(2)
    rows = cut(grams(rows, "text").select("g", F.col("label").cast("double").alias("label"), "held"), "training")
    vocabulary = CountVectorizer(inputCol="g", outputCol="features", binary=True, vocabSize=FEATURES, minDF=LEAST_ROWS).fit(rows.where("not held"))
    rows = vocabulary.transform(rows)
    model = LogisticRegression(family="multinomial", elasticNetParam=0.9, regParam=3e-4, maxIter=40).fit(rows.where("not held"))
    best = model.transform(rows.where("held and label = 0")).select(licensed(F.col("probability")).alias("p"))
    limit = best.agg(F.percentile("p", 1 - FALSE_SHARE)).first()[0]
    return vocabulary, model, max(LEAST_LIMIT, limit)


def licensed(probability: Column) -> Column:
    """The probability of all families other than unknown; two that a text names share it."""
    return 1 - F.get(vector_to_array(probability), F.lit(0))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row, part (first line of the lines around), no (line), joined, w: lines, and the lines between blank ones as one."""
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.split(F.col(text_col), "\n").alias("lines"))
    rows = rows.where("lines is not null").withColumn("n", F.size("lines"))
    blank = lambda i: ~F.get(F.col("lines"), i).rlike("\\S")
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | blank(i)))
    stop = lambda i: F.coalesce(F.get(F.col("starts"), i + 1), F.col("n"))
    parts = F.transform("starts", lambda s, i: F.struct(s.alias("part"), F.slice("lines", s + 1, stop(i) - s).alias("lines")))
    parts = rows.select("id", "row", F.explode(parts).alias("x")).select("id", "row", "x.part", "x.lines")
    split = F.transform("lines", lambda x, i: F.struct((F.col("part") + i).alias("no"), F.lit(False).alias("joined"), tokens(x).alias("w")))
    parts = parts.select("id", "row", "part", F.filter(split, lambda x: F.size(x["w"]) > 0).alias("c")).where("size(c) > 0")
    whole = F.struct(F.get("c", F.lit(0))["no"].alias("no"), F.lit(True).alias("joined"), F.flatten("c.w").alias("w"))
    both = F.when(F.size("c") > 1, F.concat("c", F.array(whole))).otherwise(F.col("c"))
    return parts.select("id", "row", "part", F.explode(both).alias("x")).select("id", "row", "part", "x.*")


def families(found: DataFrame) -> DataFrame:
    """``found`` with shares (of the best template, by family) and labels: the families whose templates the text holds.

    The best share comes first. Templates of families are alike, so a further family must
    hold as much of what the templates of those before it lack.
    """
    of = [[pairs(tokens(F.lit(t))) for t in TEMPLATES.get(family, ())] for family in FAMILIES]
    every = F.array(*[F.struct(F.lit(label).alias("label"), t.alias("t")) for label, group in enumerate(of) for t in group])
    chains = F.regexp_extract_all(F.array_join("w", " "), F.lit(LISTED), F.lit(0))
    base = F.transform(F.split(F.array_join(chains, " "), " "), lambda x: F.regexp_replace(x, "-(only|or-later)$", ""))
    found = found.withColumn("every", every).withColumn("ids", base)
    share = lambda t, of: F.size(F.array_intersect(F.col("p"), t)) / F.size(of)
    listed = [F.array_contains("ids", IDS[f]) if f in IDS else F.lit(False) for f in FAMILIES]
    best = [F.greatest(F.lit(0.0), F.lit(0.0), *[share(t, F.array_distinct(t)) for t in group]) for group in of]
    found = found.withColumn("shares", F.array(*[F.when(x, 1.0).otherwise(y) for x, y in zip(listed, best, strict=True)])).withColumn("listed", F.array(*listed))
    ranked = F.transform("shares", lambda x, i: F.struct(x.alias("share"), F.get("probs", i).alias("p"), i.alias("label")))
    ranked = F.reverse(F.array_sort(F.filter(ranked, lambda x: x["share"] >= TEMPLATE_SHARE)))
    state = F.struct(F.array().cast("array<int>").alias("labels"), F.array().cast("array<string>").alias("seen"))

    def step(a: Column, x: Column) -> Column:
        own = F.filter("every", lambda t: t["label"] == x["label"])

        def further(t: Column) -> Column:
            rest = F.array_except(t["t"], a["seen"])
            return (share(t["t"], F.array_distinct(t["t"])) >= TEMPLATE_SHARE) & (F.size(rest) > 0) & (share(rest, rest) >= TEMPLATE_SHARE)

        named = (F.size(a["labels"]) == 0) | F.get("listed", x["label"]) | ((x["label"] != FAMILIES.index(RESERVED)) & F.exists(own, further))
        more = F.struct(F.concat(a["labels"], F.array(x["label"])).alias("labels"), F.array_union(a["seen"], F.flatten(F.transform(own, lambda t: t["t"]))).alias("seen"))
        return F.when(named, more).otherwise(a)

    return found.withColumn("labels", F.aggregate(ranked, state, step, lambda a: a["labels"]))


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs of ``docs`` that grant a licence.

    Returns id_col, paragraph (its first line, lines counted from 0), family, probability and
    template_share, one row per family that a line holds. The lines between blank ones are
    also read as one text, and give a row, under the first of them, for each family that no
    single line of them holds. A line, or else such a text, that the classifier takes for a
    licence and that no template confirms is unknown, unless it is part of a notice found in
    the lines around it.

    Null text: no paragraphs. Null ids and repeated rows are scanned like others. Empty
    table: empty result. Other columns are not read, whatever they are called.
    """
    spark = docs.sparkSession
    vocabulary, model, limit = fit(spark)
    scored = model.transform(vocabulary.transform(paired(candidates(docs, id_col, text_col))))
    # of ids side by side, one at least is no common word as "mit" is
    ids = F.array(*[F.lit(x + tail) for x in IDS.values() if "-" in x or "." in x or x[-1].isdigit() for tail in ("", "-only", "-or-later")])
    listed = F.when(F.arrays_overlap("w", ids), F.array_join("w", " ").rlike(LISTED)).otherwise(False)
    found = scored.where((licensed(F.col("probability")) >= limit) | listed)
    found = cut(found.select("id", "row", "part", "no", "joined", "w", "p", vector_to_array("probability").alias("probs")), "passed")
    found = families(found).select("id", "row", "part", F.struct("joined", "no", "p", "probs", "shares", "labels").alias("c"))
    found = found.groupBy("row", "part").agg(F.first("id").alias("id"), F.array_sort(F.collect_list("c")).alias("c"))
    lines, whole = F.filter("c", lambda c: ~c["joined"]), F.get(F.filter("c", lambda c: c["joined"]), F.lit(0))
    found = found.withColumn("lines", lines).withColumn("whole", whole)
    by_line = F.array_distinct(F.flatten(F.transform("lines", lambda c: c["labels"])))
    beyond = F.coalesce(F.array_except(F.col("whole.labels"), by_line), F.array().cast("array<int>"))
    found = found.withColumn("beyond", beyond)
    notice = F.array(*[F.flatten(F.array(F.array().cast("array<string>"), *[pairs(tokens(F.lit(t))) for t in TEMPLATES.get(f, ())])) for f in FAMILIES])
    found = found.withColumn("notice", F.flatten(F.transform("beyond", lambda x: F.get(notice, x))))

    def row(c: Column, label: Column, of: Column) -> Column:
        return F.struct(c["no"].alias("no"), label.alias("label"), F.get(c["probs"], of).alias("p"), F.get(c["shares"], of).alias("share"))

    def unknown(c: Column) -> Column:
        known = F.slice(c["probs"], 2, len(FAMILIES) - 1)
        return row(c, F.lit(0), F.array_position(known, F.array_max(known)).cast("int"))

    part = lambda c: F.size(F.array_intersect(c["p"], F.col("notice"))) >= TEMPLATE_SHARE * F.size(F.array_distinct(c["p"]))
    alone = F.transform(F.filter("lines", lambda c: (F.size(c["labels"]) == 0) & ~((F.size("beyond") > 0) & part(c))), unknown)
    named = F.flatten(F.transform("lines", lambda c: F.transform(c["labels"], lambda x: row(c, x, x))))
    more = F.transform("beyond", lambda x: row(F.col("whole"), x, x))
    rest = F.when(F.col("whole").isNotNull() & (F.size("lines") == 0) & (F.size("whole.labels") == 0), F.array(unknown(F.col("whole"))))
    out = found.select("id", F.explode(F.concat(named, alone, more, F.coalesce(rest, F.slice(alone, 1, 0)))).alias("x"))
    return out.select(
        F.col("id").alias(id_col), F.col("x.no").cast("long").alias("paragraph"), F.get(F.array(*map(F.lit, FAMILIES)), F.col("x.label")).alias("family"),
        F.round("x.p", 4).alias("probability"), F.round("x.share", 4).alias("template_share"),
    )
