"""Licence notices by a trained paragraph classifier (operator 2).

A paragraph is a line of a text. Those of its words and pairs of neighbouring
words that some template has are hashed to sparse features of a multinomial
logistic regression over licence families and an unknown class. The families
are learned from notice templates in many settings, the unknown class from all
paragraphs of the corpus: those of equal features are one example with their
number as its weight. A family is predicted where its probability passes a bar
calibrated on the paragraphs that were not trained on; the family's templates
then confirm the prediction or not. Everything runs in DataFrame operations; no
Python sees a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeclerk.llm.scratch import written

FEATURES = 1 << 14
SAMPLE = 4_000  # documents that the settings are drawn from, about
UNKNOWN_WEIGHT = 2_000.0  # of the unknown class's examples together; a template in a setting has 1
STEPS = 10_000  # the bar is a whole number of such parts
SETTINGS = 40  # paragraphs that each template is set in
FALSE_SHARE = 0.001  # of held out unknown paragraphs that may pass the bar
LEAST_BAR = 0.5
CONFIRMED = 0.6  # share of a template's word pairs that a notice has
UNKNOWN = "unknown"

# Short notices as their licences ask for them, by family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
}
FAMILIES = [*TEMPLATES, UNKNOWN]


def words(text: Column) -> Column:
    """Lower case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def pairs(tokens: Column) -> Column:
    """Neighbouring words, joined."""
    return F.when(
        F.size(tokens) > 1,
        F.zip_with(
            F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
            F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))


def paragraphs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``paragraph``, ``line``, ``tokens``) of every line that has a word."""
    lines = documents.select(
        documents[key], F.posexplode(F.split(documents[text], r"\n")).alias("paragraph", "line")
    )
    # Not by the number of tokens, which would be cut out of every line twice.
    return lines.where(F.col("line").rlike(r"[\p{L}\p{N}]")).withColumn("tokens", words(F.col("line")))


def _vocabulary() -> list[str]:
    """Words of the templates and pairs of neighbouring ones."""
    found = set()
    for lines in TEMPLATES.values():
        for line in lines:
            tokens = re.findall(r"[^\W_]+", line.lower())
            found.update(tokens, map(" ".join, zip(tokens, tokens[1:])))
    return sorted(found)


def terms(tokens: Column) -> Column:
    """Distinct words and pairs that templates have, in order; others tell no family."""
    wanted = _vocabulary()
    held = F.filter(F.concat(tokens, pairs(tokens)), lambda term: term.isin(wanted))
    return F.array_sort(F.array_distinct(held))


def featured(rows: DataFrame) -> DataFrame:
    """``rows`` with hashed features of ``terms``."""
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features")
    return hashing.transform(rows)


def _templates() -> Column:
    """All templates, a literal of fixed size."""
    return F.array(
        *[
            F.struct(F.lit(family).alias("family"), F.lit(line).alias("line"))
            for family, lines in TEMPLATES.items()
            for line in lines
        ]
    )


@dataclass
class LicenseModel:
    """A fitted classifier and the probability that a prediction must pass."""

    classifier: LogisticRegressionModel
    bar: float


def fit(documents: DataFrame, key: str = "doc_id", text: str = "text") -> LicenseModel:
    """Fit and calibrate on all paragraphs of the corpus and all templates.

    Paragraphs are parted by a hash of their text, half to fit and half to
    calibrate, and counted by their features, on which all that follows depends;
    those that hold most of a template are no examples of the unknown class.
    Every template is fitted by itself, in upper case, and between the words of
    SETTINGS paragraphs, so that a notice in running text is learned too. Only
    these settings are drawn, from about SAMPLE documents taken by a hash of
    their row's number.
    """
    spark = documents.sparkSession
    total = max(1, documents.count())
    # A document gives one paragraph, drawn by a hash of the text.
    share = min(1.0, SAMPLE / total)
    draw = F.xxhash64(F.col(text), F.lit("paragraph"))
    lines = F.filter(F.split(F.col(text), r"\n"), lambda x: F.length(x) > 0)
    # Written first: what follows would otherwise be computed on every text.
    # Drawn by row, so that copies of one text are not all taken together.
    taken = documents.withColumn("_row", F.monotonically_increasing_id()).where(
        (F.length(text) > 0)
        & (F.pmod(F.xxhash64("_row"), F.lit(1 << 40)) < int(share * (1 << 40)))
    )
    some = (
        written(taken.select(text), "sample")
        .select(draw.alias("draw"), lines.alias("lines"))
        .where(F.size("lines") > 0)
        .select("draw", F.get("lines", F.pmod("draw", F.greatest(F.size("lines"), F.lit(1))).cast("int")).alias("line"))
        .withColumn("tokens", words(F.col("line")))
        .where(F.size("tokens") > 0)
    )
    every = paragraphs(documents, key, text).select(
        F.pmod(F.xxhash64("line", F.lit("fold")), F.lit(2)).alias("fold"),
        terms(F.col("tokens")).alias("terms"),
    )
    # Written, as the filter on the match would else be computed on every paragraph.
    counted = written(every.groupBy("fold", "terms").agg(F.count("*").alias("n")), "counted")
    counted = counted.withColumn("match", _best_match(F.col("terms"), F.col("terms")))
    plain = written(
        counted.where(F.col("match.share") < CONFIRMED).select("fold", "terms", "n"), "paragraphs"
    )
    to_fit, held_out = plain.where("fold = 0"), plain.where("fold = 1")
    plain_lines = some.where(_best_match(F.col("tokens"))["share"] < CONFIRMED)
    settings = (
        plain_lines.where(F.pmod(F.xxhash64("line", F.lit("fold")), F.lit(2)) == 0)
        .orderBy("draw", "line")
        .limit(SETTINGS)
        .select(F.col("line").alias("around"))
    )
    within = settings.select("around", F.explode(_templates()).alias("template"))
    alone = spark.range(1).select(
        F.lit(None).cast("string").alias("around"), F.explode(_templates()).alias("template")
    )
    alone = alone.select("around", "template.family", "template.line").select(
        "around",
        "family",
        F.explode(F.array_repeat(F.array("line", F.upper("line")), 10)).alias("lines"),
    )
    alone = alone.select("around", "family", F.explode("lines").alias("line"))
    positive = alone.unionByName(within.select("around", "template.family", "template.line")).select(
        "family",
        words(
            F.concat_ws(
                " ", F.substring("around", 1, 80), "line", F.substring("around", 81, 80)
            )
        ).alias("tokens"),
    )
    fitted = to_fit.agg(F.sum("n")).first()[0] or 1
    negative = to_fit.select(
        F.lit(UNKNOWN).alias("family"), "terms", (F.col("n") * (UNKNOWN_WEIGHT / fitted)).alias("weight")
    )
    names = F.array(*[F.lit(x) for x in FAMILIES])
    examples = (
        positive.select("family", terms(F.col("tokens")).alias("terms"), F.lit(1.0).alias("weight"))
        .unionByName(negative)
        .withColumn("label", (F.array_position(names, F.col("family")) - 1).cast("double"))
    )
    examples = written(examples, "examples")
    classifier = LogisticRegression(
        maxIter=40, regParam=1e-3, family="multinomial", weightCol="weight"
    ).fit(featured(examples))
    return LicenseModel(classifier, _bar(_scored(featured(held_out), classifier)))


def _bar(scored: DataFrame) -> float:
    """The least bar, LEAST_BAR or more, that no more than FALSE_SHARE of the paragraphs pass.

    Counted by whole parts of STEPS, so at most STEPS rows reach the driver.
    """
    steps = F.floor(F.col("best.p") * STEPS).alias("step")
    rows = scored.groupBy(steps).agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    most, passing = FALSE_SHARE * sum(row.n for row in rows), 0
    for row in rows:
        passing += row.n
        if passing > most:
            return max(LEAST_BAR, min(1.0, (row.step + 1) / STEPS))
    return LEAST_BAR


def _scored(rows: DataFrame, classifier: LogisticRegressionModel) -> DataFrame:
    """``rows`` with ``best``: the most probable family that is not unknown."""
    by_class = vector_to_array("probability")
    options = F.array(
        *[
            F.struct(F.get(by_class, F.lit(i)).alias("p"), F.lit(name).alias("family"))
            for i, name in enumerate(FAMILIES)
            if name != UNKNOWN
        ]
    )
    return classifier.transform(rows).withColumn("best", F.array_max(options))


def _best_match(tokens: Column, held: Column | None = None) -> Column:
    """The template of which the words, or the pairs ``held``, are the greatest share of pairs."""
    held = pairs(tokens) if held is None else held
    options = []
    for family, lines in TEMPLATES.items():
        for line in lines:
            wanted = F.array_distinct(pairs(words(F.lit(line))))
            share = F.size(F.array_intersect(wanted, held)) / F.size(wanted)
            options.append(F.struct(share.alias("share"), F.lit(family).alias("family")))
    return F.array_max(F.array(*options))


def license_notices(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    model: LicenseModel | None = None,
) -> DataFrame:
    """One row for each paragraph that is predicted to name a licence.

    Returns the key, ``paragraph`` (its number in the text, from 0), ``family``,
    ``probability``, ``template_share`` (the greatest share of a template of any
    family that it holds), ``template_family`` and ``confirmed``, whether both
    agree and the share is large enough. A paragraph of several licences has
    its most probable one. Null, empty and wordless texts have no rows; the key
    is passed on as it is. A table without paragraphs gives a model of the
    templates alone.
    """
    model = model or fit(documents, key, text)
    rows = paragraphs(documents, key, text).withColumn("terms", terms(F.col("tokens")))
    scored = _scored(featured(rows), model.classifier)
    found = scored.where(F.col("best.p") >= model.bar)
    found = found.withColumn("match", _best_match(F.col("tokens")))
    return found.select(
        key,
        "paragraph",
        F.col("best.family").alias("family"),
        F.col("best.p").alias("probability"),
        F.col("match.share").alias("template_share"),
        F.col("match.family").alias("template_family"),
        (
            (F.col("match.family") == F.col("best.family")) & (F.col("match.share") >= CONFIRMED)
        ).alias("confirmed"),
    )
