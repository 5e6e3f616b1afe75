"""Licence scans with DataFrame functions alone: a trained classifier of paragraphs, confirmed by templates.

1. Paragraphs are lines, and two or three neighbouring lines together, as notices are often wrapped.
2. A paragraph is compared with the templates below: the share of a template's pairs of words that it has. What reaches
   CONFIRM for no template cannot be confirmed whatever it is classified as, so only the others are classified. Texts and
   paragraphs without any of the words that `_telling` names cannot reach it and are not compared.
3. Features are the groups of one to three words of the templates that hold a telling word: whether a paragraph has them.
   A multinomial logistic regression with an L1 penalty tells licence families and `unknown` apart. It is trained on variants
   of the templates, among them halves, and on half of the lines of the whole table that are like no template; the
   probability that a family must reach is calibrated on the other half. No line is left out: lines of equal features are
   one row that weighs as many as they are, and lines with features weigh as much together as those without.
4. A finding is a paragraph whose family reaches that probability and is confirmed by a template of the same family. Of
   paragraphs within each other the shortest counts.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Weight in training of all lines of the table without features, and of all with some; a variant of a template weighs FAMILY.
OTHERS, FAMILY = 1000.0, 5.0
#: Share of a template's word pairs that confirms a prediction; share from which on a paragraph is not taken as unknown.
CONFIRM, LIKE = 0.6, 0.5
#: Neighbouring lines of a paragraph, at most.
SPAN = 3
UNKNOWN = "unknown"
#: Words of templates that much text holds; they only decide how few texts are compared, not what is found.
COMMON = "a and any are as be by for in is of or that the this to under with".split()

# Sentences by which each family is usually named.
TEMPLATES: list[tuple[str, str]] = [
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
]


def _words(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _pairs(words):
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.filter(F.zip_with(words, after, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())


def _known() -> dict[str, list[list[str]]]:
    """Of each family the distinct word pairs of its templates."""
    import re

    found: dict[str, list[list[str]]] = {}
    for family, template in TEMPLATES:
        words = [w for w in re.split(r"[\W_]+", template.lower()) if w]
        found.setdefault(family, []).append(sorted({f"{a} {b}" for a, b in zip(words, words[1:])}))
    return found


def _telling() -> list[str]:
    """Words of which every paragraph holds one that has CONFIRM of some template's pairs.

    Of each template the longest words, until more than 1 - CONFIRM of its pairs hold one of them; words chosen before come first, COMMON ones last.
    """
    chosen: set[str] = set()
    for pairs in sorted((p for templates in _known().values() for p in templates), key=len):
        held = [set(p.split(" ")) for p in pairs]
        own: set[str] = set()
        for word in sorted(set().union(*held), key=lambda w: (w in COMMON, w not in chosen, -len(w), w)):
            if sum(bool(p & own) for p in held) > (1 - CONFIRM) * len(held) + 1e-9:
                break
            own.add(word)
        chosen |= own
    return sorted(chosen)


def _may_tell(text):
    return F.lower(text).rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(_telling()) + r")(?![\p{L}\p{N}])")


def _told(rows: DataFrame) -> DataFrame:
    """rows with `words` and `_pairs` of their paragraph. Generators make them, so that filters on what follows do not make them again."""
    rows = rows.select("*", F.explode(F.array(_words(F.col("paragraph")))).alias("words"))
    return rows.select("*", F.explode(F.array(_pairs(F.col("words")))).alias("_pairs"))


def _list(values: list[str]):
    return F.array(*map(F.lit, values))


def _share(pairs, family: str):
    """The largest share of a template of the family that pairs holds."""
    return F.greatest(*(F.size(F.array_intersect(_list(t), pairs)) / len(t) for t in _known()[family]), F.lit(0.0))


def _compared(rows: DataFrame) -> DataFrame:
    """rows with `words` and `likeness`, the largest share of any template; only rows with a pair of words of some template."""
    every = sorted({p for templates in _known().values() for t in templates for p in t})
    paired = _told(rows.where(_may_tell(F.col("paragraph")))).where(F.arrays_overlap("_pairs", _list(every)))
    return paired.withColumn("likeness", F.greatest(*(_share(F.col("_pairs"), f) for f in _known()), F.lit(0.0)))


def _features() -> list[str]:
    """Groups of one to three words of the templates with a word that is neither common nor a number."""
    import re

    found: set[str] = set()
    for _, template in TEMPLATES:
        words = [w for w in re.split(r"[\W_]+", template.lower()) if w]
        groups = [words[i : i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        found |= {" ".join(g) for g in groups if any(w not in COMMON and not w.isdigit() for w in g)}
    return sorted(found)


def _grammed(rows: DataFrame) -> DataFrame:
    """rows (words, _pairs ...) with `grams`, their features in order, each once."""
    w, pairs = F.col("words"), F.col("_pairs")
    third = F.slice(w, F.lit(3), F.greatest(F.size(w) - 2, F.lit(0)))
    triples = F.filter(F.zip_with(pairs, third, lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    known = _features()
    found = F.array_sort(F.array_distinct(F.filter(F.concat(w, pairs, triples), lambda g: g.isin(known))))
    return rows.select("*", F.explode(F.array(found)).alias("grams"))


def _vectors(rows: DataFrame) -> DataFrame:
    """rows (grams ...) with the sparse vector `features`."""
    return CountVectorizerModel.from_vocabulary(_features(), inputCol="grams", outputCol="features", binary=True).transform(rows)


def paragraphs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, text_hash, paragraph_no, n_lines, paragraph): every line of every text, by its number from 0, and up to `span` neighbouring ones as one."""
    text = F.col(text_col).cast("string")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text).alias("text_hash"), F.split(text, r"\r\n|\r|\n").alias("_lines")).where(F.size("_lines") > 0)
    whole = F.transform("_lines", lambda x, i: F.array(*(F.struct(F.lit(n).alias("n_lines"), F.when(i + n <= F.size("_lines"), F.array_join(F.slice("_lines", i + 1, F.lit(n)), " ") if n > 1 else x).alias("paragraph")) for n in range(1, span + 1))))
    found = rows.select("doc_id", "text_hash", F.posexplode(whole).alias("paragraph_no", "_p")).select("doc_id", "text_hash", "paragraph_no", F.inline("_p"))
    return found.where(F.col("paragraph").rlike(r"[\p{L}\p{N}]"))


def templates(spark: SparkSession) -> DataFrame:
    """(template, family, paragraph); a table of literals, so that no Python worker makes it."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(family).alias("family"), F.lit(text).alias("paragraph")) for i, (family, text) in enumerate(TEMPLATES)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _variants(spark: SparkSession) -> DataFrame:
    """Templates with words before and after, with their first or last word gone, and their halves where these have six words or more."""
    w = _words(F.col("paragraph"))
    n = F.size(w)
    half = F.floor(n / 2).cast("int")
    halves = [F.when(n >= 12, F.slice(w, F.lit(1), F.greatest(half, F.lit(1)))), F.when(n >= 12, F.slice(w, half + 1, F.greatest(n - half, F.lit(1))))]
    forms = F.array(w, F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(1))), F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(1))), F.concat(_list(["copyright", "notice"]), w), F.concat(_list(["this", "file", "is"]), w), F.concat(w, _list(["see", "the", "file", "for", "details"])), *halves)
    return templates(spark).select("family", F.explode(F.array_compact(forms)).alias("w")).select("family", F.array_join("w", " ").alias("paragraph"))


def _unknown(lines: DataFrame) -> DataFrame:
    """(grams, train, n): how many of all lines that are like no template have these features, in the half that is trained on and in the other.

    The halves are chosen by a hash of the text. What has no word of the features is not taken apart.
    """
    every = sorted({p for templates in _known().values() for t in templates for p in t})
    told = "|".join(g for g in _features() if " " not in g)
    may = F.lower("paragraph").rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{told})(?![\p{{L}}\p{{N}}])")
    rows = lines.select((F.xxhash64("paragraph", F.lit(5)) % 2 == 0).alias("train"), F.when(may, F.col("paragraph")).otherwise("").alias("paragraph"))
    rows = _grammed(_told(rows))
    likeness = F.when(F.arrays_overlap("_pairs", _list(every)), F.greatest(*(_share(F.col("_pairs"), f) for f in _known()))).otherwise(0.0)
    return written(rows.where(likeness < LIKE).groupBy("grams", "train").agg(F.count("*").alias("n")))


def fit(lines: DataFrame) -> tuple[LogisticRegressionModel, list[str], float]:
    """(model, families in order of its classes, probability that a family must reach)."""
    spark = lines.sparkSession
    families = [*sorted({f for f, _ in TEMPLATES}), UNKNOWN]
    label = F.array_position(_list(families), F.col("family")).cast("double") - 1
    unknown, some = _unknown(lines), F.size("grams") > 0
    total = {r["some"]: r["n"] for r in unknown.where("train").groupBy(some.alias("some")).agg(F.sum("n").alias("n")).collect()}  # two rows
    share = F.when(some, F.lit(OTHERS / total.get(True, 1))).otherwise(F.lit(OTHERS / total.get(False, 1)))
    other = unknown.where("train").select("grams", F.lit(UNKNOWN).alias("family"), (F.col("n") * share).alias("weight"))
    made_up = spark.range(1).select(F.explode(_list(["lorem ipsum dolor sit amet", "the of and to in is", "he read the general public license at length", "the software is free of charge for schools", "all rights and duties were reserved to the king"])).alias("paragraph"))
    own = _variants(spark).select("paragraph", "family", F.lit(FAMILY).alias("weight")).union(made_up.select("paragraph", F.lit(UNKNOWN), F.lit(1.0)))
    rows = _vectors(_grammed(_told(own)).select("grams", "family", "weight").union(other)).select("features", label.alias("label"), "weight")
    rows = rows.coalesce(8).cache()
    model = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=5e-4, maxIter=40, weightCol="weight", standardization=False).fit(rows)
    rows.unpersist()
    held = _classified(unknown.where("not train"), model, families).where(F.col("family") != UNKNOWN).agg(F.percentile("probability", 0.99, F.col("n"))).first()[0]
    return model, families, min(0.95, max(0.5, held or 0.0))


def _classified(df: DataFrame, model: LogisticRegressionModel, families: list[str]) -> DataFrame:
    """df (grams ...) with `family` and `probability`."""
    scored = model.setProbabilityCol("_probability").setRawPredictionCol("").setPredictionCol("_class").transform(_vectors(df))
    named = F.element_at(_list(families), F.col("_class").cast("int") + 1)
    return scored.withColumns({"family": named, "probability": F.array_max(vector_to_array("_probability"))}).drop("grams", "features", "_probability", "_class")


def license_scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph that names a licence: doc_id, paragraph_no (its first line), n_lines, family, probability, similarity, confirmed, n_chars.

    Null and empty texts have no paragraphs. Rows that repeat an id and its text give one result, other rows of the id their own; a null id stays null.
    Lines may be of any length. Of equal probabilities the family first in the alphabet counts. `confirmed` holds in every row; what no template
    confirms is no finding. Other columns are not read. An empty table gives an empty result.
    """
    lines = paragraphs(documents.where(_may_tell(F.col(text_col).cast("string"))), id_col, text_col)
    model, families, bar = fit(paragraphs(documents, id_col, text_col, span=1).select("paragraph"))
    like = written(_grammed(_compared(lines).where(F.col("likeness") >= CONFIRM)).drop("_pairs", "words"))
    named = _told(_classified(like, model, families).where((F.col("family") != UNKNOWN) & (F.col("probability") >= bar)))
    similarity = F.lit(0.0)
    for family in _known():
        similarity = F.when(F.col("family") == family, _share(F.col("_pairs"), family)).otherwise(similarity)
    found = written(named.withColumn("similarity", similarity).where(F.col("similarity") >= CONFIRM).drop("_pairs", "words", "likeness").distinct())
    # A longer paragraph stays where no shorter one of its family lies within it.
    keys = ["text_hash", "family"]
    kept = found.where("n_lines = 1")
    for n in range(2, SPAN + 1):
        longer = found.where(F.col("n_lines") == n)
        inner = kept.select(*keys, F.col("paragraph_no").alias("_no"), F.col("n_lines").alias("_n"))
        starts = longer.select(*keys, "paragraph_no", F.explode(F.sequence(F.col("paragraph_no"), F.col("paragraph_no") + n - 1)).alias("_no"))
        within = starts.join(inner, [*keys, "_no"]).where(F.col("_no") + F.col("_n") <= F.col("paragraph_no") + n).select(*keys, "paragraph_no")
        kept = kept.union(longer.join(within, [*keys, "paragraph_no"], "left_anti").select(kept.columns))
    return kept.select("doc_id", "paragraph_no", "n_lines", "family", "probability", "similarity", F.lit(True).alias("confirmed"), F.length("paragraph").alias("n_chars"))
