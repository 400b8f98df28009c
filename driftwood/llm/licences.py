"""Licence scans with a trained paragraph classifier.

Features of a paragraph are its lower-case words and word pairs, restricted
to a vocabulary of terms that occur in licence notices and in no more than
``COMMON`` of ordinary paragraphs; so a paragraph without such a term has no
feature at all.  A multinomial logistic regression (Spark ML, elastic net)
over these sparse vectors has one class per licence family and ``unknown``.

Training rows: the public notices in ``NOTICES`` with every variant that
lacks one word or keeps only one half, against all paragraphs of the corpus
(those that mention licensing left out) and texts that talk about licences
without granting one.  Paragraphs with the same features are one weighted row;
the corpus weighs as much as ``PROSE`` paragraphs where it has more, so that the
notices count at any size.  A fifth of both is held back: the acceptance
threshold is the smallest that keeps the share of held-back unknown paragraphs
which pass below ``FALSE_ACCEPTS``, and at least one half.

A prediction is confirmed if the paragraph's terms and those of one of the
family's notices agree (at least ``AGREE`` of the smaller set is shared) and
the paragraph has a term that no other family's notices have.

Everything on the main path is a built-in function or an ML transformer:
texts are cut into paragraphs and words once, and of every paragraph the terms
that notices have are written to the shared checkpoint folder.  Training reads
these, and so does the search for documents with an accepted paragraph, the
only ones that are cut again.  No shuffle but for the sums of training and for
putting paragraphs back to documents, which moves licence paragraphs only.

Defined cases: null, empty and wordless texts hold no licence; a notice that
occurs several times counts once per paragraph; rows that repeat an id get
the findings of all of its rows; rows without an id get none.
"""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.session import ensure_checkpoint_dir

COMMON, TERMS, PROSE = 0.002, 4_096, 3_000
FALSE_ACCEPTS, AGREE = 0.001, 0.5

#: Public short notices by family (fixed values).
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0"],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0."],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0."],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "SPDX-License-Identifier: CC0-1.0"],
}
#: Texts about licences that grant none.
OTHERS = [
    "Please read the license before you use the software.",
    "A driving license is required to rent a car in this country.",
    "The committee discussed public licences and copyright law.",
    "See the file for the terms and conditions that apply to visitors.",
    "The software is free for students; ask the office for permission.",
    "All rights reserved.",
    "The general public was admitted free of charge.",
]
#: Words that keep a paragraph out of the unknown class.
MENTIONS = r"(?i)licen[sc]|copyright|warrant|permission|redistribut|public domain|creative commons|spdx"


def words(text: Column) -> Column:
    """Lower-case words: letters, digits and inner - and . ."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def terms(w: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(w, F.slice(pairs, 1, F.greatest(F.size(w) - 1, F.lit(0)))))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, paragraph_no, paragraph, words); a paragraph is a line."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, r"\R")).alias("paragraph_no", "paragraph"))
            .withColumn("words", words(F.col("paragraph"))))


def notice_rows(spark: SparkSession) -> DataFrame:
    """(label, words): notices and texts about licences, with their variants."""
    known = spark.createDataFrame([(k, t) for k, ts in NOTICES.items() for t in ts]
                                  + [("unknown", t) for t in OTHERS], "label string, text string")
    w = known.select("label", words(F.col("text")).alias("w"))
    n = F.size("w")
    cuts = F.concat(
        F.array(F.col("w")),
        F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
            F.slice("w", 1, i - 1), F.slice("w", i + 1, n))),
        F.when(n >= 12, F.array(F.slice("w", 1, F.floor(n / 2).cast("int")),
                                F.slice("w", F.floor(n / 2).cast("int") + 1, n))).otherwise(F.array().cast("array<array<string>>")))
    return w.select("label", F.explode(cuts).alias("words"))


def _fold(label: Column) -> Column:
    return F.pmod(F.xxhash64(label, "words"), F.lit(5))


def notice_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mentions, fold, terms) of every paragraph that has a word: the terms
    that notices have too.  Written to the shared checkpoint folder."""
    spark = docs.sparkSession
    known = {t for r in notice_rows(spark).where("label <> 'unknown'").select(terms(F.col("words"))).collect() for t in r[0]}
    single, pairs = [sorted(t for t in known if (" " in t) == two) for two in (False, True)]
    halves = sorted({x for t in pairs for x in t.split(" ")})
    w = F.col("words")
    pair = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), lambda a, b: F.when(
        a.isin(halves) & b.isin(halves), F.concat_ws(" ", a, b)))
    found = F.array_distinct(F.concat(F.filter(w, lambda x: x.isin(single)),
                                      F.filter(pair, lambda x: x.isNotNull() & x.isin(pairs))))
    path = f"{ensure_checkpoint_dir(spark)}/licences-{uuid.uuid4().hex}"
    (paragraphs(docs.where(F.col(id_col).isNotNull()), id_col, text_col).where(F.size("words") > 0)
     .select("id", F.col("paragraph").rlike(MENTIONS).alias("mentions"), _fold(F.lit("unknown")).alias("fold"),
             found.alias("terms")).write.parquet(path))
    return spark.read.parquet(path)


def training_rows(docs: DataFrame, id_col: str, text_col: str, sample: int | None = None,
                  found: DataFrame | None = None) -> DataFrame:
    """(label, fold, terms, prose): notices, their variants, and the unknown
    paragraphs of all documents, or of the ``sample`` ones with the smallest md5
    of the id.  ``found``: the documents' ``notice_terms``, if there."""
    if sample is not None:
        ids = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct() \
            .orderBy(F.md5(F.col(id_col).cast("string"))).limit(sample)
        docs = docs.join(F.broadcast(ids), id_col, "left_semi")
    found = notice_terms(docs, id_col, text_col) if found is None else found
    notices = notice_rows(docs.sparkSession).select(
        "label", _fold(F.col("label")).alias("fold"), terms(F.col("words")).alias("terms"), F.lit(False).alias("prose"))
    return notices.unionByName(found.where("not mentions").select(
        F.lit("unknown").alias("label"), "fold", "terms", F.lit(True).alias("prose")))


class Model:
    """The fitted classifier: vocabulary, regression, threshold, labels."""

    def __init__(self, spark: SparkSession, rows: DataFrame):
        unknown = rows.where("label = 'unknown'")
        n_unknown, n_prose, n_held = unknown.agg(F.count("*"), F.count_if("prose"), F.count_if(F.col("fold") == 0)).first()
        rare = (unknown.select(F.explode("terms").alias("term")).groupBy("term").count()
                .where(F.col("count") > max(1.0, COMMON * n_unknown)).select("term"))
        found = (rows.where("label <> 'unknown'").select(F.explode("terms").alias("term")).groupBy("term").count()
                 .join(rare, "term", "left_anti").orderBy(F.desc("count"), "term").limit(TERMS).collect())
        self.vocabulary = [r["term"] for r in found]
        self.first_words = sorted({t for t in self.vocabulary if " " not in t})
        self.vectors = CountVectorizerModel.from_vocabulary(self.vocabulary, "terms", "features") \
            .setBinary(True)
        self.labels = ["unknown", *NOTICES]
        # rows with the same features are one, with their number
        same = rows.groupBy("label", "prose", (F.col("fold") == 0).alias("held"), F.array_sort(F.filter(
            "terms", lambda t: t.isin(self.vocabulary))).alias("terms")).agg(F.count("*").alias("n"))
        label = F.array_position(F.array(*map(F.lit, self.labels)), F.col("label")) - 1
        weight = F.when(F.col("prose"), 0.2 * min(1.0, PROSE / max(1, n_prose))) \
            .when(F.col("label") == "unknown", 0.2).otherwise(1.0) * F.col("n")
        data = self.vectors.transform(same.withColumn("y", label.cast("double")).withColumn("weight", weight)).cache()
        self.regression = LogisticRegression(
            labelCol="y", family="multinomial", maxIter=40, regParam=0.002, elasticNetParam=0.2,
            weightCol="weight").fit(data.where("not held"))
        # the unknown row that is one too many: its p is the threshold
        spare, self.threshold = int(FALSE_ACCEPTS * max(1, n_held)), 0.5
        passing = self.score(data.where("held and label = 'unknown'")).where("family <> 'unknown'")
        for r in passing.orderBy(F.desc("p")).limit(spare + 1).select("p", "n").collect():
            spare -= r["n"]
            if spare < 0:
                self.threshold = max(0.5, r["p"])
                break
        data.unpersist()
        grams = spark.createDataFrame([(k, t) for k, ts in NOTICES.items() for t in ts], "family string, text string") \
            .select("family", terms(words(F.col("text"))).alias("t")).groupBy("family").agg(F.collect_list("t").alias("t"))
        self.templates = {r["family"]: r["t"] for r in grams.collect()}  # the notices above, bounded
        used = {k: {x for t in ts for x in t} for k, ts in self.templates.items()}
        self.own_terms = {k: sorted(v.difference(*(o for j, o in used.items() if j != k)))
                          for k, v in used.items()}

    def score(self, data: DataFrame) -> DataFrame:
        """``data`` with features -> plus family (best class) and p."""
        out = self.regression.transform(data).withColumn("probs", vector_to_array("probability"))
        best = F.array_max("probs")
        return (out.withColumn("p", best)
                .withColumn("family", F.element_at(F.array(*map(F.lit, self.labels)),
                                                   F.array_position("probs", best).cast("int"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None,
         model: Model | None = None) -> DataFrame:
    """(id, paragraph_no, paragraph, family, p, confirmed) of every
    paragraph whose family is accepted.  Without a ``model`` one is trained on all
    documents, or on a ``sample`` of them."""
    spark = docs.sparkSession
    if model is None and sample is not None:
        model = Model(spark, training_rows(docs, id_col, text_col, sample))
    if model is None:
        found = notice_terms(docs, id_col, text_col)
        model = Model(spark, training_rows(docs, id_col, text_col, found=found))
        some = found.where(F.arrays_overlap("terms", F.array(*map(F.lit, model.first_words))))
        ids = (model.score(model.vectors.transform(some))
               .where((F.col("family") != "unknown") & (F.col("p") >= model.threshold)).select(F.col("id").alias(id_col)))
        docs = docs.join(ids.distinct(), id_col, "left_semi")
    has_term = F.arrays_overlap("words", F.array(*map(F.lit, model.first_words)))
    some = (paragraphs(docs.where(F.col(id_col).isNotNull()), id_col, text_col).where(has_term)
            .withColumn("terms", terms(F.col("words"))))
    scored = model.score(model.vectors.transform(some))
    agree = F.lit(False)
    for family, templates in model.templates.items():
        like = F.lit(False)
        for t in templates:
            common = F.size(F.array_intersect("terms", F.array(*map(F.lit, t))))
            like = like | (common / F.least(F.size("terms"), F.lit(len(t))) >= AGREE)
        own = F.arrays_overlap("terms", F.array(*map(F.lit, model.own_terms[family])))
        agree = agree | ((F.col("family") == family) & like & own)
    return (scored.where((F.col("family") != "unknown") & (F.col("p") >= model.threshold))
            .select(F.col("id").alias(id_col), "paragraph_no", "paragraph", "family", "p",
                    agree.alias("confirmed")))


def per_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Every row's id with its licence families (sorted, by ``+``; ``none``),
    the number of licence paragraphs, of confirmed ones, and the best p."""
    found = scan(docs, id_col, text_col, **kw).groupBy(id_col).agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), "+").alias("licence"),
        F.count("*").alias("n_paragraphs"), F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"),
        F.max("p").alias("score"))
    licence = F.when(F.coalesce("licence", F.lit("")) == "", "none").otherwise(F.col("licence"))
    return docs.select(id_col).join(found, id_col, "left").select(
        id_col, licence.alias("licence"), F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
