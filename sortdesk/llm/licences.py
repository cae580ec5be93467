"""Licence families of paragraphs: a trained classifier, confirmed by templates.

DataFrame and Spark ML operations only. A paragraph's features are its words and word pairs, as
sparse counts. A multinomial logistic regression with an elastic net is trained on variants of the
notices below (spans cut off, words lost), and on paragraphs of no family: sentences that talk of
licences without granting one, and shuffled notices. Its probabilities are calibrated: of a few
temperatures, the one with the least log loss on held-out variants divides the scores, and a
paragraph whose best family stays below MIN_PROBABILITY is of unknown family. A prediction
counts only if the paragraph holds enough of the word triples of one of the family's notices.

Paragraphs without any of the trigger words below have no licence feature and are unknown by
definition; a substring search passes them over.

Paragraphs are runs of text between blank lines, read without comment marks and with their lines
joined, so that a notice may be wrapped. The lines of a paragraph are candidates too. A notice
counts once: a paragraph stands for its lines of no family if none of them has its family already,
and a paragraph of no family gives way to its lines.

Defined results. Null or empty texts: no paragraphs, no family. Rows that share an id are one
document; null ids too. Repeated rows: found once more each. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written

#: Fixed notices: how each family is usually granted.
NOTICES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.", "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.", "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT"],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense"],
}
#: Notices of further families.
NOTICES |= {
    "AGPL": ["You should have received a copy of the GNU Affero General Public License along with "
             "this program.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "BSL": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file "
            "LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
            "SPDX-License-Identifier: BSL-1.0"],
    "CC0": ["To the extent possible under law, the author has dedicated all copyright and related "
            "and neighboring rights to this work to the public domain worldwide.",
            "SPDX-License-Identifier: CC0-1.0"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the "
            "Eclipse Public License v2.0 which accompanies this distribution",
            "SPDX-License-Identifier: EPL-2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with "
            "or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "PSF": ["SPDX-License-Identifier: PSF-2.0"],
    "WTFPL": ["SPDX-License-Identifier: WTFPL"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event "
             "will the authors be held liable for any damages arising from the use of this software. "
             "Permission is granted to anyone to use this software for any purpose, including "
             "commercial applications, and to alter it and redistribute it freely",
             "SPDX-License-Identifier: Zlib"],
}
#: How the licences of a family are called.
NAMES = {
    "AGPL": ["GNU Affero General Public License"],
    "Apache": ["Apache License, Version 2.0", "Apache License 2.0"],
    "BSD": ["BSD 2-Clause License", "BSD 3-Clause License", "BSD License"],
    "BSL": ["Boost Software License"],
    "EPL": ["Eclipse Public License"],
    "GPL": ["GNU General Public License"],
    "ISC": ["ISC License"],
    "LGPL": ["GNU Lesser General Public License"],
    "MIT": ["MIT License"],
    "MPL": ["Mozilla Public License"],
    "PSF": ["Python Software Foundation License"],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
    "Zlib": ["zlib License"],
}
#: Licences of no family here, so that the form of a notice alone is none.
FOREIGN = ["Artistic License 2.0", "Ruby License", "Microsoft Public License", "Academic Free License",
           "Acme Community License", "Open Company Public License", "General License", "Software License"]
FORMS = ("Licensed under the {}.", "Released under the {}.")
for _family, _names in NAMES.items():
    NOTICES[_family] = list(dict.fromkeys(
        [*NOTICES[_family], *(form.format(name) for name in _names for form in FORMS)]))
#: Paragraphs of no family.
UNKNOWN = "unknown"
OTHERS = [
    "A driver's license is required to rent a car in this city.",
    "The license fee must be paid before the end of the month.",
    "The city council licensed three new taxi companies last year.",
    "All rights reserved. No part of this book may be copied without permission.",
    "Please read the license agreement before you install the program.",
    "The warranty of the machine ends after two years of use.",
    "She asked for permission to leave the room early.",
    "The software was released in public after a long test.",
    "Copyright 2019 by the authors. All rights reserved.",
    "The license plate of the car could not be read.",
    "They share a license for the use of the radio band.",
    "Redistribution of income was the topic of the first lecture.",
    "The public library gives free access to general works of reference.",
    "Licensed doctors may work in all parts of the country.",
    "The Apache helicopter was released from service under the new rules.",
    "A free copy of the general terms can be found on the public page.",
]
OTHERS += [form.format(name) for name in FOREIGN for form in FORMS]
TRIGGERS = ("licen", "copyright", "permission", "redistribut", "spdx", "public domain",
            "subject to the terms", "free software")
#: Comment marks at the start and at the end of a line.
OPENING = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+!?|#+|;+|%+|<!--+|--+|>+|(?i:dnl|rem)\b)?[ \t]*"
CLOSING = r"(?m)(?<![ \t*#-])[ \t]*+(?:\*++/?|--+>|#++)?+[ \t]*+$"
WORD = r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]"
MIN_PROBABILITY, MIN_SHARE = 0.5, 0.6
VARIANTS, HELD_OUT = 24, 4


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def _runs(words: Column, n: int) -> Column:
    """Runs of n words; with fewer words, all of them as one run."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def grams(words: Column) -> Column:
    return F.concat(words, F.filter(_runs(words, 2), lambda g: g.contains(" ")))


def _fixed_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(family, text) out of literals."""
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in rows])))


def training_paragraphs(spark: SparkSession) -> DataFrame:
    """(family, words, held): variants of all notices and of paragraphs of no family."""
    texts = [(f, t) for f, ts in NOTICES.items() for t in ts] + [(UNKNOWN, t) for t in OTHERS]
    base = _fixed_rows(spark, texts).withColumn("words", words_of(F.col("text")))
    made = base.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    draw = lambda i, salt, n: F.pmod(F.xxhash64("text", "v", i, F.lit(salt)), F.lit(n))
    lost = F.filter("words", lambda w, i: (F.col("v") == 0) | (draw(i, 1, 12) > 0))
    cut = F.slice(lost, 1 + draw(F.lit(0), 2, 2).cast("int") * F.least(
        F.lit(2), F.floor(F.size(lost) / 6).cast("int")), F.size(lost))
    kept = made.select("family", F.when(F.col("v") == 0, F.col("words")).otherwise(cut).alias("words"),
                       "v", "text")
    mixed = made.where((F.col("v") < 6) & (F.col("family") != UNKNOWN)).select(
        F.lit(UNKNOWN).alias("family"), F.transform(F.array_sort(F.transform(
            "words", lambda w, i: F.struct(draw(i, 3, 1 << 30).alias("k"), w.alias("w")))),
            lambda s: s["w"]).alias("words"), "v", "text")
    return kept.unionByName(mixed).where("size(words) > 0").select(
        "family", grams(F.col("words")).alias("grams"), (F.col("v") % HELD_OUT == 3).alias("held"))


class LicenceModel:
    """The fitted classifier with its temperature."""

    def __init__(self, spark: SparkSession):
        rows = written(training_paragraphs(spark), "notices")
        self.families = sorted([*NOTICES, UNKNOWN])
        number = F.array_position(F.array(*map(F.lit, self.families)), F.col("family")) - 1
        rows = rows.withColumn("label", number.cast("double"))
        self.counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True,
                                      vocabSize=8192, minDF=2).fit(rows.where("not held"))
        train = self.counts.transform(rows.where("not held")).select("label", "features").coalesce(1)
        self.model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.3,
                                        maxIter=40).fit(train)
        held = self.model.transform(self.counts.transform(rows.where("held")).coalesce(1)).select(
            "label", vector_to_array("rawPrediction").alias("raw"))
        losses = held.agg(*[F.avg(-F.log(F.greatest(
            F.get(_softmax(F.col("raw"), t), F.col("label").cast("int")), F.lit(1e-12)))).alias(str(i))
            for i, t in enumerate(TEMPERATURES)]).first()
        self.temperature = TEMPERATURES[min(range(len(TEMPERATURES)), key=lambda i: losses[i])]

    def probabilities(self, paragraphs: DataFrame) -> DataFrame:
        """paragraphs (with grams) and their best family and its probability."""
        scored = self.model.transform(self.counts.transform(paragraphs))
        p = _softmax(vector_to_array("rawPrediction"), self.temperature)
        best = F.array_max(F.zip_with(p, F.array(*map(F.lit, self.families)),
                                      lambda x, f: F.struct(x.alias("p"), f.alias("family"))))
        return scored.withColumn("best", best).drop("features", "rawPrediction", "probability",
                                                    "prediction")


TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)


def _softmax(raw: Column, temperature: float) -> Column:
    top = F.array_max(raw)
    e = F.transform(raw, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def _template_share(family: Column, triples: Column, spark: SparkSession) -> Column:
    """Largest share of a notice's word triples that the paragraph holds, over its family."""
    notices = _fixed_rows(spark, [(f, t) for f, ts in NOTICES.items() for t in ts])
    rows = notices.select("family", _runs(words_of(F.col("text")), 3).alias("t")).collect()
    by_family = {}
    for r in rows:
        by_family.setdefault(r["family"], []).append(r["t"])
    shares = F.lit(0.0)
    for name, templates in by_family.items():
        held = [F.size(F.array_intersect(triples, F.array(*map(F.lit, dict.fromkeys(t)))))
                / len(set(t)) for t in templates]
        shares = F.when(family == name, F.greatest(*held) if len(held) > 1 else held[0]).otherwise(shares)
    return shares


def licence_paragraphs(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, paragraph, line, text, family, probability, share): paragraphs (line 0) and single
    lines (from 1) with trigger words. family is unknown where the model or the notices do not
    bear it out."""
    spark = docs.sparkSession
    triggers = "|".join(TRIGGERS)
    wrapped = triggers.replace(" ", r"\W+(?:(?:dnl|rem)\W+)?")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("whole")).where(
        F.col("whole").rlike(f"(?i){wrapped}")).withColumn("row", F.monotonically_increasing_id())
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        "whole", r"\r\n?", "\n"), OPENING, ""), CLOSING, "")
    parts = texts.select("id", "row", F.posexplode(F.split(bare, r"\n{2,}")).alias("paragraph", "text"))
    lines = F.filter(F.split("text", r"\n"), lambda t: F.trim(t) != "")
    joined = F.regexp_replace(F.array_join(lines, " "), r"\s+", " ")
    several = F.concat(F.array(F.when(F.size(lines) > 1, joined)), lines)
    parts = parts.select("id", "row", "paragraph", F.posexplode(several).alias("line", "text"))
    parts = parts.where(F.col("text").rlike(f"(?i){triggers}")).withColumn(
        "words", words_of(F.col("text"))).where("size(words) > 0")
    scored = model.probabilities(parts.withColumn("grams", grams(F.col("words"))))
    share = _template_share(F.col("best.family"), _runs(F.col("words"), 3), spark)
    scored = scored.withColumn("share", share)
    sure = ((F.col("best.p") >= MIN_PROBABILITY) & (F.col("share") >= MIN_SHARE)
            & (F.col("best.family") != UNKNOWN))
    scored = scored.withColumn("found", F.when(sure, F.col("best.family")))

    whole, one = F.col("line") == 0, Window.partitionBy("row", "paragraph")
    scored = scored.withColumns({
        "of_whole": F.max(F.when(whole, F.col("found"))).over(one),
        "of_lines": F.collect_set(F.when(~whole, F.col("found"))).over(one),
        "n_lines": F.count_if(~whole).over(one)})
    stands = F.coalesce(~F.array_contains("of_lines", F.col("of_whole")), F.lit(False))
    kept = F.when(whole, stands | (F.col("of_whole").isNull() & (F.col("n_lines") == 0))).otherwise(
        F.col("found").isNotNull() | ~stands)
    return scored.where(kept).select(
        "id", "paragraph", "line", "text", F.coalesce("found", F.lit(UNKNOWN)).alias("family"),
        F.round("best.p", 6).alias("probability"), F.round("share", 6).alias("share"))


def document_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_candidates, n_licences, families) for every id; families in order, joined by
    commas."""
    found = licence_paragraphs(docs, LicenceModel(docs.sparkSession), id_col, text_col)
    by_id = written(found.groupBy("id").agg(
        F.count("*").alias("n_candidates"), F.count_if(F.col("family") != UNKNOWN).alias("n_licences"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))),
                     ",").alias("families")), "licences")
    rows = docs.select(F.col(id_col).alias("doc_id"))
    return rows.join(by_id, rows["doc_id"].eqNullSafe(by_id["id"]), "left").select(
        "doc_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.coalesce("n_licences", F.lit(0)).alias("n_licences"),
        F.coalesce("families", F.lit("")).alias("families"))
