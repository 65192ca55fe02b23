"""Licence families of text paragraphs, in DataFrame operations only.

A paragraph is a line. Its features are the distinct word 1-, 2- and 3-grams that hold
one of CUES, so a line without any has no features and is never a licence; texts and
lines without a cue are passed over by plain substring tests. A multinomial logistic
regression over these sparse features gives each family, and ``unknown`` as a class of
its own, a probability. The threshold below which a line stays unknown is calibrated on
held-out lines that speak of licences without granting one. A prediction is confirmed by
comparison with the family's templates: the share of common word pairs, of the shorter
of both, that the nearest template has.

Training uses the labelled texts below and nothing else. Scoring is row by row, without
a shuffle.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.llm import buffers as bf

LEAST_PROBABILITY = 0.5
CONFIRMED = 0.6
FALSE_RATE = 0.02
MOST_TERMS = 1 << 14

# Stems of which a licence text has at least one.
CUES = ("licen", "copyright", "warrant", "redistribut", "permission", "creative commons", "public domain", "cc by", "cc-by", "cc0",
        "gnu", "gpl", "apache", "mozilla", "bsd", "unlicense", "rights reserved")

# Notices and leading paragraphs of public licences, by family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.", "This project is licensed under the MIT License.", "Licensed under the MIT license.",
        "The MIT License (MIT)", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License.", "Licensed under the GPL.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program."),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL.", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library."),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL.", "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program."),
    "bsd": (
        "Released under the BSD License.", "Licensed under the 3-clause BSD license.", "This software is licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "isc": (
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "cc-by": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 3.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense."),
    "proprietary": (
        "All rights reserved.", "Copyright (c) 2024 Example Inc. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Unauthorized copying or redistribution of this material is strictly prohibited."),
}

# Lines that speak of licences, rights or guarantees and grant nothing.
OTHERS = (
    "He lost his driver's license last week.", "The bar applied for a liquor license in May.", "The city licensed forty new taxis.",
    "A fishing license costs ten dollars a day.", "She is a licensed nurse and works at the hospital.", "The court issued a search warrant on Monday.",
    "The car comes with a three year warranty.", "This warrants a closer look at the numbers.", "Warranty claims must reach the dealer within a month.",
    "The tax redistributes income among regions.", "Redistribution of wealth was debated in parliament.", "The mayor asked for permission to speak.",
    "Set the file permissions to read only.", "You need permission from your parents.", "Copyright law was changed by the new act.",
    "The lecture was about copyright and trade marks in the music industry.", "Debates about the public domain filled the library.",
    "The Apache helicopter landed near the river.", "Apache people lived in the desert.", "The gnu grazed with the zebras.", "A herd of gnu crossed the river.",
    "Which license should I choose for my project?", "License fees rose again this year.", "The license expired and was not renewed.",
    "Mozilla held a meeting in the city.", "We compared licenses of several libraries.", "The software license server is down.", "Creative commons were once shared pastures.",
    "Please read the license before you install.", "Contact us about licensing the photographs.", "The studio bought a license to the song.",
    "Her license plate was stolen.", "Without permission nobody may enter the building.", "They reserved all rooms and the rights were reserved for later talks.",
)


def inline(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from one literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def words(line: Column) -> Column:
    """Lower-cased words; version numbers and hyphened names stay whole."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*"), F.lit(0))


def _join_words(w: Column, n: int) -> Column:
    """Runs of n words of an array."""
    if n == 1:
        return w
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(
        F.array().cast("array<string>"))


def has_cue(text: Column) -> Column:
    test = F.contains(text, F.lit(CUES[0]))
    for cue in CUES[1:]:
        test |= F.contains(text, F.lit(cue))
    return test


def terms(w: Column) -> Column:
    """Distinct 1- to 3-grams that hold a cue."""
    return F.array_distinct(F.filter(F.concat(w, _join_words(w, 2), _join_words(w, 3)), has_cue))


def pairs(w: Column) -> Column:
    return F.array_distinct(F.when(F.size(w) > 1, _join_words(w, 2)).otherwise(w))


class Classifier:
    """Vocabulary, regression, family names and the calibrated threshold."""

    def __init__(self, vocabulary: CountVectorizerModel, model: LogisticRegressionModel, families: list[str], threshold: float):
        self.vocabulary, self.model, self.families, self.threshold = vocabulary, model, families, threshold


def train(spark: SparkSession) -> Classifier:
    """Fits on the labelled texts; texts of odd place are held out to find the threshold."""
    families = ["unknown", *TEMPLATES]
    rows = [{"label": float(i), "place": k, "text": t} for i, f in enumerate(families) for k, t in enumerate(TEMPLATES.get(f, OTHERS))]
    known = inline(spark, rows, "label:double,place:int,text:string").select("label", "place", terms(words(F.col("text"))).alias("terms")).coalesce(1)
    vocabulary = CountVectorizer(inputCol="terms", outputCol="x", binary=True, minDF=1.0, vocabSize=MOST_TERMS).fit(known)
    x = vocabulary.transform(known).select("label", "place", "x").cache()
    fit = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-3, maxIter=60, family="multinomial", standardization=False).fit
    half = fit(x.where("place % 2 = 0"))
    tests = half.transform(x.where("place % 2 = 1 AND label = 0"))
    licensed = F.lit(1.0) - vector_to_array("probability")[0]
    threshold = tests.select(F.percentile(licensed, 1 - FALSE_RATE)).first()[0]
    model = fit(x)
    x.unpersist()
    return Classifier(vocabulary, model, families, min(0.95, max(LEAST_PROBABILITY, threshold)))


def _similarity(w: Column, family: Column) -> Column:
    """Greatest share of common word pairs with a template of the family."""
    known = json.dumps({f: [t.lower() for t in ts] for f, ts in TEMPLATES.items()})
    templates = F.transform_values(F.from_json(F.lit(known), "map<string,array<string>>"), lambda _, ts: F.transform(ts, lambda t: pairs(words(t))))
    own = pairs(w)
    shares = F.transform(F.element_at(templates, family), lambda t: F.size(F.array_intersect(own, t)) / F.greatest(F.lit(1), F.least(F.size(own), F.size(t))))
    return F.coalesce(F.array_max(shares), F.lit(0.0))


def scan(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """Per line with a cue: doc_id, line (from 1), family, probability, similarity, confirmed.

    ``family`` is unknown below the calibrated threshold; such lines are never confirmed,
    and their probability is that of no licence. ``docs`` needs doc_id and text; other
    columns are ignored. Null and empty texts have no lines with a cue. Rows stand for
    themselves: repeated rows give repeated results, rows without doc_id a null one. Of
    families of equal probability the first in order counts. An empty table gives no rows.
    """
    c = classifier or train(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bf.whole_text()).where(has_cue(F.lower("text")))
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words")).where(has_cue(F.lower("words")))
    lines = lines.select("doc_id", (F.col("line") + 1).alias("line"), words(F.col("words")).alias("words"))
    lines = lines.select("*", terms(F.col("words")).alias("terms"))
    scored = c.model.transform(c.vocabulary.transform(lines)).select("doc_id", "line", "words", vector_to_array("probability").alias("p"))
    names = F.array([F.lit(f) for f in c.families])
    licensed = F.lit(1.0) - F.col("p")[0]
    best = F.array_max(F.slice("p", 2, len(c.families)))
    found = scored.withColumn("family", F.when(licensed >= c.threshold, F.element_at(names, F.array_position(F.slice("p", 2, len(c.families)), best).cast("int") + 1))
                              .otherwise("unknown"))
    return (found.withColumn("probability", F.when(F.col("family") == "unknown", F.col("p")[0]).otherwise(best))
            .withColumn("similarity", F.when(F.col("family") == "unknown", 0.0).otherwise(_similarity(F.col("words"), F.col("family"))))
            .select("doc_id", F.col("line").cast("long").alias("line"), "family", "probability", "similarity",
                    (F.col("similarity") >= CONFIRMED).alias("confirmed")))
