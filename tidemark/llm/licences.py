"""Licence scans with a trained paragraph classifier, in DataFrame and pyspark.ml operations only.

Paragraphs become sparse counts of hashed word 1- to 3-grams; a multinomial logistic regression, trained here on licence
notices and on paragraphs of the corpus, names the licence family. A paragraph that is unlike ordinary text but not sure
enough of any family, by a limit calibrated on varied notices kept out of training, is of unknown licence. A named family
is confirmed by comparing the paragraph's word pairs with the family's notices.
"""

from __future__ import annotations

import zlib

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hashed_sample, table

#: Bounds of the corpus sample that stands for ordinary text: documents, and paragraphs of each.
ORDINARY_DOCS, ORDINARY_PARAGRAPHS = 1500, 5
BUCKETS = 1 << 13
SIMILAR = 0.5
#: Share of the kept-out notices that must stay above the limit of certainty.
SURE = 0.95
NONE, UNKNOWN = "none", "unknown"

# fixed values: the notices by which works of each family are licensed
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
        "This software is licensed under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution license, CC BY 3.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Available under CC BY-NC-SA 4.0 for non commercial use.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License, CC BY-SA 3.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Licensed under the GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This library is free software under the GNU Lesser General Public License, version 2.1.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "reserved": [
        "Copyright 2020 The Company. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This material is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
FAMILIES = [NONE, *sorted(NOTICES)]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def _variants(notice: str) -> list[str]:
    """The notice, its parts, and forms with words left out or ordinary beginnings and endings."""
    words = notice.split()
    out = [notice, notice.upper(), f"Note: {notice}", f"{notice} See below."]
    out += [" ".join(words[: max(4, len(words) * k // 4)]) for k in (2, 3)] + [" ".join(words[-max(4, len(words) * k // 4) :]) for k in (2, 3)]
    out += [" ".join(w for i, w in enumerate(words) if i % 9 != k) for k in range(4)] if len(words) > 9 else []
    out += [notice.replace("4.0", v).replace("version 3", f"version {v[0]}").replace("3.0", v) for v in ("2.0", "3.0", "1.0")]
    return out


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is computed once a row: what follows an explode is not merged with what it reads."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but ``text``, with paragraph (from 0) and body for every line that is not blank."""
    rest = [F.col(c) for c in docs.columns if c not in (text, "paragraph", "body")]
    return docs.select(*rest, F.posexplode(F.split(F.col(text), "\n")).alias("paragraph", "body")).where(F.col("body").rlike(r"\S"))


def _features(size: int = BUCKETS) -> list:
    grams = SQLTransformer(
        statement="SELECT *, concat(_words, zip_with(slice(_words, 1, greatest(size(_words) - 1, 0)), slice(_words, 2, greatest(size(_words) - 1, 0)), (a, b) -> concat(a, ' ', b)), "
        "zip_with(zip_with(slice(_words, 1, greatest(size(_words) - 2, 0)), slice(_words, 2, greatest(size(_words) - 2, 0)), (a, b) -> concat(a, ' ', b)), "
        "slice(_words, 3, greatest(size(_words) - 2, 0)), (a, b) -> concat(a, ' ', b))) AS _grams FROM __THIS__"
    )
    return [grams, HashingTF(inputCol="_grams", outputCol="_features", numFeatures=size, binary=True)]


def train(spark: SparkSession, docs: DataFrame) -> tuple[PipelineModel, float]:
    """The classifier and its limit of certainty, from a bounded sample that two tasks hold."""
    rows = [(v, float(FAMILIES.index(family)), zlib.crc32(v.encode()) % 5 == 0 and k > 0) for family, notices in NOTICES.items() for n in notices for k, v in enumerate(_variants(n))]
    notices = spark.createDataFrame(rows, "body string, label double, kept_out boolean")
    few = hashed_sample(docs.where(F.length("text") > 0).select("doc_id", "text"), ORDINARY_DOCS, "doc_id").select("text")
    plain = paragraphs(few).where(F.col("paragraph") < ORDINARY_PARAGRAPHS)
    marks = F.lower("body").rlike(r"licen[cs]|copyright|permi|redistrib|warrant|public domain|\bgnu\b|\bmit\b|spdx|reserved")
    plain = plain.where(~marks).select("body", F.lit(0.0).alias("label"), F.lit(False).alias("kept_out"))
    known = notices.unionByName(plain).withColumn("_words", _words(F.col("body"))).coalesce(2).cache()
    chain = Pipeline(stages=[*_features(), LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_class", regParam=0.002, maxIter=40, family="multinomial")])
    model = chain.fit(known.where("not kept_out"))
    sure = model.transform(known.where("kept_out")).withColumn("_p", F.array_max(vector_to_array("_probability"))).where("_class = label")
    limit = sure.agg(F.percentile("_p", F.lit(1 - SURE))).first()[0]
    known.unpersist()
    return model, float(limit if limit is not None else 0.5)


def _pairs(words: Column) -> Column:
    """The word pairs; of one word, that word."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n == 0, words).otherwise(F.array_distinct(pairs))


def scan(docs: DataFrame, model: PipelineModel, limit: float, text: str = "text") -> DataFrame:
    """The paragraphs of ``docs`` that carry a licence: paragraph, family, certainty, similarity, confirmed, body.

    Other columns stay; those named as new ones are replaced. Documents without such paragraphs, with null or blank
    texts have no rows; repeated rows give repeated findings. A paragraph is unlikely to be ordinary text and either of a
    family or ``unknown``; similarity is the share of the paragraph's word pairs found in the notice most like it.
    """
    spark = docs.sparkSession
    body = paragraphs(docs.drop("family", "certainty", "similarity", "confirmed"), text)
    names = body.columns
    scored = model.transform(_once(body, _words(F.col("body")), "_words")).select(*names, "_words", "_raw")
    found = _once(scored, vector_to_array("_raw"), "_margins").drop("_raw").withColumn("_top", F.array_max("_margins"))
    total = F.aggregate(F.transform("_margins", lambda m: F.exp(m - F.col("_top"))), F.lit(0.0), lambda a, x: a + x)
    found = found.withColumn("certainty", 1 / total).withColumn("_class", F.array_position("_margins", F.col("_top")) - 1)
    found = found.where((F.col("_class") != 0) & (F.exp(F.get("_margins", F.lit(0)) - F.col("_top")) / total < 1 - limit))
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("_class") + 1).cast("int"))
    found = found.withColumn("_named", family)
    notices = spark.createDataFrame([(f, n) for f, ns in NOTICES.items() for n in ns], "_named string, notice string")
    notices = notices.groupBy("_named").agg(F.collect_list(_pairs(_words(F.col("notice")))).alias("_notices"))
    # as many rows as families
    near = found.withColumn("_own", _pairs(F.col("_words"))).join(F.broadcast(notices), "_named")
    share = F.transform("_notices", lambda n: F.size(F.array_intersect("_own", n)) / F.least(F.size("_own"), F.size(n)))
    near = near.withColumn("similarity", F.array_max(share))
    confirmed = F.col("similarity") >= SIMILAR
    named = F.when(confirmed | (F.col("certainty") >= limit), F.col("_named")).otherwise(UNKNOWN)
    return near.select(*names[:-1], named.alias("family"), F.round("certainty", 6).alias("certainty"), F.round("similarity", 6).alias("similarity"), confirmed.alias("confirmed"), "body")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, *train(spark, docs))
