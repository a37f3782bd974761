"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

Paragraphs end at blank lines; wrapped lines are joined. A paragraph of several lines is
looked at as a whole and line by line, since a short notice may stand among other lines. Each
of these is described by the presence of word 1- and 2-grams of known licence texts: notices
made by rule, headings and characteristic body paragraphs, from the lists below. A multinomial
logistic regression, trained on these and on a bounded sample of the corpus's other
paragraphs (class "unknown"), gives a probability per family; a temperature fitted on
held-back rows calibrates them. What stays below the threshold is unknown. A predicted family
is confirmed by most of the word pairs of one of its notices, headings or body paragraphs, or
by all of one of its names. Every paragraph is scored where it is read: nothing is left out.

Nulls and special cases: a null text counts as empty (no licences); rows with null or
repeated ids keep a row each; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, stored

UNKNOWN = "unknown"
# Names of licence families and ways to grant one (fixed values).
FAMILIES: dict[str, list[str]] = {
    "apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "the Apache 2.0 license"],
    "bsd": ["the BSD License", "the BSD 3-Clause License", "the BSD 2-Clause License", "a BSD-style license", "BSD-3-Clause"],
    "cc-by": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC 3.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA 3.0"],
    "cc0": ["CC0 1.0", "the Creative Commons Zero v1.0 Universal dedication", "CC0 1.0 Universal"],
    "gpl-2": ["the GNU General Public License, version 2", "GPLv2", "GPL-2.0", "the GNU GPL version 2"],
    "gpl-3": ["the GNU General Public License, version 3", "GPLv3", "GPL-3.0", "the GNU GPL version 3"],
    "lgpl": ["the GNU Lesser General Public License", "LGPL-2.1", "LGPLv3", "the GNU LGPL version 3"],
    "mit": ["the MIT License", "the MIT license", "MIT License", "the MIT/Expat license"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0", "MPL-2.0", "the Mozilla Public License 2.0"],
}
GRANTS = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This file is distributed under {}.",
          "Available under the terms of {}.", "Published under {}.", "SPDX-License-Identifier: {}",
          "You may use this work under the terms of {}."]
OTHERS = ["Licensed under a separate agreement with the publisher.", "Released under embargo until the first of May.",
          "All rights reserved.", "A driver license is required.", "The work was released last year under a new name.",
          "This work is part of a series.", "You may use this file as an example.", "Version 2.0 of the file is available.",
          "Version 3 was published in May.", "The general public is invited.", "Terms of use apply.", "Attribution is required."]
HEADINGS: dict[str, list[str]] = {
    "apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "The 3-Clause BSD License", "New BSD License", "BSD License"],
    "cc-by": ["Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0 International Public License", "Attribution 4.0 International"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons Attribution-NonCommercial 4.0 International Public License",
                 "Attribution-NonCommercial 4.0 International"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike 4.0 International Public License",
                 "Attribution-ShareAlike 4.0 International"],
    "cc0": ["Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal"],
    "gpl-2": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl-3": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "mit": ["MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"],
    "mpl-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
}
_GNU = ("This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free "
        "Software Foundation; either version {} of the License, or (at your option) any later version.")
BODIES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
        "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "cc-by": ["You are free to share and adapt the material for any purpose, even commercially, under the following terms: Attribution. You "
              "must give appropriate credit, provide a link to the license, and indicate if changes were made."],
    "cc-by-nc": ["You are free to share and adapt the material under the following terms: Attribution, NonCommercial. You may not use the "
                 "material for commercial purposes."],
    "cc-by-sa": ["You are free to share and adapt the material under the following terms: Attribution, ShareAlike. If you remix, transform, or "
                 "build upon the material, you must distribute your contributions under the same license as the original."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights "
            "to the work worldwide under copyright law."],
    "gpl-2": [_GNU.format("program", "General Public License", "2")],
    "gpl-3": [_GNU.format("program", "General Public License", "3")],
    "lgpl": [_GNU.format("library", "Lesser General Public License", v) for v in ("2.1", "3")],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
#: What names a licence, as part of a line and as a word of it.
NAMES = ["licenc", "licens", "copyright", "gpl", "apache", "creative commons", "mozilla", "cc0", "redistribut", "warrant", "hereby",
         "free software", "provided that the following"]
NAME_WORDS = ["mit", "bsd", "cc"]
#: Bound of the training sample (paragraphs of the corpus).
SAMPLE = 2000
ITERATIONS = 40
THRESHOLD = 0.5
CONFIRM = 0.6
TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def pairs(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def grams(w: Column) -> Column:
    return F.array_distinct(F.concat(w, pairs(w)))


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as a literal of the plan."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(parsed).alias("r")).select("r.*")


def notices() -> list[dict]:
    """Every grant with every name of every family."""
    return [{"family": f, "notice": g.format(n)} for f, names in FAMILIES.items() for n in names for g in GRANTS]


def templates() -> list[dict]:
    """What confirms a family, and the share of its word pairs (of a single word: itself) needed:
    all of a name, else ``None`` for the caller's share."""
    out = [{"family": n["family"], "text": n["notice"], "need": None} for n in notices()]
    out += [{"family": f, "text": t, "need": None} for known in (HEADINGS, BODIES) for f, ts in known.items() for t in ts]
    return out + [{"family": f, "text": n, "need": 1.0} for f, names in FAMILIES.items() for n in names]


PARAGRAPH_END = "\n[ \t\r\f\x0B]*\n"


def with_words(paragraph: str) -> Column:
    """The lines of a paragraph that hold a word."""
    return F.filter(F.split(paragraph, "\n"), lambda x: x.rlike("[A-Za-z0-9]"))


def paragraphs(docs: DataFrame, text: str = "text", **more: Column) -> DataFrame:
    """Paragraphs with a word (``pos``: number in the document; ``line``: the paragraph, and if it
    has several lines each of them), with all other columns of ``docs`` kept and ``more`` made
    from the column ``paragraph``."""
    rest = [c for c in docs.columns if c != text]
    some = docs.select(*rest, F.posexplode(F.split(F.col(text), PARAGRAPH_END)).alias("pos", "paragraph"))
    some = some.select("*", *[e.alias(c) for c, e in more.items()])
    lines = with_words("paragraph")
    several = F.when(F.size(lines) > 1, F.concat(F.array("paragraph"), lines)).otherwise(lines)
    return some.select(*rest, "pos", *more, F.explode(several).alias("line"))


def in_words(docs: DataFrame, known: list[str], text: str = "text") -> DataFrame:
    """``paragraphs`` with the words ``w`` of each ``line``, null for a word that is not ``known``;
    those of a paragraph are its lines'."""
    rest = [c for c in docs.columns if c != text]
    some = docs.select(*rest, F.posexplode(F.split(F.col(text), PARAGRAPH_END)).alias("pos", "paragraph"))
    parts = F.transform(with_words("paragraph"), lambda x: F.struct(
        x.alias("line"), F.transform(words(x), lambda w: F.when(w.isin(known), w)).alias("w")))
    each = some.select(*rest, "pos", "paragraph", F.explode(F.array(parts)).alias("parts"))
    whole = F.struct(F.col("paragraph").alias("line"), F.flatten(F.transform("parts", lambda x: x["w"])).alias("w"))
    several = F.when(F.size("parts") > 1, F.concat(F.array(whole), F.col("parts"))).otherwise(F.col("parts"))
    return each.select(*rest, "pos", F.inline(several))


def names_one(text: str) -> Column:
    """Whether a text names a licence. Plain substrings are found much quicker than a regex, which
    looks only at texts that may match."""
    low = F.lower(text)
    whole = [low.contains(x) & low.rlike(rf"\b{x}\b") for x in NAME_WORDS]
    return reduce(or_, [low.contains(x) for x in NAMES] + whole)


def sampled(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``sample`` different paragraphs (whole ``line``, hash ``h``) that name no licence."""
    # what no name stands in, has no line with one: lines are looked at only in other paragraphs
    corpus = paragraphs(pick(docs, text=text_col), named=names_one("paragraph")).where(~(F.col("named") & names_one("line")))
    # different paragraphs, so that a common one counts once: those whose hash lies below a
    # bound that about four times the sample pass, then the smallest hashes among them
    hashed = corpus.select("line", F.xxhash64("line").alias("h"))
    n = hashed.agg(F.approx_count_distinct("h").alias("n")).first().n
    if n > 4 * sample:
        hashed = hashed.where(F.pmod("h", F.lit(1 << 40)) < F.lit((1 << 40) * 4 * sample // n))
    return hashed.dropDuplicates(["h"]).orderBy("h").limit(sample)


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> dict:
    """Trains on the notices and ``sample`` different paragraphs of ``docs`` (drawn by their
    hashes among paragraphs that name no licence). Everything returned is bounded by the lists
    above and ``sample``."""
    spark = docs.sparkSession
    known = literal_rows(spark, notices(), "family string, notice string").withColumn("w", words(F.col("notice")))
    plain = literal_rows(spark, [{"line": x} for x in OTHERS], "line string")
    other = stored(plain.unionAll(sampled(docs, text_col, sample).select("line")).withColumn("w", words(F.col("line"))))
    written = literal_rows(spark, [{"family": t["family"], "text": t["text"]} for t in templates()[len(notices()):]], "family string, text string")
    rows = stored(known.select("family", grams(F.col("w")).alias("g"))
                  .unionAll(other.select(F.lit(UNKNOWN).alias("family"), grams(F.col("w")).alias("g")))
                  .withColumn("held", F.pmod(F.xxhash64("g", "family"), F.lit(5)) == 0)
                  .unionAll(written.select("family", grams(words(F.col("text"))).alias("g"), F.lit(False).alias("held"))).coalesce(1))
    classes = [UNKNOWN, *sorted(FAMILIES)]
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("double") - 1
    vectors = CountVectorizer(inputCol="g", outputCol="x", binary=True, minDF=1.0, vocabSize=1 << 20).fit(rows.where(F.col("family") != UNKNOWN))
    train = vectors.transform(rows.where(~F.col("held")).withColumn("label", label))
    lr = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=1e-3, maxIter=ITERATIONS, standardization=False)
    model = lr.fit(train)
    out = {"classes": classes, "vectors": vectors, "regression": model, "temperature": 1.0}
    out["temperature"] = _temperature(rows.where("held"), out)
    return out


def logits(rows: DataFrame, model: dict, keys: list[str], g: str = "g") -> DataFrame:
    """``keys`` and the class scores ``z`` of each row, from its n-grams ``g``."""
    x = model["vectors"].setInputCol(g).setOutputCol("x").transform(rows.select(*keys, g))
    scored = model["regression"].transform(x)
    # an explode of one, so that no filter on z moves below and has it computed again
    return scored.select(*keys, F.explode(F.array(vector_to_array(F.col("rawPrediction")))).alias("z"))


def probabilities(z: Column, temperature: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def _temperature(held: DataFrame, model: dict) -> float:
    """The temperature of ``TEMPERATURES`` with the least log loss on the held-back rows."""
    scored = logits(held, model, ["family"])
    grid = scored.select("family", "z", F.explode(F.array(*[F.lit(t) for t in TEMPERATURES])).alias("t"))
    at = F.array_position(F.array(*[F.lit(c) for c in model["classes"]]), F.col("family")).cast("int") - 1
    p = F.get(probabilities(F.col("z"), F.col("t")), at)
    loss = grid.groupBy("t").agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss"))
    best = loss.orderBy("loss", F.abs(F.col("t") - 1)).first()
    return float(best.t) if best else 1.0


def classify(docs: DataFrame, model: dict, keys: list[str], text: str = "text", threshold: float = THRESHOLD,
             confirm: float = CONFIRM) -> DataFrame:
    """Licence texts of ``docs``: ``keys``, ``pos`` of the paragraph, ``family``, ``p``, ``likeness``
    (share of the best template's word pairs that the text holds) and ``confirmed``; a row for
    the paragraph and each of its lines that are one."""
    spark = docs.sparkSession
    # words and pairs that no n-gram of the model holds are nulls, dropped before they are looked up;
    # the vectors are binary, so repeated n-grams may stay
    known_words = sorted({w for g in model["vectors"].vocabulary for w in g.split(" ")})
    lines = in_words(docs.select(*keys, text), known_words, text)
    z = logits(lines.withColumn("g", F.array_compact(F.concat(F.col("w"), pairs(F.col("w"))))), model, [*keys, "pos", "line"])
    # a class before unknown in probability is so in its score: after an explode of one, the
    # probabilities are for few rows
    z = z.where(F.get("z", F.lit(0)) < F.array_max("z")).select(*keys, "pos", "line", F.explode(F.array("z")).alias("z"))
    classes = F.array(*[F.lit(c) for c in model["classes"]])
    best = z.withColumn("p_", probabilities(F.col("z"), F.lit(model["temperature"]))).withColumn("p", F.array_max("p_"))
    best = best.withColumn("family", F.get(classes, F.array_position("p_", F.col("p")).cast("int") - 1))
    best = best.where((F.col("family") != UNKNOWN) & (F.col("p") >= threshold)).select(*keys, "pos", "line", "family", "p")

    def marks(c: Column) -> Column:  # single words for names of one word
        w = words(c)
        return F.array_distinct(F.when(F.size(w) > 1, pairs(w)).otherwise(w))

    known = literal_rows(spark, templates(), "family string, text string, need double").select(
        "family", marks(F.col("text")).alias("t"), F.coalesce("need", F.lit(confirm)).alias("need"))
    known = known.groupBy("family").agg(F.collect_list(F.struct("t", "need")).alias("known"))
    # explodes of one, so that the n-grams are made once for a text and not for every template
    found = best.withColumn("w", F.explode(F.array(words(F.col("line"))))).withColumn("has", F.explode(F.array(grams(F.col("w")))))
    found = found.join(F.broadcast(known), "family")
    found = found.withColumn("shares", F.transform("known", lambda k: F.struct(
        (F.size(F.array_intersect(F.col("has"), k["t"])) / F.size(k["t"])).alias("share"), k["need"].alias("need"))))
    return found.select(*keys, "pos", "family", "p", F.array_max(F.transform("shares", lambda x: x["share"])).alias("likeness"),
                        F.exists("shares", lambda x: x["share"] >= x["need"]).alias("confirmed"))


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_paragraphs`` (with a predicted family), ``n_confirmed`` of
    them and ``licences`` (sorted confirmed families, comma-joined)."""
    d = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("h", F.xxhash64("text"))  # tells rows apart that share an id
    found = classify(d, model, ["id", "h"])
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    no, never = F.lit(None).cast("string"), F.lit(None).cast("int")
    rows = d.select("id", "h", one.alias("copies"), never.alias("pos"), never.alias("sure"), no.alias("family"))
    sure = F.col("confirmed")
    hits = found.select("id", "h", zero.alias("copies"), "pos", F.when(sure, F.col("pos")).alias("sure"), F.when(sure, F.col("family")).alias("family"))
    t = rows.unionAll(hits).groupBy("id", "h").agg(
        F.sum("copies").alias("copies"), F.size(F.collect_set("pos")).cast("long").alias("n_paragraphs"),
        F.size(F.collect_set("sure")).cast("long").alias("n_confirmed"),
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("licences"))
    # equal rows have the same paragraphs
    return t.select("id", "n_paragraphs", "n_confirmed", "licences", F.explode(F.sequence(one, F.col("copies"))).alias("i")).drop("i")


def op5(docs: DataFrame) -> DataFrame:
    return scan(docs, fit(docs)).withColumnRenamed("id", "doc_id")
