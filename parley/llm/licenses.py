"""Operator 2: licence scans. DataFrame functions only.

A text is cut into lines and words; comment marks are no words. Word pairs and triples, also those that run over the
end of a line, that occur in known licence texts are the features of a softmax classifier over licence families and the
class ``unknown``. Neighbouring lines that have any of them form a paragraph (a line without words ends it), so a licence
that is wrapped over many lines is one paragraph, as one that stands in a single line. The classifier judges
paragraphs, and each of their lines by itself. It is trained on whole, cropped, damaged and embedded templates against
lines of the corpus, and its temperature is fitted on examples it was not trained on, so the probability of
``unknown`` is calibrated. A predicted family is confirmed when the paragraph, or the line, covers enough of one of the
family's templates.

Of a paragraph its confirmed lines are reported, and the paragraph itself if it is confirmed for another family
than they are; a paragraph without a confirmed line is reported whole.

The n-grams of the templates are a list of a fixed size, against which n-grams are tested in the row; only those that
are known leave it, to meet the table of weights. Training takes a bounded sample (``BACKGROUND`` lines, drawn by
hash from all lines of documents drawn by hash); all lines are scanned.

Defined results: a null or empty text has no paragraphs and no licence; a licence line that a text repeats is reported
each time; of families found in one text the most probable confirmed one is the text's, ties by name; rows that agree
in id and text get equal results, also with null ids; long texts and lines are scanned whole; an empty
table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import join_same, literal_table, materialise

#: Wordings that name or carry a licence, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0.",
        "Licensed under CC0 1.0 Universal.",
    ),
    "GPL": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL v3.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: Words that alone make no feature; sentences that speak of licences without granting one.
FUNCTION_WORDS = frozenset("a an and any are as at be by for from if in is it not of on or that the this to was with you".split())
UNKNOWN_EXAMPLES = (
    "You need a driving license to rent a car in this country.",
    "The committee granted permission to publish the report.",
    "The software was released last year and is used by many schools.",
    "All copies of the book were sold within a week of its release.",
    "Her work is known to the public and she works without any conditions.",
    "The license fee for television is due in March.",
    "Please read the terms and conditions before you buy a ticket.",
    "The source of the river lies under the mountain.",
)

UNKNOWN = "unknown"
SIZES = (2, 3)
LEAST_PROBABILITY, LEAST_COVERAGE = 0.5, 0.6
#: Lines of the corpus that the classifier is trained against, and words of each that count there (from a place drawn by hash).
BACKGROUND, BACKGROUND_WORDS = 300, 120
#: Marks that begin the lines of comments, besides those that are no words anyway.
COMMENT = r"^\s*(?:rem|dnl)\b"


def tokens(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def grams(words: list[str]) -> set[tuple[str, ...]]:
    """Pairs and triples of words that are not function words only."""
    out = {tuple(words[i:i + n]) for n in SIZES for i in range(len(words) - n + 1)}
    return {g for g in out if not FUNCTION_WORDS.issuperset(g)}


def training_set(background: list[str]) -> list[tuple[list[str], str]]:
    """Tokens and class of whole, cropped, damaged and embedded templates and of background lines."""
    rng = np.random.default_rng(2)
    known = [(tokens(t), family) for family, texts in TEMPLATES.items() for t in texts]
    plain = [w for b in background if len(w := tokens(b)) > 1] + [tokens(b) for b in UNKNOWN_EXAMPLES]
    wholes = [grams(w) for w, _ in known]
    plain = [w for w in plain if max(len(grams(w) & g) / len(g) for g in wholes) < 0.3]  # corpora hold licence lines too
    out = [(w, UNKNOWN) for w in plain]
    for w, family in known:
        out += [(w, family)] * 3
        for _ in range(10):
            keep = max(3, int(len(w) * rng.uniform(0.6, 1.0)))
            at = int(rng.integers(0, len(w) - keep + 1))
            part = list(w[at:at + keep])
            if len(part) > 8:
                part.pop(int(rng.integers(0, len(part))))
            pad = plain[int(rng.integers(0, len(plain)))]
            out.append((pad[:10] + part + pad[10:20], family))
    return out


def train(background: list[str], rounds: int = 150, rate: float = 0.5, ridge: float = 1e-4):
    """(classes, n-grams, weights n-grams x classes, constants): softmax regression, divided by its temperature."""
    classes = [*sorted(TEMPLATES), UNKNOWN]
    features = sorted(set().union(*[grams(tokens(t)) for texts in TEMPLATES.values() for t in texts]))
    number = {g: i for i, g in enumerate(features)}
    rows = training_set(background)
    x = np.zeros((len(rows), len(features)), np.float32)
    for r, (w, _) in enumerate(rows):
        x[r, [number[g] for g in grams(w) if g in number]] = 1
    y = np.array([classes.index(c) for _, c in rows])
    share = np.bincount(y, minlength=len(classes)) / len(y)
    weight = (1 / np.sqrt(share[y]) / len(classes)).astype(np.float32)
    held = np.arange(len(rows)) % 5 == 4
    target = np.eye(len(classes), dtype=np.float32)[y]

    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    w, b = np.zeros((len(features), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    xt, tt, wt = x[~held], target[~held], weight[~held, None]
    moved = np.zeros_like(w)
    for _ in range(rounds):
        g = wt * (softmax(xt @ w + b) - tt) / len(xt) * len(classes)
        moved = 0.9 * moved + xt.T @ g + ridge * w
        w -= rate * moved
        b -= rate * g.sum(axis=0)
    z, th = x[held] @ w + b, y[held]
    heat = min(np.geomspace(0.25, 4, 25), key=lambda t: -np.log(softmax(z / t)[np.arange(len(th)), th] + 1e-9).mean())
    return classes, features, w / heat, b / heat


def line_words(line: Column) -> Column:
    """Words of a line, without comment marks."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), COMMENT, " "), "[^a-z0-9]+", " "))
    return F.filter(F.split(clean, " "), lambda w: w != "")


def background_lines(docs: DataFrame) -> list[str]:
    """At most ``BACKGROUND`` lines with words, each from one of the documents drawn by a hash of their text."""
    total = docs.count()
    draw = F.pmod(F.xxhash64(F.lit(2), "text"), F.lit(10_000_000))
    some = docs.where(draw < 10_000_000 * BACKGROUND // max(total, 1) + 1).orderBy(draw, "text").limit(BACKGROUND)
    h = F.xxhash64(F.lit(3), "text")
    some = some.select(h.alias("h"), F.filter(F.split("text", "\n"), lambda x: x.rlike("[A-Za-z0-9]")).alias("lines"))
    some = some.select("h", line_words(F.get("lines", F.pmod("h", F.greatest(F.size("lines"), F.lit(1))).cast("int"))).alias("w")).where(F.size("w") > 0)
    start = F.pmod(F.col("h"), F.greatest(F.size("w") - BACKGROUND_WORDS + 1, F.lit(1))).cast("int") + 1
    return [r.t for r in some.select(F.array_join(F.slice("w", start, BACKGROUND_WORDS), " ").alias("t")).collect()]


PLACE = ["doc_id", "text_hash", "first_line", "last_line"]


def known_grams(docs: DataFrame, known: list[int]) -> DataFrame:
    """(doc_id, text_hash, line, gram): word pairs and triples of the texts that are among ``known`` hashes, by the
    line (from 0) of their first word."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    # a line without words stands as one empty word, which no known n-gram has
    cut = F.transform("lines", lambda x: F.when(x.rlike("[A-Za-z0-9]"), line_words(x)).otherwise(F.array(F.lit(""))))
    lines = lines.select("doc_id", "text_hash", cut.alias("cut"))
    at = F.flatten(F.transform("cut", lambda w, k: F.array_repeat(k, F.size(w))))
    lines = lines.select("doc_id", "text_hash", F.flatten("cut").alias("w"), at.alias("at"))

    def of(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
        found = F.transform(starts, lambda i: F.struct(F.get("at", i).alias("line"), F.xxhash64(*[F.get("w", i + k) for k in range(n)]).alias("gram")))
        return F.filter(found, lambda x: x["gram"].isin(known))

    return lines.select("doc_id", "text_hash", F.explode(F.concat(*[of(n) for n in SIZES])).alias("g")).select("doc_id", "text_hash", "g.line", "g.gram")


def with_paragraphs(hits: DataFrame) -> DataFrame:
    """(PLACE, paragraph, gram) of known n-grams: each by its line and by its paragraph, the run of neighbouring lines
    that have any; ``paragraph`` is the run's first line."""
    hits = hits.distinct()  # rows that agree in id and text are one here
    w = Window.partitionBy("doc_id", "text_hash").orderBy("line")
    lines = hits.select("doc_id", "text_hash", "line").distinct()
    lines = lines.withColumn("run", F.col("line") - F.row_number().over(w))
    runs = lines.groupBy("doc_id", "text_hash", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    rows = join_same(hits, join_same(lines, runs, ["doc_id", "text_hash", "run"]).drop("run"), ["doc_id", "text_hash", "line"])
    units = F.array_distinct(F.array(F.struct(F.col("line").alias("a"), F.col("line").alias("b")), F.struct(F.col("first").alias("a"), F.col("last").alias("b"))))
    rows = rows.select("doc_id", "text_hash", F.col("first").alias("paragraph"), F.explode(units).alias("u"), "gram")
    return rows.select("doc_id", "text_hash", F.col("u.a").alias("first_line"), F.col("u.b").alias("last_line"), "paragraph", "gram").distinct()


def model_tables(docs: DataFrame) -> tuple[list[str], np.ndarray, DataFrame, DataFrame, list[int]]:
    """Classes, constants, (gram, w array<double>) and (gram, family, variant, size) as stored tables, and the grams."""
    spark = docs.sparkSession
    classes, features, w, b = train(background_lines(docs.select("text").where(F.col("text").isNotNull())))
    key = F.when(F.size("g") == 2, F.xxhash64(F.get("g", F.lit(0)), F.get("g", F.lit(1)))).otherwise(
        F.xxhash64(*[F.get("g", F.lit(k)) for k in range(3)])).alias("gram")
    rows = [{"g": list(g), "w": [round(float(v), 6) for v in w[i]]} for i, g in enumerate(features)]
    schema = T.StructType().add("g", T.ArrayType(T.StringType())).add("w", T.ArrayType(T.DoubleType()))
    weights = materialise(literal_table(spark, rows, schema).select(key, "w"), "licence_weights")
    parts, variant = [], 0
    for family, texts in TEMPLATES.items():
        for t in texts:
            own = sorted(grams(tokens(t)))
            parts += [{"g": list(g), "family": family, "variant": variant, "size": len(own)} for g in own]
            variant += 1
    schema = T.StructType().add("g", T.ArrayType(T.StringType())).add("family", "string").add("variant", "integer").add("size", "integer")
    texts = materialise(literal_table(spark, parts, schema).select(key, "family", "variant", "size"), "licence_texts")
    return classes, b, weights, texts, [r.gram for r in weights.select("gram").collect()]


def classified(hits: DataFrame, classes: list[str], constants: np.ndarray) -> DataFrame:
    """(PLACE, paragraph, family, probability, grams) of lines and paragraphs that are not unknown."""
    # no larger than the table of weights
    per = hits.groupBy(*PLACE, "paragraph").agg(F.collect_list(F.struct("gram", "w")).alias("found"))

    def logit(i: int) -> Column:
        return F.aggregate("found", F.lit(float(constants[i])), lambda acc, x: acc + F.get(x["w"], F.lit(i)))

    per = per.select(*PLACE, "paragraph", F.transform("found", lambda x: x["gram"]).alias("grams"), F.array(*[logit(i) for i in range(len(classes))]).alias("z"))
    per = per.withColumn("best", F.array_max("z"))
    per = per.withColumn("probability", 1 / F.aggregate("z", F.lit(0.0), lambda acc, z: acc + F.exp(z - F.col("best"))))
    per = per.withColumn("family", F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("z", F.col("best")).cast("int")))
    return per.where((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY)).select(*PLACE, "paragraph", "family", "probability", "grams")


def reported(found: DataFrame) -> DataFrame:
    """Of lines and paragraphs with (coverage, confirmed): one account of each paragraph."""
    same = ["doc_id", "text_hash", "paragraph"]
    lines = found.withColumn("single", F.col("first_line") == F.col("last_line"))
    sure = lines.where("single AND confirmed").groupBy(*same).agg(F.collect_set("family").alias("families"))
    whole = found.groupBy(*same).agg(F.max(F.col("last_line") - F.col("first_line")).alias("length"))
    joined = join_same(join_same(lines, sure, same), whole, same)
    known = F.col("families").isNotNull()
    alone = F.col("single") & (F.col("length") > 0)  # a line of a longer paragraph that was classified too
    keep = F.when(F.col("single") & F.col("confirmed"), F.lit(True)).when(alone, known).otherwise(~known | (F.col("confirmed") & ~F.array_contains("families", F.col("family"))))
    return joined.where(F.coalesce(keep, F.lit(True))).drop("families", "length", "single")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, probability, confirmed, licenses) of every document.

    ``licenses`` lists (para_no, last_line, family, probability, coverage, confirmed) of each
    licence paragraph or line, ``para_no`` being its first line; ``license`` is the most probable confirmed family or null.
    """
    classes, constants, weights, texts, known = model_tables(docs)
    hits = materialise(known_grams(docs, known), "licence_hits")
    found = materialise(classified(with_paragraphs(hits).join(weights, "gram"), classes, constants), "licence_found")
    compared = found.select(*PLACE, F.col("family").alias("predicted"), F.explode("grams").alias("gram")).join(texts, "gram").where("family = predicted")
    cover = compared.groupBy(*PLACE, "variant").agg((F.count("*") / F.first("size")).alias("c")).groupBy(*PLACE).agg(F.max("c").alias("coverage"))
    joined = join_same(found.drop("grams"), cover, PLACE)
    joined = joined.withColumn("coverage", F.round(F.coalesce("coverage", F.lit(0.0)), 6)).withColumn("confirmed", F.col("coverage") >= LEAST_COVERAGE)
    entry = F.struct(F.col("first_line").alias("para_no"), "last_line", "family", F.round("probability", 6).alias("probability"), "coverage", "confirmed")
    per = reported(joined).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(entry)).alias("licenses"),
        F.max(F.when(F.col("confirmed"), F.struct(F.round("probability", 6).alias("p"), F.col("family").alias("f")))).alias("top"))
    out = join_same(docs.select("doc_id", F.xxhash64("text").alias("text_hash")), per, ["doc_id", "text_hash"])
    return out.select("doc_id", F.col("top.f").alias("license"), F.col("top.p").alias("probability"), F.col("top").isNotNull().alias("confirmed"),
                      F.coalesce("licenses", F.array().cast(per.schema["licenses"].dataType)).alias("licenses"))
