"""License scan with DataFrame functions only: a paragraph classifier, confirmed by comparison with templates.

Training paragraphs are built from names, phrases and notices of the license families and from ordinary
sentences about licences, law and institutions.  A multinomial logistic regression with an L1 penalty over word
1- and 2-grams gives a sparse table of weights.  A class "none" stands for everything else; its bias and the
temperature of all scores are calibrated on held-out paragraphs.  Lines are scored, and so are runs of
lines that are wrapped parts of one paragraph: all that hold a content word of some template.  Without one a paragraph has
only function words in common with every template, too few to be confirmed (`bare` says how few).
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of license families as notices write them.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache Software License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3 license"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2 license"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL license", "GNU LGPL v3"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL license", "GNU AGPL v3"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0 license"],
    "ISC": ["ISC License", "ISC licence"],
    "EPL": ["Eclipse Public License, version 1.0", "Eclipse Public License v2.0", "EPL license"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 4.0 license"],
    "CC-BY": ["Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY 4.0 license"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC 4.0 license"],
    "CC-BY-NC-SA": ["Creative Commons Attribution-NonCommercial-ShareAlike License", "CC BY-NC-SA 4.0", "CC BY-NC-SA 4.0 license"],
    "CC-BY-ND": ["Creative Commons Attribution-NoDerivatives License", "CC BY-ND 4.0", "CC BY-ND 4.0 license"],
    "CC0": ["Creative Commons Zero license", "CC0 1.0 Universal license", "CC0 public domain dedication license"],
    "Unlicense": ["Unlicense license", "Unlicense"],
}
PHRASES = (
    "Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This software is distributed under the terms of the {}.", "See the {} for more details.", "Available under the {}",
    "The source code is made available under the {}.", "You may obtain a copy of the {} at the project page.", "This program is free software; you can redistribute it under the terms of the {} as published.", "Dual licensed; choose the {}.",
)
NOTICES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    ],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"],
}
OTHERS = (
    "He lost his driver license on the way to the office.", "The pilot renewed her license last week.", "The fishing license is valid for one year.", "A license fee is due under the agreement.", "The dealer had no license to sell the car.",
    "The restaurant was licensed to serve wine.", "Copyright law was the subject of the lecture.", "All rights reserved by the publisher.", "Copyright 2019 by the authors, all rights reserved.", "The software is sold under a commercial license.",
    "Please read the license agreement before you install the program.", "License plate readers were installed on the road.", "The general public was invited to the opening.", "A public licence office opened in the town.", "The common law of the state applies.",
    "Researchers at MIT published a paper.", "The MIT campus was closed.", "The Apache helicopter landed on the base.", "The Apache people lived in the south.", "Version 2.0 of the program was released under pressure.", "Version 3 was released in the spring.",
    "The work was done under the terms of the contract.", "Mozilla opened a new office.", "The eclipse was public news.", "The creative team worked with the commons.", "The commons was open to the general public.", "You may obtain a copy of the report at the desk.",
    "The redistribution of income was debated.", "The warranty covers parts and labour under the license of the dealer.", "A software license server was restarted.", "The proprietary license forbids redistribution.", "This license is not transferable.", "The broadcaster lost its license.",
    "Under the new rules the license is free.", "Her marriage license was signed.", "Released under the old name.", "Licensed under the old rules by the state.", "This work is licensed under the following terms.", "This project is proprietary software under a closed license.", "The music license was bought for the film.",
    "Er kam mit dem Zug nach Hause.", "Sie sprach mit ihrer Mutter und mit dem Kind.", "Das Haus mit dem roten Dach steht am See.", "Mit der Zeit wurde es besser.", "Wir fahren mit und ohne Gepäck.", "Die Software wird mit einem Handbuch verkauft.",
    "Il est venu avec une page de notes.", "La fuente es pública y gratuita.", "Voir la page 2 pour plus de détails.", "The person in charge of the files is free on Monday.", "See page 3 for more details.", "Above all, use the following source with care.",
)
#: A line break within a paragraph: the line before it does not end a sentence, and the one after it is not empty.
WRAPPED = r"(?<![.!?:;\s])[\x20\t\r]*\n(?=[\x20\t]*\S)"


# English function words; every other word of a template is a content word.
FUNCTION = set("a an the of and or nor to in on at by for from with without under as if is are be was were been it its this that these those any all more most no not you your we our he she they their may can shall will would either".split())


def _trie(words: list[str]) -> str:
    """A pattern for any of the words that looks at each character once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    out = [re.escape(c) + _trie(rest) for c, rest in sorted(heads.items())]
    return "" if not out else "(?:" + "|".join(out) + ")" + ("?" if "" in words else "")


def content_pattern(templates: dict[str, list[list[str]]]) -> str:
    """A pattern that finds any content word of the templates, in either case."""
    content = sorted({w for ts in templates.values() for t in ts for g in t for w in g.split()} - FUNCTION)
    return "(?i)(?:^|[^a-z0-9])" + _trie(content) + "(?![a-z0-9])"


def bare(templates: dict[str, list[list[str]]]) -> float:
    """The greatest share of a template's grams that are made of function words alone."""
    return max(sum(set(g.split()) <= FUNCTION for g in t) / len(t) for ts in templates.values() for t in ts)


def words(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), r"[^a-z0-9.+-]+"), lambda w: F.btrim(w, F.lit(".+-"))), lambda w: w != "")


def once(c: Column) -> Column:
    """A column that is computed once a row: the optimizer copies no expression into filters and columns above a generator."""
    return F.explode(F.array(c))


def pairs(w: Column) -> Column:
    """Pairs of neighbours."""
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def grams(w: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    return F.array_distinct(F.concat(w, pairs(w)))


def training_rows() -> list[tuple[str, str, bool]]:
    """(class, paragraph, held out)."""
    rows = [(f, p.format(n), (i + j) % 4 == 3) for f, names in NAMES.items() for i, n in enumerate(names) for j, p in enumerate(PHRASES)]
    rows += [(f, t, False) for f, ts in NOTICES.items() for t in ts]
    return rows + [("none", t, i % 4 == 3) for i, t in enumerate(OTHERS)]


def _table(spark: SparkSession, rows: list[tuple[str, str, bool]]) -> DataFrame:
    one = F.array(*[F.struct(F.lit(c).alias("family"), F.lit(t).alias("text"), F.lit(h).alias("held")) for c, t, h in rows])
    return spark.range(1).select(F.explode(one).alias("r")).select("r.*")


def train(spark: SparkSession, penalty: float = 0.0005) -> dict:
    """{families, weights: gram -> a weight for each family, bias, templates: family -> sets of grams}."""
    return json.loads(_trained(spark.sparkContext.applicationId, penalty, _Session(spark)))


class _Session:
    """Lets a session be left out of a cache key."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Session)


@lru_cache(maxsize=8)
def _trained(app: str, penalty: float, session: _Session) -> str:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    spark = session.spark
    families = [*NAMES, "none"]
    table = _table(spark, training_rows()).withColumn("grams", F.concat(F.array(F.lit("")), grams(words(F.col("text"))))).withColumn("label", (F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1).cast("double"))
    table = table.withColumn("weight", F.when(F.col("family") == "none", 4.0).otherwise(1.0)).coalesce(1)
    vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0).fit(table.filter("not held"))
    ready = vectors.transform(table).select("label", "features", "held", "weight").cache()
    model = LogisticRegression(family="multinomial", regParam=penalty, elasticNetParam=1.0, maxIter=40, weightCol="weight", standardization=False, fitIntercept=False).fit(ready.filter("not held"))
    held = model.transform(ready.filter("held")).select("label", F.col("rawPrediction")).collect()
    ready.unpersist()

    def loss(scale: float, shift: float) -> float:
        total = 0.0
        for r in held:
            z = [v * scale for v in r["rawPrediction"].toArray()]
            z[-1] += shift
            top = max(z)
            total += math.log(sum(math.exp(v - top) for v in z)) + top - z[int(r["label"])]
        return total

    scale, shift = min(((s, b) for s in (0.5, 1.0, 1.5, 2.0) for b in (0.0, 0.5, 1.0, 2.0)), key=lambda p: loss(*p))
    coef = model.coefficientMatrix.toArray() * scale
    weights = {g: coef[:, k].tolist() for k, g in enumerate(vectors.vocabulary) if not g or abs(coef[:, k]).max() > 1e-6}
    bias = weights.pop("")  # the gram of every paragraph: a bias that the penalty holds down
    bias[-1] += shift
    templates: dict[str, list[list[str]]] = {}
    texts = [(f, n, False) for f, names in NAMES.items() for n in names] + [(f, t, False) for f, ts in NOTICES.items() for t in ts]
    for r in _table(spark, texts).select("family", grams(words(F.col("text"))).alias("g")).collect():
        templates.setdefault(r["family"], []).append(r["g"])
    return json.dumps({"families": families, "weights": weights, "bias": bias, "templates": templates})


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, match: float = 0.6, model: dict | None = None) -> DataFrame:
    """(doc_id, unit, paragraph, family, probability, similarity, confirmed): a row for each paragraph taken for a notice.

    unit "line": paragraph is the line's number, from 0, in the whole text.  unit "run": two lines or more of which none
    but the last ends a sentence, as in a notice wrapped to a width; paragraph is its number, from 0, among all
    such runs and lone lines.  A unit is listed if the likeliest class is a family with a
    probability of `least` or more (units without a content word of a template are none); similarity is the greatest share of a template's word 1- and 2-grams of that
    family that it has, and confirmed tells whether that is `match` or more.  Null and empty texts give no rows; rows
    that repeat an id are scanned each; a null id stays null; an empty table gives none; other columns are ignored.
    """
    model = model or train(df.sparkSession)
    if bare(model["templates"]) >= match:
        raise ValueError("match must exceed what function words alone can reach")
    families, k = model["families"], len(model["families"])
    weights = F.from_json(F.lit(json.dumps(model["weights"])), "map<string,array<double>>")
    templates = F.from_json(F.lit(json.dumps(model["templates"])), "map<string,array<array<string>>>")
    bias = F.array(*map(F.lit, model["bias"]))
    in_template = {g for ts in model["templates"].values() for t in ts for g in t}
    seen = sorted({*model["weights"], *in_template})
    one, two = [g for g in seen if " " not in g], [g for g in seen if " " in g]

    pattern = content_pattern(model["templates"])
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.rlike("text", F.lit(pattern)))
    numbered = lambda unit, texts: F.transform(texts, lambda x, i: F.struct(F.lit(unit).alias("unit"), i.alias("paragraph"), x.alias("text")))
    runs = F.filter(numbered("run", F.split(F.regexp_replace("text", WRAPPED, "\u0001"), "\n")), lambda u: F.contains(u["text"], F.lit("\u0001")))
    units = docs.select("doc_id", F.explode(F.concat(numbered("line", F.split("text", "\n")), runs)).alias("u")).select("doc_id", "u.*").filter(F.rlike("text", F.lit(pattern)))
    rows = units.select("doc_id", "unit", "paragraph", once(words(F.col("text"))).alias("words"))
    known = F.concat(F.filter("words", lambda w: w.isin(one)), F.filter(pairs(F.col("words")), lambda g: g.isin(two)))
    rows = rows.select("doc_id", "unit", "paragraph", once(F.array_distinct(known)).alias("grams"))
    weighed = F.filter("grams", lambda g: g.isin(list(model["weights"])))
    total = F.aggregate(weighed, bias, lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b))
    rows = rows.select("*", once(total).alias("score")).withColumn("top", F.array_max("score"))
    rows = rows.withColumn("probability", 1 / F.aggregate("score", F.lit(0.0), lambda acc, s: acc + F.exp(s - F.col("top"))))
    rows = rows.withColumn("family", F.element_at(F.array(*map(F.lit, families)), F.array_position("score", F.col("top")).cast("int")))
    rows = rows.filter((F.col("family") != families[k - 1]) & (F.col("probability") >= least))
    share = F.transform(F.element_at(templates, F.col("family")), lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t))
    rows = rows.withColumn("similarity", F.array_max(share))
    return rows.select("doc_id", "unit", F.col("paragraph").cast("long").alias("paragraph"), "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= match).alias("confirmed"))
