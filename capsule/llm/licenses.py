"""Licence scans: sparse TF-IDF cosine of lines to licence templates, and inheritance along directories.

Every line of every text, and every run of as many words as a template has, is a candidate header. It is compared with
templates as a vector of words, weighted by inverse document frequency over all texts. A text takes part if it has a telling
word: without one of these, the cosine cannot reach the limit (`needed`), so nothing is lost. A text that is a whole licence, by the cosine of all its words, or
little else than headers is a licence file and licenses its directory. A text without a header of its own takes the licence of the nearest directory above it that has
one, found by joining the directories on its path with the licensed ones.

Everything is built-in functions. Only words of the templates are counted and joined, so what shuffles is narrow; the
table of templates has a fixed size and is broadcast.

Defined cases. Null or empty text: no header; it inherits. Null path: no directory, so nothing is inherited. Several
headers: the highest cosine, then the first line; several licence files in one directory: the highest cosine, then the
smallest path. Repeated rows: each gives a row. Empty table: empty result. Columns of the input stay; input columns named
like an added one are replaced.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsule.llm.common import small, table
from capsule.sources.staging import stage

#: The notice of the GNU licences, which only the version tells apart.
NOTICE = ("This {} is free software: you can redistribute it and/or modify it under the terms of the {} Public License as published "
          "by the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
#: Short forms of licence headers, by SPDX identifier; the long ones begin alike.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "Apache-1.1": ("Licensed under the Apache License, Version 1.1.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", NOTICE.format("program", "GNU General", 3)),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", NOTICE.format("program", "GNU General", 2)),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", NOTICE.format("library", "GNU Lesser General", 3)),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", NOTICE.format("library", "GNU Lesser General", 2.1)),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", NOTICE.format("program", "GNU Affero General", 3)),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted",
                     "Use of this source code is governed by a BSD-style license"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.",),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.",),
    "CC-BY-3.0": ("Licensed under CC BY 3.0.",),
    "CC-BY-SA-3.0": ("Licensed under CC BY-SA 3.0.",),
    "proprietary": ("All rights reserved.",),
}
#: Whole licences, by SPDX identifier. Other licences (CC-BY, AGPL) are known by their headers only.
WHOLE = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0",
         "CC0-1.0", "Artistic-1.0-Perl")
#: Cosine from which a whole text is a whole licence.
SAME = 0.8
#: Cosine from which a line is a header, and share of a text's words from which it is a licence file.
SIMILAR, MOSTLY = 0.7, 0.5
#: Words of a template that may be telling: no fixed number, the bound of the cosine decides (`needed`).
TELLING = None
#: By how much bounds are wider than they are, for rounding.
CLOSE = 1e-8

TOKEN = r"[a-z0-9][a-z0-9.-]*[a-z0-9]|[a-z0-9]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def template_words(spark: SparkSession, templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Rows (template, license, word, tf)."""
    rows = [(f"{name}/{i}", name, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    t = spark.createDataFrame(rows, "template string, license string, text string")
    return t.select("template", "license", F.explode(tokens(F.col("text"))).alias("word")).groupBy("template", "license", "word") \
        .agg(F.count("*").alias("tf"))


def whole_licenses() -> dict[str, Counter]:
    """Words of the whole licences, counted."""
    return {name: Counter(re.findall(TOKEN, pkgutil.get_data("capsule.llm", f"license_texts/{name}.txt").decode().lower())) for name in WHOLE}


def word_weights(docs: DataFrame, words: list[str]) -> DataFrame:
    """Rows (word, idf) for some words: log((1 + documents) / (1 + documents that have it)) + 1, over all texts."""
    vocabulary = F.array(*[F.lit(w) for w in words])
    held = docs.select(F.explode(F.array_intersect(tokens(F.coalesce("text", F.lit(""))), vocabulary)).alias("word"))
    total = docs.count()
    every = docs.sparkSession.createDataFrame([(w,) for w in words], "word string")
    return (every.join(held.groupBy("word").agg(F.count("*").alias("df")), "word", "left")
            .select("word", (F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")))


def needed(vector: Mapping[str, float], idf: Mapping[str, float], least: float) -> set[str]:
    """Words of a template without which no words reach a cosine of `least`: what is left of the template's length bounds
    the cosine. Of the many such sets, one of words that few texts hold."""
    left, limit, out = sum(x * x for x in vector.values()), (least - CLOSE) ** 2 * sum(x * x for x in vector.values()), set()
    for w in sorted(vector, key=lambda w: (math.exp(-idf[w]) / vector[w] ** 2, w)):
        if left < limit:
            break
        left -= vector[w] ** 2
        out.add(w)
    return out


def holds(text: Column, some: set[str]) -> Column:
    """Whether a text may have one of some words."""
    cue = r"(?<![a-z0-9])(" + "|".join(re.escape(w) for w in sorted(some)) + r")(?![a-z0-9])"
    return F.lower(text).rlike(cue)


def squared(words: Column) -> Column:
    """Square of the length of (word, idf) rows as a vector: counts, weighted."""
    return F.aggregate(F.array_distinct(words), F.lit(0.0), lambda a, w: a + F.pow(
        F.size(F.filter(words, lambda x: x["word"] == w["word"])) * w["idf"], F.lit(2)))


def spans(placed: DataFrame, lengths: list[int], licenses: list[str], similar: float) -> DataFrame:
    """Rows (_key, line, pos, n, cosine, license): windows as long as a template, and whole lines, that are headers.
    `placed` has the words of texts (_key, line, pos, word, idf, telling, x), x the parts of the templates' cosines."""
    longest = max(lengths)
    along = Window.partitionBy("_key").orderBy("pos")
    near = (placed.withColumn("near", F.max("telling").over(along.rowsBetween(1 - longest, longest - 1))).where("near").drop("near"))
    dots = {f"d{i}": F.sum(F.get("x", F.lit(i))).over(along.rangeBetween(0, n - 1)) for i, n in enumerate(lengths)}
    # equal words of a window are squared apart, which bounds its length from below
    squares = {f"q{n}": F.sum(F.pow("idf", F.lit(2))).over(along.rangeBetween(0, n - 1)) for n in sorted(set(lengths))}
    ahead = F.collect_list(F.struct("word", "idf")).over(along.rangeBetween(0, longest - 1))
    fits = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.coalesce(f"d{i}", F.lit(0.0)).alias("dot"), F.col(f"q{n}").alias("q"),
                                       F.lit(name).alias("license")) for i, (n, name) in enumerate(zip(lengths, licenses))]),
                    lambda f: f["dot"] >= (similar - CLOSE) * F.sqrt(f["q"]))
    windows = (near.select("_key", "line", "pos", ahead.alias("words"), *[c.alias(n) for n, c in (dots | squares).items()])
               .select("_key", "line", "pos", "words", F.explode(fits).alias("f"))
               .select("_key", "line", "pos", F.slice("words", 1, F.col("f.n")).alias("words"), "f.dot", "f.license"))
    of_line = Window.partitionBy("_key", "line")
    told = placed.withColumn("told", F.max("telling").over(of_line)).where("told")
    lines = (told.groupBy("_key", "line").agg(F.min("pos").alias("pos"), F.count("*").alias("n"), F.array(*[
        F.struct(F.coalesce(F.sum(F.get("x", F.lit(i))), F.lit(0.0)).alias("dot"), F.lit(name).alias("license")) for i, name in enumerate(licenses)]).alias("f"))
        .withColumn("f", F.array_max("f")))
    counts = told.groupBy("_key", "line", "word").agg((F.count("*") * F.first("idf")).alias("v"))
    lines = (lines.join(counts.groupBy("_key", "line").agg(F.sum(F.pow("v", F.lit(2))).alias("q")), ["_key", "line"])
             .select("_key", "line", "pos", "n", "q", "f.dot", "f.license"))
    windows = windows.select("_key", "line", "pos", F.size("words").cast("long").alias("n"), squared(F.col("words")).alias("q"), "dot", "license")
    return (windows.unionByName(lines).withColumn("cosine", F.round(F.least(F.lit(1.0), F.col("dot") / F.sqrt("q")), 9))
            .where(F.col("cosine") >= similar).select("_key", "line", "pos", "n", "cosine", "license"))


def wholes(counts: DataFrame, names: list[str], same: float) -> DataFrame:
    """Rows (_key, cosine, license) of texts that are a whole licence. `counts` has the words of texts (_key, word, tf,
    weight, y), y the parts of the licences' cosines."""
    sums = counts.groupBy("_key").agg(F.sum(F.pow(F.col("tf") * F.col("weight"), F.lit(2))).alias("q"), F.array(*[F.struct(
        F.coalesce(F.sum(F.col("tf") * F.get("y", F.lit(i))), F.lit(0.0)).alias("dot"), F.lit(name).alias("license"))
        for i, name in enumerate(names)]).alias("f")).withColumn("f", F.array_max("f"))
    cosine = F.round(F.least(F.lit(1.0), F.col("f.dot") / F.sqrt("q")), 9)
    return sums.select("_key", cosine.alias("cosine"), "f.license").where(F.col("cosine") >= same)


def headers(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, similar: float = SIMILAR) -> DataFrame:
    """`docs` (text and any others, text left out) with `header`: (cosine, line, license, share) of the whole licence that the
    text is, or else of its best header, or null; `share` is the part of the text's words that stand in headers, 1 for a
    whole licence."""
    spark = docs.sparkSession
    bag = template_words(spark, templates).collect()  # fixed size: the templates' words
    bodies = whole_licenses()
    weights = stage(word_weights(docs, sorted({r.word for r in bag}.union(*bodies.values()))), "idf").collect()
    every = {r.word: r.idf for r in weights}
    idf = {r.word: every[r.word] for r in bag}
    unseen = float(max(every.values(), default=1.0))  # words of no template weigh as the rarest
    by_template: dict[tuple[str, str], dict[str, float]] = {}
    sizes: Counter = Counter()
    for r in bag:
        by_template.setdefault((r.template, r.license), {})[r.word] = r.tf * idf[r.word]
        sizes[r.template, r.license] += r.tf
    order = sorted(by_template)
    telling = set().union(*[needed(v, idf, similar) for v in by_template.values()])
    length = {k: sum(x * x for x in v.values()) ** 0.5 for k, v in by_template.items()}
    body = {name: {w: n * every[w] for w, n in words.items()} for name, words in bodies.items()}
    body_length = {name: sum(x * x for x in v.values()) ** 0.5 for name, v in body.items()}
    parts = [(w, idf.get(w), every[w], w in telling, [by_template[k].get(w, 0.0) * every[w] / length[k] for k in order] if w in idf else None,
              [body[name].get(w, 0.0) * every[w] / body_length[name] for name in WHOLE]) for w in sorted(every)]
    known = spark.createDataFrame(parts, "word string, idf double, weight double, telling boolean, x array<double>, y array<double>")

    asked = holds(F.col("text"), telling.union(*[needed(v, every, SAME) for v in body.values()]))
    read = stage(docs.drop("header").withColumns({"_key": F.when(asked, F.md5("text")), "text": F.when(asked, F.col("text"))}), "asked")
    texts = read.where("_key is not null").groupBy("_key").agg(F.first("text").alias("text"))
    placed = F.flatten(F.transform(F.split("text", "\n", -1), lambda x, i: F.transform(
        tokens(x), lambda w: F.struct(i.alias("line"), w.alias("word")))))
    placed = stage(texts.select("_key", F.posexplode(placed).alias("pos", "w")).select("_key", "pos", "w.line", "w.word"), "words")
    counts = placed.groupBy("_key", "word").agg(F.count("*").alias("tf")).join(F.broadcast(known.select("word", "weight", "y")), "word", "left")
    whole = wholes(counts.withColumn("weight", F.coalesce("weight", F.lit(unseen))), list(WHOLE), SAME)
    weighed = placed.join(F.broadcast(known.select("word", "idf", "telling", "x")), "word", "left").withColumns({
        "idf": F.coalesce("idf", F.lit(unseen)), "telling": F.coalesce("telling", F.lit(False))})
    hits = stage(spans(weighed, [sizes[k] for k in order], [name for _, name in order], similar), "hits")
    spent = hits.select("_key", F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("pos")).distinct().groupBy("_key").agg(F.count("*").alias("spent"))
    best = hits.groupBy("_key").agg(F.max(F.struct("cosine", (-F.col("line")).alias("line"), "license")).alias("top"))
    found = (best.join(spent, "_key").join(placed.groupBy("_key").agg(F.count("*").alias("words")), "_key")
             .select("_key", F.struct("top.cosine", (-F.col("top.line")).alias("line"), "top.license",
                                      (F.col("spent") / F.col("words")).alias("share")).alias("part")))
    whole = whole.select("_key", F.struct("cosine", F.lit(0).alias("line"), "license", F.lit(1.0).alias("share")).alias("all"))
    found = found.join(whole, "_key", "full").select("_key", F.coalesce("all", "part").alias("header"))
    found = small(stage(found, "found"))
    read = read.drop("text")
    none = read.where("_key is null").withColumn("header", F.lit(None).cast(found.schema["header"].dataType))
    return read.where("_key is not null").join(found, "_key", "left").unionByName(none).drop("_key")


def directories(path: Column) -> Column:
    """All directories above a path, as (depth, directory)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda d: F.struct(
        d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("directory")))


def licenses(files: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, similar: float = SIMILAR,
             mostly: float = MOSTLY) -> DataFrame:
    """`files` (path, text and any others, text left out) with license, cosine, origin (header, inherited or null) and
    directory, the one inherited from."""
    added = ("header", "license", "cosine", "origin", "directory")
    own = stage(headers(files.drop(*added), templates, similar), "headers")
    file_of = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", ""))
    licensed = (own.where(F.col("header.share") >= mostly).select(file_of.alias("_dir"), "header", "path").where("_dir is not null")
                .groupBy("_dir").agg(F.min(F.struct((-F.col("header.cosine")).alias("c"), "path", "header")).alias("m"))
                .select("_dir", F.col("m.header.license").alias("_license"), F.col("m.header.cosine").alias("_cosine")))
    licensed = small(stage(licensed, "licensed-directories"))
    asked = own.where("header is null and path like '%/%'").select("path").distinct()
    above = (asked.select("path", F.explode(directories(F.col("path"))).alias("d")).join(licensed, F.col("d.directory") == F.col("_dir"))
             .groupBy(F.col("path").alias("_path")).agg(F.max(F.struct("d.depth", "_dir", "_license", "_cosine")).alias("near")))
    return (own.join(above, F.col("header").isNull() & (F.col("path") == F.col("_path")), "left")
            .withColumns({"license": F.coalesce("header.license", "near._license"), "cosine": F.coalesce("header.cosine", "near._cosine"),
                          "origin": F.when(F.col("header").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited"),
                          "directory": F.col("near._dir")}).drop("header", "near", "_path"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, taken as a file at source/lang/group of 32 ids/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")),
                       F.floor(F.col("doc_id") / 32).cast("string"), F.col("doc_id").cast("string"))
    return licenses(docs.select("doc_id", path.alias("path"), "text")).select("doc_id", "path", "license", "cosine", "origin", "directory")
