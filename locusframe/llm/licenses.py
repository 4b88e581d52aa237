"""Licence scans: Dice coefficient over word bigrams; DataFrame functions only.

A unit is a whole text, or one of its lines. Units and templates are
normalised alike (lower case, white space and punctuation to single spaces),
cut into words, and compared by the sets of their word bigrams:
dice = 2 * common / (bigrams of unit + bigrams of template).

Size bounds prune first: a dice of t needs a unit of between t / (2 - t) and
(2 - t) / t times the template's bigrams, so only units within the bounds of
some template are cut into bigrams at all, and a bigram meets only templates
whose bounds hold for its unit. Before any text is cut, units without one of the
words that every match must hold are passed over. A unit and a template without
a common bigram never meet. Templates are a fixed list of known size, so they are broadcast.

A document without a matching unit is searched for the best window of
consecutive words, across lines and inside them, against the templates and the
texts of licence_texts. A window starts where a run of pairs shared with the
template starts, as a shared pair more to the left never lowers the dice, and
ends at a shared pair. Only documents that hold enough of a template's pairs
within a window's reach are measured.

Null or blank text, and units with one word, match nothing. One row comes out
for each row in; rows that repeat an id, or have none, are scanned each by itself.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .licence_texts import BODIES, OPENINGS
from .shared import numbered, stash

THRESHOLD = 0.9
# Licence notices and short licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
)
# Fixed pattern of what parts words after lower case.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), PARTS), "")


def pairs(w: Column) -> Column:
    """Pairs of neighbouring words."""
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def bigrams(w: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(pairs(w))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, licence, n_template, gram)."""
    t = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, licence string, text string")
    t = t.withColumn("grams", bigrams(words(F.col("text"))))
    return t.select("template", "licence", F.size("grams").alias("n_template"), F.explode("grams").alias("gram"))


def telling_words(templates, threshold: float) -> list[str]:
    """Words of which a unit holds one at least if it matches any template.

    A match holds t / (2 - t) of a template's bigrams, so of a few more than
    the rest of them one must be there, and with it its words. For each
    template, long words are chosen until they touch so many bigrams.
    """
    import re

    out: set[str] = set()
    for _, text in templates:
        w = [x for x in re.split(PARTS, text.lower()) if x]
        grams = set(zip(w, w[1:], strict=False))
        want = int(len(grams) * (1 - threshold / (2 - threshold)) + 1e-9) + 1
        touched: set[tuple[str, str]] = set()
        for word in sorted(set(w), key=lambda x: (x not in out, -min(len(x), 8), -sum(x in g for g in grams), x)):
            if len(touched) >= want:
                break
            touched |= {g for g in grams if word in g}
            out.add(word)
    return sorted(out)


def holds_any(found: list[str]):
    """Whether a text contains one of the words; a word that holds another one is not looked for.

    The text in lower case is a lambda's variable, so that it is made once, not once a word.
    """
    short = [w for w in found if not any(v != w and v in w for v in found)]
    return lambda c: F.exists(F.array(F.lower(c)), lambda t: functools.reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in short]))


def best_windows(docs: DataFrame, threshold: float, templates) -> DataFrame:
    """key, n_units, best (dice, minus_line, minus_template, licence): the best window of each document's words.

    docs: (key, text), those that hold a telling word. n_units counts the lines in which templates' best windows start; a line counts from 1.
    """
    spark = docs.sparkSession
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    t = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, licence string, body string").withColumn("all", pairs(words(F.col("body"))))
    t = t.withColumn("grams", F.array_distinct("all")).withColumn("n_template", F.size("grams"))
    # A window holds (dice * template) / (2 - dice) of the template's pairs at least; twice its bound of distinct pairs leaves room for repeats.
    need, reach = F.ceil(low * F.col("n_template") - 1e-9).cast("int"), F.floor(2 * high * F.size("all")).cast("int")
    t = t.select("template", "licence", "n_template", need.alias("need"), reach.alias("reach"), F.explode("grams").alias("gram"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    at = lambda d: d.select("key", "h", F.posexplode(pairs(words(F.col("text")))).alias("pos", "gram"))
    by = ["key", "h", "template", "licence", "n_template", "need", "reach"]
    hits = at(docs).join(F.broadcast(t), "gram").groupBy(*by).agg(F.sort_array(F.collect_set("pos")).alias("hits"), F.countDistinct("gram").alias("n_common"))
    hits = hits.where(F.col("n_common") >= F.col("need"))
    hit, n = F.col("hits"), F.size("hits")
    before = lambda a: F.when(a > 0, F.get(hit, a - 1) == F.get(hit, a) - 1).otherwise(F.lit(False))
    dense = lambda x, a: (F.get(hit, a + F.col("need") - 1) < x + F.col("reach")) & ~before(a)
    hits = hits.withColumn("starts", F.filter(hit, dense)).where(F.size("starts") > 0)
    some = docs.join(hits.select("key", "h").distinct(), ["key", "h"], "left_semi")
    # For each pair the place of its last copy: it is the first in a window that starts behind that.
    prev = F.coalesce(F.lag("pos").over(Window.partitionBy("key", "h", "gram").orderBy("pos")), F.lit(-1))
    prev = at(some).distinct().withColumn("prev", prev).groupBy("key", "h").agg(F.sort_array(F.collect_list(F.struct("pos", "prev")))["prev"].alias("prev"))
    sizes = some.select("key", "h", F.transform(F.split("text", "\n"), lambda x: F.size(words(x))).alias("sizes")).distinct()
    p = F.col("prev")

    def measured(s: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            c = acc["c"] + F.when(F.get(p, x) < s, 1).otherwise(0)
            d = acc["d"] + F.size(F.filter(F.slice(p, acc["last"] + 2, x - acc["last"]), lambda q: q < s))
            return F.struct(c.alias("c"), d.alias("d"), x.alias("last"), F.greatest(acc["dice"], 2 * c / (d + F.col("n_template"))).alias("dice"))

        zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("d"), (s - 1).alias("last"), F.lit(0.0).alias("dice"))
        return F.aggregate(F.filter(hit, lambda x: (x >= s) & (x < s + F.col("reach"))), zero, add, lambda acc: acc["dice"])

    def step(acc: Column, size: Column) -> Column:
        on = (acc["left"] >= size) & ~acc["done"]
        return F.struct(F.when(on, acc["left"] - size).otherwise(acc["left"]).alias("left"), F.when(on, acc["line"] + 1).otherwise(acc["line"]).alias("line"), (~on).alias("done"))

    got = hits.join(prev, ["key", "h"]).withColumn("top", F.array_max(F.transform("starts", lambda s: F.struct(measured(s).alias("dice"), (-s).alias("minus_start")))))
    got = got.where(F.col("top.dice") >= threshold).join(sizes, ["key", "h"])
    zero = F.struct((-F.col("top.minus_start")).alias("left"), F.lit(1).alias("line"), F.lit(False).alias("done"))
    got = got.withColumn("line", F.aggregate("sizes", zero, step, lambda acc: acc["line"]))
    best = F.struct(F.col("top.dice").alias("dice"), (-F.col("line")).alias("minus_line"), (-F.col("template")).alias("minus_template"), "licence")
    # A whole text goes before a sentence of it: pairs in common less those of one side only, for a window as large as its template.
    best = F.max_by(best, F.struct(F.col("n_template") * (3 * F.col("top.dice") - 2), best))
    return got.groupBy("key").agg(F.countDistinct("line").alias("n_units"), best.alias("best"))


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, texts=BODIES + OPENINGS) -> DataFrame:
    """doc_id, n_units (that match), licence, dice, line (0: the whole text, -1: no match), of the best match.

    Where no unit matches, of the best window of words over templates and texts, with the line in which it starts.
    """
    table = template_table(docs.sparkSession, templates)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [r[0] for r in table.select("n_template").distinct().collect()]  # of the fixed list
    docs, _ = numbered(docs.select("doc_id", "text"), "key")
    # One pass over all texts leaves those that may match anything; what follows reads these alone.
    some = docs.select("key", F.coalesce("text", F.lit("")).alias("text")).where(holds_any(telling_words((*templates, *texts), threshold))(F.col("text")))
    some, text = stash(some, "may_match"), F.col("text")
    lines = F.split(text, "\n")
    may = holds_any(telling_words(templates, threshold))
    unit = some.where(may(text)).select("key", F.posexplode(F.concat(F.array(text), F.when(F.size(lines) > 1, lines).otherwise(F.array().cast("array<string>")))).alias("line", "unit"))
    # A unit of n bigrams has more than n words, each with a letter at least and a gap: a bound without cutting words.
    longest = max(sizes) * high
    shortest = min(sizes) * low
    unit = unit.where((F.length("unit") >= 2 * shortest) & may(F.col("unit")))
    cut = unit.select("key", "line", words(F.col("unit")).alias("w")).where(F.size("w") - 1 >= shortest)
    cut = cut.select("key", "line", bigrams(F.col("w")).alias("g")).withColumn("n", F.size("g")).where((F.col("n") >= shortest) & (F.col("n") <= longest))
    gram = cut.select("key", "line", "n", F.explode("g").alias("gram"))
    near = (F.col("n") >= low * F.col("n_template")) & (F.col("n") <= high * F.col("n_template"))
    met = gram.join(F.broadcast(table), "gram").where(near)
    met = met.groupBy("key", "line", "template", "licence", "n", "n_template").agg(F.count(F.lit(1)).alias("common"))
    dice = (2 * F.col("common") / (F.col("n") + F.col("n_template"))).alias("dice")
    hit = met.select("key", "line", "template", "licence", dice).where(F.col("dice") >= threshold)
    best = F.max(F.struct("dice", (-F.col("line")).alias("minus_line"), (-F.col("template")).alias("minus_template"), "licence"))
    per = hit.groupBy("key").agg(F.countDistinct("line").alias("n_units"), best.alias("best"))
    windows = best_windows(some, threshold, (*templates, *texts))
    per = per.unionByName(windows.join(per.select("key"), "key", "left_anti"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "key").join(per, "key", "left")
    return out.select(
        "doc_id",
        F.coalesce("n_units", F.lit(0)).alias("n_units"),
        F.col("best.licence").alias("licence"),
        F.round("best.dice", 9).alias("dice"),
        F.coalesce(-F.col("best.minus_line"), F.lit(-1)).cast("long").alias("line"),
    )
