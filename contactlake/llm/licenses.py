"""License scans: TF-IDF cosine of lines, header blocks, word windows and whole files to templates, then inheritance down directories. DataFrames only."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, stored

#: Short public notices, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.array_remove(F.split(lower_ascii(text), "[^a-z0-9]+"), "")


@dataclass(frozen=True)
class Template:
    """words: each with its share of the template's vector, whose length is one. size: its words, repeats counted."""

    license: str
    words: dict[str, float]
    size: int

    def leads(self, threshold: float) -> list[str]:
        """The heaviest words, so many that the others can't reach threshold: a match holds one of them."""
        out, rest = [], sum(x * x for x in self.words.values())
        for w, x in sorted(self.words.items(), key=lambda e: (-e[1], e[0])):
            if rest < threshold**2 - SLACK:
                break
            out.append(w)
            rest -= x * x
        return out


#: For rounding, when bounds are compared.
SLACK = 1e-5


def _words(templates) -> list[tuple[str, Counter]]:
    return [(lic, c) for lic, text in templates if (c := Counter(re.findall("[a-z0-9]+", text.lower())))]


def _weights(rows: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """idf of the templates' words, and of a word that no row has: ln((1 + N) / (1 + rows with the word)) + 1."""
    held = F.array_intersect(tokens(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)))
    n = rows.count()
    df = {r[0]: r[1] for r in rows.select(F.explode(held).alias("word")).groupBy("word").count().collect()}  # as many as the templates have words
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}, math.log(1 + n) + 1


def _sum_of(words: Column, values: dict[str, float], other: float = 0.0) -> Column:
    """The sum of the words' values."""
    known = F.create_map(*[F.lit(x) for e in values.items() for x in e])
    return F.aggregate(words, F.lit(0.0), lambda a, x: a + F.coalesce(F.element_at(known, x), F.lit(other)))


def _reaches(held: Column, t: Template, threshold: float) -> Column:
    """Whether words that hold no more of the template than `held` can reach threshold: by Cauchy and Schwarz the cosine is at most the root of the sum."""
    return _sum_of(held, {w: x * x for w, x in t.words.items()}) >= threshold**2 - SLACK


def _norm(words: Column, idf: dict[str, float], unseen: float) -> Column:
    """Length of the words' TF-IDF vector; each repeat of a word in sorted order adds what its count grows the square by."""
    squares = F.create_map(*[F.lit(x) for w, i in idf.items() for x in (w, i * i)])

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["word"] == x, a["run"] + 1).otherwise(0.0)
        return F.struct(x.alias("word"), run.alias("run"), (a["sum"] + (2 * run + 1) * F.coalesce(F.element_at(squares, x), F.lit(unseen * unseen))).alias("sum"))

    zero = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    return F.sqrt(F.aggregate(F.array_sort(words), zero, step, lambda a: a["sum"]))


def _windows(words: Column, held: Column, t: Template, threshold: float) -> Column:
    """The windows of words, as long as the template, that hold one of its leading words."""
    last = F.size(words) - t.size
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(t.leads(threshold)))
    starts = F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(F.greatest(F.lit(0), F.least(i - (t.size - 1), last)), F.least(i, last)))))
    cut = F.transform(starts, lambda i: F.slice(words, i + 1, t.size))
    return F.when((last >= 0) & _reaches(held, t, threshold), cut).otherwise(F.array().cast("array<array<string>>"))


def best_matches(noted: DataFrame, made: list[Template], idf: dict[str, float], unseen: float, threshold: float) -> DataFrame:
    """(rid, license, cosine, n_line) of the best match of each row of noted (rid, text) with one at or over threshold.

    A line, a block of lines up to a blank one, the whole text and every window of a template's length are compared.
    A word of no template counts as one no row has, so it weighs against a match at full. Ties go to the licence's
    name, then the template. n_line: the words of the longest match with that licence.
    """
    vocabulary = F.array(*map(F.lit, idf))
    apart = lambda mark: F.transform(F.split("text", mark), tokens)

    def near(w: Column) -> Column:
        held = F.array_intersect(w, vocabulary)
        return F.concat(F.array(w), *[_windows(w, held, t, threshold) for t in made])

    # parts that repeat are judged again: telling arrays of words apart costs the square of their number
    parts = F.concat(apart("\n"), apart(r"\n[\x20\t\r]*\n"), let(tokens(F.col("text")), near))
    parts = noted.select("rid", F.explode(parts).alias("w"))

    def judged(w: Column) -> Column:
        def of(norm: Column) -> Column:
            # a word's share of the dot product comes once with each of its places
            cosines = [F.struct((-F.round(_sum_of(w, {x: y * idf[x] for x, y in t.words.items()}) / norm, 6)).alias("c"), F.lit(t.license).alias("license"), F.lit(i).alias("template")) for i, t in enumerate(made)]
            return F.filter(F.array(*cosines), lambda x: x["c"] <= -threshold)

        held = F.array_intersect(w, vocabulary)
        able = let(held, lambda h: F.array(*[_reaches(h, t, threshold) for t in made]))
        return F.when(F.array_contains(able, True), let(_norm(w, idf, unseen), of))

    found = parts.select("rid", F.size("w").alias("n"), F.explode(let(F.col("w"), judged)).alias("m"))
    of_licence = found.groupBy("rid", "m.license").agg(F.min("m").alias("m"), F.max("n").alias("n"))
    best = of_licence.groupBy("rid").agg(F.min(F.struct("m", "n")).alias("b"))
    return best.select("rid", F.col("b.m.license").alias("license"), (-F.col("b.m.c")).alias("cosine"), F.col("b.n").alias("n_line"))


def scan_licenses(files: DataFrame, templates=TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", file_percent: int = 20) -> DataFrame:
    """(doc_id, path, license, cosine, origin, from_dir) for every row of files.

    Every line, every block of lines, every window of a template's length and the whole text are compared with every
    template; the best at or over threshold is the row's own licence (origin `header`; `file` if a match with it holds
    file_percent of the text's words or more, which makes the row its directory's licence file). Only texts whose
    words can't reach threshold with any template are passed over, by an exact bound. A row without one takes the licence of the nearest directory above it that has a
    licence file (origin `inherited`, from_dir names it); of several files in a directory the closest counts, then
    the first by path. Else license is null and origin `none`.

    Null texts have no lines; a null path is in no directory and inherits nothing. Every row gets its own result,
    repeated rows included. Other columns are ignored. An empty table gives an empty result.
    """
    rows = files.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    counted = _words(templates) or [("", Counter([""]))]  # no text has such a word
    vocabulary = sorted({w for _, c in counted for w in c})
    # texts are read once for the words' weights and once for the notices; what goes on is small
    idf, unseen = _weights(rows, vocabulary)
    made = []
    for lic, c in counted:
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        made.append(Template(lic, {w: n * idf[w] / norm for w, n in c.items()}, sum(c.values())))

    def noted_of(w: Column) -> Column:
        able = let(F.array_intersect(w, F.array(*map(F.lit, vocabulary))), lambda h: F.array_contains(F.array(*[_reaches(h, t, threshold) for t in made]), True))
        return F.struct(F.size(w).alias("n"), able.alias("able"))

    noted = rows.withColumn("_x", let(tokens(F.coalesce("text", F.lit(""))), noted_of))
    noted = stored(noted.select("rid", "doc_id", "path", F.col("_x.n").alias("n_words"), F.when(F.col("_x.able"), F.col("text")).alias("text")), "notices")
    matches = best_matches(noted.where("text is not null").select("rid", "text"), made, idf, unseen, threshold)
    own = noted.select("rid", "doc_id", "path", "n_words").join(matches, "rid", "left")
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), F.lit(""))
    own = own.withColumn("dir", folder).withColumn("is_file", F.col("license").isNotNull() & (100 * F.col("n_line") >= file_percent * F.col("n_words")))
    of_dir = own.where("is_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("b")).select(F.col("dir").alias("at"), F.col("b.license").alias("lic"))
    # every directory is joined once with those above it, then rows with their directory: a row meets one answer
    dirs = own.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.withColumn("k", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("at", F.array_join(F.slice(parts, 1, F.col("k")), "/"))
    nearest = above.join(of_dir, "at").groupBy("dir").agg(F.max(F.struct("k", "at", "lic")).alias("b")).select(F.col("dir").alias("d"), F.col("b.at").alias("at"), F.col("b.lic").alias("lic"))
    out = own.join(nearest, F.col("dir") == F.col("d"), "left")
    origin = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("lic").isNotNull(), "inherited").otherwise("none")
    inherited = origin == "inherited"
    return out.select("doc_id", "path", F.coalesce("license", "lic").alias("license"), "cosine", origin.alias("origin"), F.when(inherited, F.col("at")).alias("from_dir"))
