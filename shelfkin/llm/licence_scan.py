"""Licence scans: TF-IDF cosine of lines, headers and licence files to templates, then inheritance by directory.

DataFrame expressions and joins only.  Units of a file are its lines, its header (what
comes before the first empty line) and, for a licence file, its whole text.  Vectors are
sparse: only words of the templates have a dimension of their own; every other word of a
unit counts as one that no other text has.  Document frequencies are counted over the
whole texts of all files.  A unit is scored if the squared weights of its words, each in
the template where it weighs most, reach the square of the least cosine: by Cauchy and
Schwarz no other unit can.  A file without a licence of its own takes that of the nearest
directory above it with a recognised licence file; directories, not files, are joined to
their ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfkin.session import materialize

LEAST_COSINE = 0.6
ROUNDING = 1e-6  # scores are rounded before they are compared
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
# Words too common to tell licences apart.
STOP_WORDS = "a an and any as at be by for from if in is it may not of on or that the this to under with you your".split()
# Customary notices of the licences; a licence may have several.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and modify it under the terms of the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD style license. Redistribution and use in source and binary forms are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright, CC0 1.0 Universal public domain dedication."),
]


def split_words(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z0-9]+")


def words_of(text: Column) -> Column:
    return F.filter(split_words(text), lambda w: ~w.isin("", *STOP_WORDS))


def _units(text: Column, name: Column) -> Column:
    """Texts to be compared: lines, header, and the whole of a licence file."""
    header = F.regexp_replace(F.substring_index(text, "\n\n", 1), "\n", " ")
    whole = F.when(name.rlike(LICENCE_FILE), F.array(F.regexp_replace(text, "\n", " "))).otherwise(F.array().cast("array<string>"))
    several = F.when(F.substring_index(text, "\n\n", 1).contains("\n"), F.array(header)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.split(text, "\n"), several, whole))


def _directory(path: Column) -> Column:
    """Everything before the last slash; a path without one lies in the root, the empty string."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def detect_licences(files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """(path, licence, score) of every file in which a unit is near enough to a template; the best one, ties by name.

    Null texts and null paths have no licence.  Rows with equal paths count as one file.
    """
    spark = files.sparkSession
    rows = files.select(F.col(f"`{path}`").alias("path"), F.col(f"`{text}`").alias("text")).where("path is not null and text is not null")
    # Bounded by the templates given: their words, and a row per template and word.
    notices = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(templates)], "template int, licence string, notice string")
    weights = notices.select("template", "licence", F.explode(words_of(F.col("notice"))).alias("word")).groupBy("template", "licence", "word").agg(F.count("*").alias("in_template"))
    vocabulary = sorted({r["word"] for r in weights.select("word").distinct().collect()})

    # How many files hold each template word: a row per word after the partial sums of a task.
    total = float(rows.agg(F.count_distinct("path")).first()[0])
    words = F.array_distinct(F.filter(split_words(F.col("text")), lambda w: w.isin(*vocabulary)))
    holding = rows.select("path", F.explode(words).alias("word")).distinct().groupBy("word").agg(F.count("*").alias("n"))
    rarest = F.log(F.lit(1.0 + total)) + 1
    idf = weights.select("word").distinct().join(holding, "word", "left").select("word", (F.log((1.0 + total) / (1 + F.coalesce("n", F.lit(0)))) + 1).alias("idf"))
    sided = weights.join(F.broadcast(materialize(idf, "licence-words")), "word")
    norms = sided.groupBy("template").agg(F.sqrt(F.sum((F.col("in_template") * F.col("idf")) ** 2)).alias("template_norm"))
    sided = sided.join(F.broadcast(norms), "template").select("template", "licence", "word", "idf", (F.col("in_template") * F.col("idf") / F.col("template_norm")).alias("weight"))
    sided = materialize(sided, "licence-weights")
    idf = sided.select("word", "idf").distinct()

    most = {r["word"]: r["most"] ** 2 for r in sided.groupBy("word").agg(F.max("weight").alias("most")).collect()}
    heaviest = F.create_map(*[x for word, square in sorted(most.items()) for x in (F.lit(word), F.lit(square))])
    units = rows.select("path", F.posexplode(_units(F.col("text"), F.element_at(F.split("path", "/"), -1))).alias("unit", "line"))
    split = units.select("path", "unit", split_words(F.col("line")).alias("split"))
    split = split.withColumn("found", F.array_distinct(F.filter("split", lambda w: w.isin(*vocabulary)))).where(F.size("found") > 0)
    reach = F.aggregate("found", F.lit(0.0), lambda sum_, w: sum_ + F.element_at(heaviest, w))
    near = split.where(reach >= max(0.0, least - ROUNDING) ** 2)
    counted = materialize(near.select("path", "unit", "found", F.filter("split", lambda w: ~w.isin("", *STOP_WORDS)).alias("words")), "licence-units")

    own = counted.select("path", "unit", "words", F.explode("found").alias("word"))
    times = own.select("path", "unit", "word", F.size("words").alias("all"), F.size(F.filter("words", lambda w: w == F.col("word"))).alias("times"))
    valued = times.join(F.broadcast(idf), "word").withColumn("value", F.col("times") * F.col("idf"))
    others = F.first("all") - F.sum("times")
    lengths = valued.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("value") ** 2) + others * rarest**2).alias("norm"))
    dots = valued.join(F.broadcast(sided.select("template", "licence", "word", "weight")), "word").groupBy("path", "unit", "template", "licence").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    scored = dots.join(lengths, ["path", "unit"]).select("path", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    best = F.max(F.struct("score", F.col("licence")))
    return scored.groupBy("path").agg(best.alias("best")).select("path", "best.licence", "best.score")


def scan_licences(files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE) -> DataFrame:
    """(path, licence, score, how, from_path) for every distinct path of ``files``.

    ``how`` is own, inherited or none.  A licence file passes its licence on to its
    directory and all below it, up to a nearer one; of several in a directory the best
    score counts, then the first path.  An inherited licence keeps the score of its file.
    Other columns are not read; null paths are left out.
    """
    found = detect_licences(files, path, text, templates, least)
    paths = files.select(F.col(f"`{path}`").alias("path")).where("path is not null").distinct().withColumn("directory", _directory(F.col("path")))
    name = F.element_at(F.split("path", "/"), -1)
    givers = found.where(name.rlike(LICENCE_FILE)).withColumn("above", _directory(F.col("path")))
    first = F.min(F.struct((-F.col("score")).alias("s"), "path", "licence", "score"))
    givers = givers.groupBy("above").agg(first.alias("g")).select("above", F.col("g.path").alias("from_path"), F.col("g.licence").alias("given"), F.col("g.score").alias("given_score"))
    parts = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = paths.select("directory").distinct().select("directory", F.explode(F.array_distinct(ancestors)).alias("above"))
    nearest = up.join(givers, "above").groupBy("directory").agg(F.max_by(F.struct("from_path", "given", "given_score"), F.length("above")).alias("n"))
    nearest = nearest.select("directory", "n.*")
    joined = paths.join(found, "path", "left").join(nearest, "directory", "left")
    how = F.when(F.col("licence").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        "path", F.coalesce("licence", "given").alias("licence"), F.coalesce("score", "given_score").alias("score"), how.alias("how"),
        F.when(F.col("licence").isNotNull(), F.col("path")).otherwise(F.col("from_path")).alias("from_path"),
    )
