"""License scans: TF-IDF cosine of lines to license templates, then inheritance from the nearest directory.

Lines of every file, headers and license files alike, are compared with templates as sparse TF-IDF
vectors, by joins on terms. A file without a license of its own takes that of the nearest directory above
it that holds a license file, by joins on paths. DataFrame functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, stage

#: Cosine from which a line states a license.
LEAST = 0.6
#: A file is a license file by its name, or if license lines hold such a share of its words.
NAMED, SHARE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.\-_].*)?$", 0.5
#: What license lines say.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "proprietary": ("All rights reserved.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."),
}


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def vocabulary(templates: dict) -> dict[tuple[str, int], dict[str, int]]:
    """How often each template, (license, number), holds each term."""
    out: dict[tuple[str, int], dict[str, int]] = {}
    for name, forms in templates.items():
        for i, form in enumerate(forms):
            own = out.setdefault((name, i), {})
            for t in re.findall("[a-z0-9]+", form.lower()):
                own[t] = own.get(t, 0) + 1
    return out


def telling(counts: dict, idf: dict[str, float], least: float) -> list[str]:
    """Terms one of which any line with cosine `least` to a template holds.

    A line that shares only other terms with a template has at most the cosine of the template with its own
    part in those terms; the most common terms are left out for as long as that stays below `least`.
    """
    out = sorted(idf, key=lambda t: (idf[t], t))
    whole = {k: math.sqrt(sum((n * idf[t]) ** 2 for t, n in own.items())) for k, own in counts.items()}
    dropped: set[str] = set()
    for t in list(out):
        after = dropped | {t}
        if all(math.sqrt(sum((n * idf[x]) ** 2 for x, n in own.items() if x in after)) < 0.999 * least * whole[k] for k, own in counts.items()):
            dropped = after
    return [t for t in out if t not in dropped]


def file_of() -> Column:
    """What tells files apart: path and text."""
    return F.struct("path", F.xxhash64("text").alias("key"))


def license_lines(files: DataFrame, templates: dict = TEMPLATES, least: float = LEAST) -> DataFrame:
    """path, key, line, license, score, words: the lines of files (path, text) that state a license.

    Statistics are over all files, of every term of a line; what the driver gets is one count a term of the templates.
    """
    spark = files.sparkSession
    counts = vocabulary(templates)
    known = sorted({t for own in counts.values() for t in own})
    rows = files.select(file_of().alias("file"), "text")  # a struct, so that null paths are equal
    held = rows.select(F.explode(F.array_intersect(terms(F.col("text")), F.array(*map(F.lit, known)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = {r.term: r.df for r in held.collect()}
    total = rows.count()
    idf = {t: math.log((1 + total) / (1 + df.get(t, 0))) + 1 for t in known}
    tell = F.array(*map(F.lit, telling(counts, idf, least)))
    lines = rows.where(F.arrays_overlap(terms(F.col("text")), tell)).select("file", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line", "said"))
    lines = lines.withColumn("terms", terms(F.col("said"))).where(F.arrays_overlap("terms", tell)).distinct()
    each = stage(lines.select("file", "line", F.explode("terms").alias("term")).groupBy("file", "line", "term").agg(F.count("*").alias("n")))
    # counts of all terms combine before the shuffle; only those of the lines go on
    every = rows.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    every = stage(every.join(each.select("term").distinct(), "term", "left_semi"))
    each = each.join(every, "term").withColumn("w", F.col("n") * (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1))
    norm = {k: math.sqrt(sum((n * idf[t]) ** 2 for t, n in own.items())) for k, own in counts.items()}
    forms = spark.createDataFrame([(t, name, i, n * idf[t] / norm[name, i]) for (name, i), own in counts.items() for t, n in own.items()], "term string, license string, form int, v double")
    by = ["file", "line"]
    size = each.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("n").alias("words"))
    dots = each.join(F.broadcast(forms), "term").groupBy(*by, "license", "form").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    found = dots.join(size, by).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= least)
    best = found.groupBy(*by).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"), F.first("words").alias("words"))
    return best.select("file.path", "file.key", "line", "b.license", (-F.col("b.s")).alias("score"), "words")


def parent(path: Column) -> Column:
    """The directory of a path; empty for a file at the top."""
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/+$", "")


def ancestors(directory: Column) -> Column:
    """(directory, levels above) of a directory and all above it, the top being empty."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    up = lambda p: F.transform(F.sequence(F.lit(0), F.size(p)), lambda i: F.named_struct(F.lit("above"), F.array_join(F.slice(p, 1, F.size(p) - i), "/"), F.lit("levels"), i))
    return F.element_at(F.transform(F.array(parts), up), 1)


def scan(files: DataFrame, templates: dict = TEMPLATES, least: float = LEAST) -> DataFrame:
    """files (path, text and others) with license, license_score, license_from: the path that says so.

    A file's own license is its best line's, ties going to the first name; else that of the nearest
    directory at or above its own with a license file, the best scored and then the first path. All three are
    null where nothing is found. A null text states nothing; a null path inherits nothing; rows that repeat
    get a result each; no rows give no rows. Columns of these names are replaced.
    """
    files = files.select(*[quoted(c) for c in files.columns if c.lower() not in ("license", "license_score", "license_from")])
    lines = stage(license_lines(files.select("path", "text"), templates, least))
    own = lines.groupBy(F.struct("path", "key").alias("file")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"), F.sum("words").alias("said")).select("file", F.col("b.license").alias("own"), (-F.col("b.s")).alias("own_score"), "said")
    own = stage(own)
    sized = files.select("path", file_of().alias("file"), F.size(terms(F.col("text"))).alias("words")).join(own, "file")
    holders = sized.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(NAMED) | (F.col("said") >= SHARE * F.col("words")))
    holders = holders.where("path is not null").withColumn("above", F.array_join(F.filter(F.split(parent(F.col("path")), "/"), lambda p: p != ""), "/"))
    held = stage(holders.groupBy("above").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", F.col("own").alias("license"))).alias("h")))
    folders = files.where("path is not null").select(parent(F.col("path")).alias("folder")).distinct()
    near_held = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "a.above", "a.levels").join(held, "above")
    near_held = stage(near_held.groupBy("folder").agg(F.min(F.struct("levels", "h")).alias("n")).select("folder", "n.h"))
    key, folder, file, mine, score, near, held_by = (fresh(files, n) for n in ("key", "folder", "file", "mine", "points", "near", "holder"))
    rows = files.withColumns({key: file_of(), folder: parent(F.col("path"))})
    rows = rows.join(own.drop("said").toDF(file, mine, score), F.col(key) == F.col(file), "left").join(near_held.toDF(near, held_by), F.col(folder) == F.col(near), "left")
    above = F.col(held_by)
    return rows.select(*map(quoted, files.columns), F.coalesce(F.col(mine), above["license"]).alias("license"), F.coalesce(F.col(score), -above["s"]).alias("license_score"), F.when(F.col(mine).isNotNull(), F.col("path")).otherwise(above["path"]).alias("license_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """doc_id, text and a path for each document: its source is a tree with a directory for every 100 ids."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", "text", path.alias("path"))
