"""License scans with DataFrame functions alone.

Documents are read in overlapping windows of words. Each window's MinHash values, a band each, are looked up among the templates';
a window and a template that meet are verified by the share of the template's shingles in the window. Templates are put in classes by
length, and a window is a quarter longer than the class and moves by a quarter, so that any place of a template lies whole in some
window: their similarity is then at least 0.4 and 16 bands of one value miss it with probability 0.6**16 = 0.0003.

Notices of different licences may be nearly the same. Where the text of a rival would hold enough of a template to be taken for it, the
window must also show a shingle that the rival does not have: what tells the two apart decides, not what they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once

SHINGLE, BANDS = 3, 16
# Short notices of public licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}


def _word_hashes(text: Column) -> Column:
    """Hashes of a text's words in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return once(F.transform(words, lambda w: F.xxhash64(w)))


def _shingled(rows: DataFrame, words: str, name: str) -> DataFrame:
    """Adds the hashes of the shingles in order; fewer words have none."""
    places = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return rows.select("*", once(F.transform(places, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(SHINGLE)]))).alias(name))


def _bands(found: str) -> Column:
    def least(k: int) -> Column:  # a second parameter of a lambda would be the index
        return F.array_min(F.transform(found, lambda h: F.xxhash64(h, F.lit(k))))

    return F.array(*[least(k) for k in range(BANDS)])


def templates(spark, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """(template_id, license, found, width): the shingles of each notice and its class, the least power of two of shingles that holds it."""
    rows = [(i, name, text) for i, (name, text) in enumerate((n, t) for n, ts in sorted((notices or TEMPLATES).items()) for t in ts)]
    df = spark.createDataFrame(rows, "template_id int, license string, text string").select("*", _word_hashes(F.col("text")).alias("_w"))
    df = _shingled(df, "_w", "found").where(F.size("found") > 0)
    return df.select("template_id", "license", F.array_distinct("found").alias("found"), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.size("found"), F.lit(4))))).cast("int").alias("width"))


def telling_shingles(known: list, containment: float) -> dict[int, list[list[int]]]:
    """Of each template, for each rival of another license that holds `containment` of it but not all, the shingles the rival lacks."""
    sets = [(r["template_id"], r["license"], set(r["found"])) for r in known]
    rivals = lambda t, mine, found: [sorted(found - x) for _, name, x in sets if name != mine and containment <= len(found & x) / len(found) < 1]
    return {t: rivals(t, name, found) for t, name, found in sets}


def scan_licenses(docs: DataFrame, notices: dict[str, list[str]] | None = None, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, word_start, n_windows) of each document and license with a notice in it.

    containment is the share of the best notice's shingles in one window, word_start that window's first word (of equal ones the first),
    n_windows how many windows show the license. Words are lower-cased runs of letters and digits. Null, empty and short texts have no
    notice; rows that repeat an id are one document; those without an id come under null; other columns are ignored. Documents that share
    no shingle with any template are passed by: no window of theirs could meet or hold one. `notices` are configuration, held by the driver.
    A notice that stands whole in another license's notice is reported with it; near notices are told apart by the words that differ, and a
    text in which just those words are altered shows neither.
    """
    spark = docs.sparkSession
    known = templates(spark, notices)
    local = known.collect()  # the configured notices, whatever the input
    if not local:
        return docs.select(F.col(id_col), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("word_start"), F.lit(0).cast("long").alias("n_windows")).limit(0)
    every = F.array(*[F.lit(h) for h in sorted({h for r in local for h in r["found"]})])
    widths = sorted({r["width"] for r in local})
    telling = spark.createDataFrame(list(telling_shingles(local, containment).items()), "template_id int, telling array<array<bigint>>")
    known = known.join(F.broadcast(telling), "template_id")
    hashed = _shingled(docs.select(F.col(id_col), _word_hashes(F.col(text_col)).alias("_w")), "_w", "_s").select(id_col, "_s")
    hashed = hashed.withColumn("_hit", F.array_intersect("_s", every)).where(F.size("_hit") > 0)
    windows = hashed.withColumn("_width", F.explode(F.array(*[F.lit(w) for w in widths])))
    step = (F.col("_width") / 4).cast("int")
    windows = windows.withColumn("word_start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_s") - 1, F.lit(0)), step)))
    windows = windows.select(id_col, "_width", "word_start", once(F.array_distinct(F.slice("_s", F.col("word_start") + 1, F.col("_width") + step))).alias("_in"), "_hit")
    windows = windows.where(F.arrays_overlap("_in", "_hit")).select(id_col, "_width", "word_start", "_in")
    banded = windows.select("*", F.posexplode(_bands("_in")).alias("band", "value"))
    index = known.select("template_id", "license", F.col("width").alias("_width"), "found", "telling", F.posexplode(_bands("found")).alias("band", "value"))
    met = banded.join(F.broadcast(index), ["_width", "band", "value"])  # 16 rows a notice
    share = F.size(F.array_intersect("found", "_in")) / F.size("found")
    told = F.forall("telling", lambda x: F.arrays_overlap(x, F.col("_in")))
    good = met.where(told).select(id_col, "license", "word_start", share.alias("containment")).where(F.col("containment") >= containment)
    best = good.groupBy(id_col, "license").agg(F.max(F.struct("containment", -F.col("word_start"))).alias("b"), F.count_distinct("word_start").alias("n_windows"))
    return best.select(id_col, "license", F.col("b.containment").alias("containment"), (-F.col("b").getField("col2")).alias("word_start"), "n_windows")
