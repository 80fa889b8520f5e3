"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.llm.common import cut

SHINGLE = 5  # words
BANDS = 24  # of one MinHash each
SIMILARITY = 0.8
#: The templates of one scan are broadcast: this many of their shingles at most (8 MB), or a single longer one. More are scanned in parts.
MAX_SHINGLES = 100_000

# Widely used license notices, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or"
        ' substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING'
        " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
        " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"
        " are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission.",
    ),
]


def default_templates(spark: SparkSession) -> DataFrame:
    """license_id, text."""
    rows = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in TEMPLATES])
    return spark.range(1).select(F.inline(rows))


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: str) -> Column:
    """Hashes of all runs of five words of a word-list column, in order; the column must be one of the input's own."""
    w = F.col(words)
    return F.when(
        F.size(w) >= SHINGLE,
        F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])),
    ).otherwise(F.array().cast("array<bigint>"))


def bands(window: Column) -> Column:
    """(band, value) pairs: for each band the least of a seeded rehash of the window's shingles."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(band))))

    return F.array(*[F.struct(F.lit(b).alias("band"), least(b).alias("value")) for b in range(BANDS)])


def license_scan(df: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Find license notices anywhere in whole texts.

    Templates of t five-word shingles are looked for in windows of 2t shingles
    that begin every t: each stretch of t shingles lies whole inside one of
    them, where its Jaccard similarity to the window is at least 1/2 (0.36 when
    only 80 % of the template are there). Each window has 24 bands of one
    MinHash, so that a template is missed with a probability of at most 2^-24
    (2e-5). A window without any shingle of a template cannot share a band with
    one, so signatures are made of the others only. Retrieved pairs are verified
    by the share of the template's shingles that the window holds.

    Returns one row per input row and license found: doc_id, license_id,
    containment (the best window's), n_windows (windows that hold it).

    Null, empty and shorter texts than five words match nothing. Rows that
    repeat an id are reported each. An empty table gives an empty result; other
    columns are ignored. Templates shorter than five words are left out. t
    counts a template's shingles with their repeats, containment its distinct
    ones. Templates of more than MAX_SHINGLES shingles together are scanned in
    parts, each in a pass of its own over the texts.
    """
    spark = df.sparkSession
    own = (templates if templates is not None else default_templates(spark)).select(F.col("license_id"), word_list(F.col("text")).alias("w"))
    own = cut(
        own.select("license_id", shingle_hashes("w").alias("all"))
        .filter("size(all) > 0")
        .select("license_id", F.array_distinct("all").alias("shingles"), F.size("all").alias("t"), F.monotonically_increasing_id().alias("template_no")),
        "license-templates",
    )
    parts: list[list[int]] = []
    held = MAX_SHINGLES
    for row in own.select("template_no", F.size("shingles").alias("n")).orderBy("template_no").toLocalIterator():
        if held + row["n"] > MAX_SHINGLES:
            parts.append([row["template_no"], 0])
            held = 0
        parts[-1][1] = row["template_no"]
        held += row["n"]
    # A fixed row number: it groups what the parts find in one row.
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.col(text_col).cast("string").alias("text"))
    if len(parts) > 1:
        rows = cut(rows, "license-rows")
    found = None
    for first, last in parts:
        part = scan_part(rows, own.filter(F.col("template_no").between(first, last)), similarity)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.select(F.col(id_col).cast("long").alias("doc_id"), F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("n_windows")).limit(0)
    return (
        found.groupBy("row_no", "doc_id", "license_id")
        .agg(F.max("containment").alias("containment"), F.countDistinct("t", "k").alias("n_windows"))
        .select("doc_id", "license_id", "containment", "n_windows")
    )


def scan_part(rows: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """row_no, doc_id, license_id, t, k, containment: the windows of rows (row_no, doc_id, text) that hold a template of ``own``, whose shingles are few."""
    # Few: the templates' shingles and lengths become literals of the plan.
    known = own.select("shingles", "t").collect()
    literal = sorted({s for row in known for s in row["shingles"]})
    lengths = sorted({row["t"] for row in known})
    h = F.col("h")
    hashed = (
        rows.select("doc_id", "row_no", word_list(F.col("text")).alias("w"))
        .select("doc_id", "row_no", shingle_hashes("w").alias("h"))
        .select("doc_id", "row_no", "h", F.when(F.size(h) > 0, F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.get(h, i).isin(literal))).alias("hits"))
    )

    def windows(t: int) -> Column:
        begins = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.array(F.floor(p / t), F.greatest(F.lit(0), F.floor(p / t) - 1)))))
        return F.transform(begins, lambda k: F.struct(F.lit(t).alias("t"), k.cast("int").alias("k"), F.slice(h, (k * t + 1).cast("int"), F.lit(2 * t)).alias("window")))

    # The outer form keeps the optimizer from testing the array's size, for which it would compute all of it twice.
    cut_up = hashed.select("doc_id", "row_no", F.explode_outer(F.concat(*[windows(t) for t in lengths])).alias("x")).filter("x is not null")
    signed = cut_up.select("doc_id", "row_no", "x.*").select("*", F.inline(bands(F.col("window"))))
    known_bands = F.broadcast(own.select("license_id", "shingles", "t", F.inline(bands(F.col("shingles")))))
    held = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
    return signed.join(known_bands, ["t", "band", "value"]).withColumn("containment", held).filter(F.col("containment") >= similarity).select("row_no", "doc_id", "license_id", "t", "k", "containment")
