"""License scans by MinHash over text windows, verified by exact shingle containment.

In DataFrame functions only. A template of n word shingles is sought in windows
of 2 n shingles that start every `stride` = max(1, n / 2): any run of 1.5 n
shingles lies wholly in one, so a notice may have n / 2 words put in. Windows without a single shingle of any template
cannot contain one and are left out first (a hash-set test on each shingle,
nothing is lost). For the others, MinHash bands retrieve templates of their
size, and the share of the template's shingles that the window holds decides.

A window that contains at least 0.8 of a template has a Jaccard similarity of
0.8 n / (2 n + 0.2 n) = 0.36 or more, so one of 24 bands of a row agrees with
probability 1 - (1 - 0.36)^24 > 0.9999. A notice that holds 0.8 in all but is
spread over more than 1.5 n shingles may do so in no window, and is then not
found. The template library is a parameter of at most
`MAX_TEMPLATE_SHINGLES` shingles in all, the proven bound of what is broadcast.

Defined results: a null text is the empty text; texts of fewer words than a
shingle contain nothing; letters and digits make words, case is ignored; rows
that repeat a doc_id are one document (null is one, too); of equally good
windows the first is named; very long texts are scanned whole; a template of
fewer words than a shingle is an error; an empty table gives an empty table. Only the id
and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stonefold.llm.common import spread

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8
BANDS, ROWS = 24, 1
MAX_TEMPLATE_SHINGLES = 50_000

#: License statements and notices as published, by SPDX identifier.
TEMPLATES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: str) -> Column:
    """Hashes of the word shingles of the array column `w`, by position."""
    parts = ", ".join(f"{w}[i + {k}]" for k in range(SHINGLE_WORDS))
    return F.expr(f"if(size({w}) < {SHINGLE_WORDS}, array(), transform(sequence(0, size({w}) - {SHINGLE_WORDS}), i -> xxhash64({parts})))")


def bands(s: str) -> Column:
    """A hash of each band's number and minima over the shingle hashes `s`."""
    rows = lambda b: ", ".join(f"array_min(transform({s}, h -> xxhash64(h, {b * ROWS + r})))" for r in range(ROWS))
    return F.expr("array(" + ", ".join(f"xxhash64({b}, {rows(b)})" for b in range(BANDS)) + ")")


def library(spark: SparkSession, templates: Iterable[tuple[str, str]]) -> DataFrame:
    """(template, license, own, n, bands): the distinct shingles of each template, their number and bands."""
    some = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(templates)])
    rows = spark.range(1).select(F.explode(some).alias("t")).select("t.template", "t.license", words(F.col("t.text")).alias("w"))
    rows = rows.select("template", "license", F.array_distinct(shingles("w")).alias("own")).withColumn("n", F.size("own"))
    return rows.withColumn("bands", bands("own"))


def scan(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment and first_word of the best window, and n_windows that match, for each license in each document."""
    lib = library(docs.sparkSession, tuple(templates))
    # bounded by the library
    known = lib.select("own", "n").collect()
    if any(r["n"] == 0 for r in known):
        raise ValueError(f"a template has fewer than {SHINGLE_WORDS} words")
    if sum(r["n"] for r in known) > MAX_TEMPLATE_SHINGLES:
        raise ValueError(f"more than {MAX_TEMPLATE_SHINGLES} template shingles")
    hashes, sizes = sorted({h for r in known for h in r["own"]}), sorted({r["n"] for r in known})
    rows = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")).select("doc_id", shingles("w").alias("s"))
    rows = rows.select("doc_id", "s", F.filter(F.transform("s", lambda h, i: F.when(h.isin(hashes), i)), lambda p: p.isNotNull()).alias("hits"))

    def windows(n: int) -> str:
        stride, size = max(1, n // 2), 2 * n
        # windows k that hold the position p: k * stride <= p <= k * stride + size - 1
        ks = f"array_distinct(flatten(transform(hits, p -> sequence(greatest(0, cast(ceil((p - {size - 1}) / {stride}) AS INT)), cast(p DIV {stride} AS INT)))))"
        return f"transform({ks}, k -> named_struct('n', {n}, 'first', k * {stride}, 's', slice(s, k * {stride} + 1, {size})))"

    found = F.expr("concat(" + ", ".join(map(windows, sizes)) + ")") if sizes else F.expr("cast(array() AS array<struct<n:int,first:int,s:array<bigint>>>)")
    # an outer explode keeps the optimizer from testing the array, that is making it, twice
    rows = rows.select("doc_id", F.explode_outer(found).alias("x")).where("x IS NOT NULL").select("doc_id", "x.n", "x.first", "x.s").withColumn("b", bands("s"))
    hit = rows.join(F.broadcast(lib.withColumnsRenamed({"bands": "tb"})), "n").where(F.arrays_overlap("b", "tb"))
    share = F.size(F.array_intersect("s", "own")) / F.col("n")
    hit = hit.select("doc_id", "license", "first", share.alias("containment")).where(F.col("containment") >= MIN_CONTAINMENT)
    best = F.max_by(F.struct("containment", "first"), F.struct("containment", -F.col("first")))
    return hit.groupBy("doc_id", "license").agg(best.alias("x"), F.count("*").alias("n_windows")).select("doc_id", "license", "x.containment", F.col("x.first").cast("long").alias("first_word"), "n_windows")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    from stonefold.llm.common import table

    return scan(table(spark, sf_dir, "documents")).withColumn("containment", F.round("containment", 6))


def _template_rows() -> str:
    """The templates' words as SQL VALUES."""
    rows = []
    for i, (name, text) in enumerate(TEMPLATES):
        w = re.findall(r"[^\W_]+", text.lower())
        rows += [f"({i}, '{name}', '{' '.join(w[k : k + SHINGLE_WORDS])}')" for k in range(len(w) - SHINGLE_WORDS + 1)]
    return ", ".join(rows)


OP2_SQL = rf"""
WITH t AS (SELECT DISTINCT * FROM (VALUES {_template_rows()}) AS v(template, license, shingle)),
n AS (SELECT template, count(*) AS n, greatest(1, count(*) // 2) AS stride FROM t GROUP BY template),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda z: z <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
s AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS shingle FROM p),
h AS (SELECT doc_id, template, license, shingle, unnest(range(greatest(0, CAST(ceil((pos - (2 * n - 1)) / stride) AS BIGINT)), pos // stride + 1)) AS k, n, stride FROM s JOIN t USING (shingle) JOIN n USING (template)),
c AS (SELECT doc_id, template, license, k * stride AS first_word, count(DISTINCT shingle) / n AS containment FROM h GROUP BY doc_id, template, license, k, stride, n)
SELECT doc_id, license, round(max(containment), 6) AS containment, arg_max(first_word, struct_pack(c := containment, f := -first_word)) AS first_word, count(*) AS n_windows
FROM c WHERE containment >= 0.8 GROUP BY doc_id, license
"""
