"""License scan: MinHash bands over overlapping word windows, then exact shingle containment; DataFrame functions only.

1. A text's words (letters and digits, lower case) give shingles of five words, each one 64-bit hash.
2. Templates are grouped by length. A group reads a text in blocks of b shingles; a window is ``span`` adjacent blocks,
   stepping by one block, so every template of the group lies whole in some window. A window's MinHash for a band is the
   smallest hash after XOR with the band's seed; a band has one row. The number of bands is the least that retrieves
   a template of the required containment with probability 0.999 or more, whatever its place.
3. A window can share a minimum with a template only if it holds one of its shingles, so only such windows are hashed;
   this drops no retrieval. Windows and templates meet in a join on (group, band, minimum).
4. Every retrieved pair is verified: the share of the template's distinct shingles that the window holds has to reach
   ``CONTAINMENT``. A text's result for a template is its best window.

The template table is broadcast; it is bounded by ``MOST_SHINGLES``, beyond which an error is raised.

Defined cases: NULL, empty and wordless texts match nothing; a text or template with fewer words than a shingle has the
whole sequence as its one shingle; repeated rows each get their matches; of equally good windows the first counts; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.text import once

SHINGLE = 5
CONTAINMENT = 0.75
MISS = 1e-3
MOST_SHINGLES = 20_000

# Notices and opening paragraphs of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}


def shingles_of(text: Column) -> Column:
    """The shingle hashes of a text in order; an empty list for a text without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def rolled(codes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(codes) - SHINGLE)
        full = F.transform(at, lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(SHINGLE)]))
        whole = F.array(F.xxhash64(F.array_join(F.transform(codes, lambda c: c.cast("string")), " ")))
        return F.when(F.size(codes) >= SHINGLE, full).when(F.size(codes) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), rolled), F.lit(0))


def layout(n: int) -> tuple[int, int]:
    """Block length and span of the windows that templates of ``n`` shingles are looked for in."""
    if n == 1:
        return 1, 1
    b = 1
    while n > 2 * b + 1:
        b *= 2
    return b, 3


def bands_for(block: int, span: int) -> int:
    """The least number of one-row bands for the shortest template of a group at the required containment."""
    least = 1 if span == 1 else 2 if block == 1 else block + 2
    found = math.ceil(CONTAINMENT * least)
    similarity = found / (block * span + least - found)
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log(1 - similarity))


def _seed(band: int) -> int:
    """A 64-bit constant per band, from the golden ratio."""
    value = (0x9E3779B97F4A7C15 * (band + 1)) % (1 << 64)
    return value - (1 << 64) if value >= 1 << 63 else value


def _minimum(hashes: Column, bands: int) -> Column:
    """For each band, its number and the smallest hash after XOR with the band's seed."""

    def of(band: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(_seed(band)))))

    return F.array(*[F.struct(F.lit(k).alias("band"), of(k).alias("least")) for k in range(bands)])


def _windows(positions: Column, block: int, span: int) -> Column:
    """The windows of a group that hold one of the positions: kind, first shingle and length."""

    def starts(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda o: F.greatest(F.floor(p / block).cast("int") - o, F.lit(0)))

    window = lambda w: F.struct(F.lit(block * 10 + span).alias("kind"), (w * block).alias("start"), F.lit(block * span).alias("length"))
    return F.transform(F.array_distinct(F.flatten(F.transform(positions, starts))), window)


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, shingles, n) of the templates."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in templates.items()]))
    table = spark.range(1).select(rows.alias("t")).select("t.license", F.array_distinct(shingles_of(F.col("t.text"))).alias("template"))
    return table.withColumn("n_shingles", F.size("template")).filter("n_shingles > 0")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per text and license found: id, license, n_shingles, found, containment and first_shingle of the window."""
    spark = docs.sparkSession
    table = template_table(spark, templates or TEMPLATES)
    known = table.collect()  # bounded: the templates
    if sum(r["n_shingles"] for r in known) > MOST_SHINGLES:
        raise ValueError("too many templates for the broadcast table")
    pool = sorted({h for r in known for h in r["template"]})
    named = once(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), ["id"], h=shingles_of(F.col("text")))
    positions = F.array_compact(F.transform("h", lambda x, i: F.when(x.isin(pool), i)))
    touched = once(named, ["id"], h=F.col("h"), at=positions).filter(F.size("at") > 0)
    # Only texts with a template shingle come here, each once with its positions.
    groups = sorted({layout(r["n_shingles"]) for r in known})
    plans, signed = [], []
    for block, span in groups:
        plans.append(_windows(F.col("at"), block, span))
        own = [r["license"] for r in known if layout(r["n_shingles"]) == (block, span)]
        bands = F.explode(_minimum(F.col("template"), bands_for(block, span))).alias("m")
        signed.append(table.filter(F.col("license").isin(own)).select(F.lit(block * 10 + span).alias("kind"), "license", "template", "n_shingles", bands))
    windows = touched.select("id", "h", F.explode(F.concat(*plans)).alias("w")).select("id", F.col("w.kind").alias("kind"), F.col("w.start").alias("start"), F.slice("h", F.col("w.start") + 1, F.col("w.length")).alias("window"))
    longest = max((bands_for(*g) for g in groups), default=0)
    minima = windows.select("id", "kind", "start", "window", F.explode(_minimum(F.col("window"), longest)).alias("m"))
    minima = minima.select("id", "kind", "start", "window", F.col("m.band").alias("band"), F.col("m.least").alias("least"))
    signatures = signed[0]
    for more in signed[1:]:
        signatures = signatures.unionByName(more)
    signatures = signatures.select("kind", "license", "template", "n_shingles", F.col("m.band").alias("band"), F.col("m.least").alias("least"))
    retrieved = minima.join(F.broadcast(signatures), ["kind", "band", "least"])
    found = F.size(F.array_intersect("template", "window"))
    checked = retrieved.select("id", "license", "n_shingles", "start", found.alias("found")).filter(F.col("found") >= CONTAINMENT * F.col("n_shingles"))
    best = F.max(F.struct("found", (-F.col("start")).alias("back")))
    return (
        checked.groupBy("id", "license", "n_shingles")
        .agg(best.alias("b"))
        .select(F.col("id").alias(id_column), "license", "n_shingles", F.col("b.found").alias("found"), (F.col("b.found") / F.col("n_shingles")).alias("containment"), (-F.col("b.back")).alias("first_shingle"))
    )


def scan_sql(templates: dict[str, str] | None = None) -> str:
    """DuckDB SQL for ``scan`` over documents(doc_id, text): every window that holds a template shingle is verified."""
    rows, kinds = [], []
    for name, text in (templates or TEMPLATES).items():
        quoted = text.replace("'", "''")
        rows.append(f"('{name}', '{quoted}')")
    for n in range(1, 200):
        kinds.append(f"({n}, {layout(n)[0]}, {layout(n)[1]})")
    cut = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    return f"""
WITH t(license, text) AS (VALUES {', '.join(rows)}),
kinds(n, b, s) AS (VALUES {', '.join(kinds)}),
all_words AS (
  SELECT 'd' AS kind, doc_id AS id, NULL AS license, {cut} AS w FROM documents
  UNION ALL SELECT 't', NULL, license, {cut} FROM t),
sh AS (
  SELECT kind, id, license, i, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS g
  FROM (SELECT *, unnest(range(0, greatest(len(w) - {SHINGLE - 1}, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) AS i FROM all_words)),
tpl AS (SELECT license, g, count(*) OVER (PARTITION BY license) AS n FROM (SELECT DISTINCT license, g FROM sh WHERE kind = 't')),
hit AS (
  SELECT d.id, d.i, d.g, tpl.license, tpl.n, k.b, k.s FROM sh d JOIN tpl ON d.g = tpl.g JOIN kinds k ON k.n = tpl.n WHERE d.kind = 'd'),
win AS (SELECT DISTINCT id, license, n, b, greatest(i // b - o, 0) AS w, g, i, s FROM hit, range(0, 3) r(o) WHERE o < s),
cnt AS (
  SELECT id, license, n, w * b AS start, count(DISTINCT g) AS found FROM win WHERE i >= w * b AND i < (w + s) * b GROUP BY ALL),
best AS (
  SELECT id, license, n, max(found) AS found FROM cnt WHERE found >= {CONTAINMENT} * n GROUP BY ALL)
SELECT b.id AS doc_id, b.license, CAST(b.n AS INTEGER) AS n_shingles, CAST(b.found AS INTEGER) AS found, b.found / b.n AS containment,
  CAST(min(c.start) AS INTEGER) AS first_shingle
FROM best b JOIN cnt c ON c.id = b.id AND c.license = b.license AND c.found = b.found GROUP BY ALL"""
