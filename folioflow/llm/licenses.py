"""License scan: MinHash bands retrieve templates for text windows, exact shingle containment verifies them.

A template of n words is looked for in windows of 3n words that start every n words, so
every occurrence of up to 2n words, inserted ones included, lies wholly inside some window. The
number of one-row bands is chosen from the similarity that a window of this length has
at the threshold itself, so that any match collides in at least one band
with probability TARGET or more. A collision is verified by the exact share of the template's
5-word shingles that the window holds; CONTAINMENT or more is a match.

Only built-in functions. Windows are made for the templates of which a whole document holds
CONTAINMENT or more, since no window can hold more than its document; the test is exact. Templates are a small fixed list.

Defined cases: null and blank texts have no match; a template of fewer than five words is one
shingle; matches are given once per document id and template, with the best containment
and then the earliest window; repeated rows give the same matches once; an empty
table gives none; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import settled

SHINGLE = 5
CONTAINMENT = 0.8
TARGET = 0.999
WIDTH = 3

# Short notices and well-known opening paragraphs of public licenses.
TEMPLATES: Mapping[str, str] = {
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
    "was not distributed with this file, You can obtain one at",
}

_NOT_WORD = r"[^\p{L}\p{N}]+"


def license_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD, " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def shingles(words: Column) -> Column:
    """64-bit hashes of all runs of five words; of the whole text if it is shorter."""
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))),
        lambda i: F.xxhash64(*[F.coalesce(F.get(words, i + k), F.lit("")) for k in range(SHINGLE)]),
    )
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(runs)


def bands_for(n_words: int, n_grams: int | None = None, containment: float = CONTAINMENT) -> int:
    """Bands that find a containment in a window of WIDTH times n_words with probability TARGET; n_grams: distinct shingles."""
    grams = n_grams or max(1, n_words - SHINGLE + 1)
    held = max(1, math.ceil(containment * grams - 1e-9))
    share = held / (max(grams, WIDTH * n_words - SHINGLE + 1) + grams - held)
    return 1 if share >= 1 else math.ceil(math.log(1 - TARGET) / math.log(1 - share))


def signature(hashes: Column, bands: Column) -> Column:
    """One MinHash value per band."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, first_word (of the window), n_windows that match."""
    spark = docs.sparkSession
    named = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    known = named.select("license", license_words(F.col("body")).alias("w")).filter(F.size("w") > 0)
    known = known.select("license", F.size("w").alias("n"), F.array_distinct(shingles(F.col("w"))).alias("grams"))
    table = known.collect()  # the fixed list
    if not table:
        return docs.select("doc_id").limit(0).selectExpr("doc_id", "'' license", "0D containment", "0L first_word", "0L n_windows")
    every = F.array(*[F.lit(g) for g in sorted({g for r in table for g in r["grams"]})])
    hashed = settled(docs.select("doc_id", "text"), "w", license_words(F.col("text"))).withColumn("g", shingles(F.col("w")))
    hit = settled(hashed, "hit", F.array_intersect("g", every))
    bands = {}
    for r in table:
        bands[r["n"]] = max(bands.get(r["n"], 1), bands_for(r["n"], len(r["grams"]), containment))

    def worth(r):
        grams = F.array(*[F.lit(g) for g in r["grams"]])
        size = F.struct(F.lit(r["n"]).alias("n"), F.lit(bands[r["n"]]).alias("bands"))
        return F.when(F.size(F.array_intersect("hit", grams)) / len(r["grams"]) >= containment, size)

    sizes = F.array_distinct(F.array_compact(F.array(*[worth(r) for r in table])))
    sized = hit.filter(F.size("hit") > 0).select("doc_id", "g", F.size("w").alias("len"), F.explode(sizes).alias("s"))
    sized = sized.select("doc_id", "g", "len", "s.n", "s.bands")
    starts = F.sequence(F.lit(0), F.greatest(F.col("len") - F.col("n"), F.lit(0)), F.col("n"))
    wide = F.greatest(WIDTH * F.col("n") - SHINGLE + 1, F.lit(1))
    windows = sized.select("doc_id", "n", "bands", "g", wide.alias("wide"), F.explode(starts).alias("at"))
    windows = windows.select("doc_id", "n", "bands", "at", F.slice("g", F.col("at") + 1, F.col("wide")).alias("g"))
    met = windows.select("doc_id", "n", "at", "g", F.posexplode(signature(F.col("g"), F.col("bands"))).alias("band", "value"))
    keys = known.withColumn("bands", F.create_map(*[F.lit(x) for kv in bands.items() for x in kv])[F.col("n")])
    keys = keys.select("license", "n", "grams", F.posexplode(signature(F.col("grams"), F.col("bands"))).alias("band", "value"))
    share = F.size(F.array_intersect("grams", "g")) / F.size("grams")
    met = met.join(F.broadcast(keys), ["n", "band", "value"])  # a fixed, small list
    matches = met.select("doc_id", "license", "at", share.alias("share")).filter(F.col("share") >= containment).distinct()
    best = F.max_by(F.struct("share", "at"), F.struct("share", -F.col("at")))
    out = matches.groupBy("doc_id", "license").agg(best.alias("best"), F.count(F.lit(1)).alias("n_windows"))
    return out.select("doc_id", "license", F.col("best.share").alias("containment"), F.col("best.at").cast("bigint").alias("first_word"), "n_windows")
