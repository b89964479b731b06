"""License scans: MinHash bands over overlapping text windows find templates, shingle containment verifies them."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wordings that state a license, by name.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved. No part of this publication may be reproduced",
}
#: Wordings of fewer than ``SHINGLE`` words.
LINES = {"reserved-line": "All rights reserved"}
SHINGLE = 5
#: What parts words, once letters are lower case.
GAP = r"[^\p{L}\p{N}]+"


def _words(text):
    return F.filter(F.split(F.lower(text), GAP), lambda w: w != "")


def _hashes(words, size=SHINGLE):
    """Hashes of all runs of ``size`` words; of the whole where there are fewer (none without words)."""
    many = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(size)]))
    whole = F.array(F.xxhash64(F.concat_ws(" ", words)))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= size, many).when(F.size(words) > 0, whole).otherwise(none)


def _bands(a, b):
    """Two MinHash bands of one row each over a window's one or two shingles.

    The second hash order is the first one reversed, so of two shingles each is the least in one
    band. Templates are indexed in windows of two shingles and of one; a text window that shares a
    shingle with a template therefore meets that shingle's own window in a band for certain.
    """
    return F.array(F.struct(F.lit(0).alias("band"), F.least(a, b).alias("least")),
                   F.struct(F.lit(1).alias("band"), F.least(F.bitwise_not(a), F.bitwise_not(b)).alias("least")))


def _listed(spark, templates: dict) -> DataFrame:
    return spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", _words("text").alias("words"))


def short_index(spark, templates: dict) -> DataFrame:
    """(n, hash, license): the templates of fewer than ``SHINGLE`` words, each one shingle of its own ``n`` words."""
    rows = _listed(spark, templates).where(F.size("words").between(1, SHINGLE - 1))
    sized = [rows.where(F.size("words") == n).select(F.lit(n).alias("n"), F.element_at(_hashes(F.col("words"), n), 1).alias("hash"), "license")
             for n in range(1, SHINGLE)]
    return reduce(DataFrame.unionByName, sized)


def index(spark, templates: dict) -> DataFrame:
    """(band, least, license, template): the bands of every window of the templates of ``SHINGLE`` words or more, with the template's shingle hashes."""
    rows = _listed(spark, templates).where(F.size("words") >= SHINGLE)
    hashed = rows.select("license", F.array_distinct(_hashes(F.col("words"))).alias("template"))
    at = F.explode(F.sequence(F.lit(1), F.size("template")))
    placed = hashed.where(F.size("template") > 0).select("license", "template", at.alias("i"))
    one = F.element_at("template", F.col("i"))
    two = F.try_element_at("template", F.col("i") + 1)
    windows = placed.select("license", "template", F.explode(F.array_union(_bands(one, one), F.coalesce(_bands(one, F.coalesce(two, one)), F.array()))).alias("key"))
    return windows.select("key.band", "key.least", "license", "template").distinct()


def scanned(docs: DataFrame, templates: dict = None, containment: float = 0.8) -> DataFrame:
    """Licenses found in each document: (doc_id, license, containment, first_word, n_hits).

    Words are runs of letters and digits in lower case, shingles five of them. Texts are cut to
    windows of two shingles that overlap by four words; windows meet templates through the bands
    (broadcast: their size is that of the template list). A meeting counts where the shingles of
    the stretch around it, as far as the template could reach, hold at least ``containment`` of the
    template's different shingles. ``containment`` is the best of a document, ``first_word`` the
    number of the first meeting window's first word (from 0), ``n_hits`` how many windows met. Documents
    without a license, null, empty and blank texts give no row; a text of fewer than five words is
    one shingle. Repeated doc_ids are taken together, null ones too; extra columns are ignored.
    A template of fewer than five words is one shingle of its own length and is found wherever a
    text, long or short, holds these words in a row: its windows are these runs.
    """
    templates = TEMPLATES | LINES if templates is None else templates
    known, short = index(docs.sparkSession, templates), short_index(docs.sparkSession, templates)
    # One-row generators keep the word and shingle arrays from being computed anew for every element.
    words = docs.select("doc_id", F.explode(F.array(_words(F.coalesce("text", F.lit(""))))).alias("words"))
    hashed = words.select("doc_id", F.explode(F.array(_hashes(F.col("words")))).alias("h"))
    windows = hashed.select("doc_id", "h", F.explode(F.when(F.size("h") > 0, F.sequence(F.lit(1), F.size("h"), F.lit(2)))).alias("at"))
    one = F.element_at("h", F.col("at"))
    two = F.coalesce(F.try_element_at("h", F.col("at") + 1), one)
    keyed = windows.select("doc_id", "h", "at", F.explode(_bands(one, two)).alias("key")).select("doc_id", "h", "at", "key.band", "key.least")
    met = keyed.join(F.broadcast(known), ["band", "least"])
    reach = F.size("template") - 1
    begin = F.greatest(F.col("at") - reach, F.lit(1))
    stretch = F.slice("h", begin, F.col("at") + 1 + reach - begin + 1)
    held = F.size(F.array_intersect("template", stretch)) / F.size("template")
    found = met.select("doc_id", "license", "at", held.alias("held")).where(F.col("held") >= containment)
    for n in sorted(r["n"] for r in short.select("n").distinct().collect()):
        runs = words.where(F.size("words") >= n).select("doc_id", F.posexplode(_hashes(F.col("words"), n)).alias("i", "hash"))
        same = F.broadcast(short.where(F.col("n") == n).select("hash", "license"))
        found = found.unionByName(runs.join(same, "hash").select("doc_id", "license", (F.col("i") + 1).alias("at"), F.lit(1.0).alias("held")))
    return (found.groupBy("doc_id", "license").agg(F.max("held").alias("containment"), (F.min("at") - 1).cast("long").alias("first_word"),
                                                   F.count_distinct("at").alias("n_hits")))


def _sql():
    listed, lines = (", ".join(f"('{name}', '{text}')" for name, text in sorted(given.items())) for given in (TEMPLATES, LINES))
    cut = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    runs = ("CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) "
            "WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END")
    return f"""
WITH templates(license, text) AS (VALUES {listed}),
lines(license, text) AS (VALUES {lines}),
cut AS (SELECT license, {cut.format('text')} AS w FROM templates),
shingled AS (SELECT license, list_distinct({runs}) AS t FROM cut),
words AS (SELECT doc_id, {cut.format("coalesce(text, '')")} AS w FROM documents),
texts AS (SELECT doc_id, {runs} AS h FROM words),
places AS (SELECT doc_id, h, unnest(range(1, len(h) + 1)) AS p FROM texts),
met AS (
  SELECT DISTINCT doc_id, license, p - (p + 1) % 2 AS place, h, t FROM places
  JOIN (SELECT license, t, unnest(t) AS s FROM shingled) k ON k.s = h[p]),
held AS (
  SELECT doc_id, license, place,
         len(list_filter(t, lambda s: list_contains(h[greatest(place - len(t) + 1, 1):place + len(t)], s))) / len(t)::DOUBLE AS held FROM met),
short AS (
  SELECT doc_id, license, unnest(list_filter(range(1, len(w) - len(l) + 2), lambda i: w[i:i + len(l) - 1] = l)) AS place
  FROM words, (SELECT license, {cut.format('text')} AS l FROM lines))
SELECT doc_id, license, max(held) AS containment, (min(place) - 1)::BIGINT AS first_word, count(DISTINCT place)::BIGINT AS n_hits
FROM (SELECT doc_id, license, place, held FROM held WHERE held >= 0.8 UNION ALL SELECT doc_id, license, place, 1.0 FROM short)
GROUP BY doc_id, license
"""


SQL = _sql()
