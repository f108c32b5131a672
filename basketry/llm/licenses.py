"""License scans with MinHash bands over overlapping windows, in DataFrame functions alone.

A template of m shingles is looked for in windows of m shingles and a fifth more, a fifth of m apart, so each of its
occurrences lies whole in one window. Where a window holds four fifths of a template, their Jaccard similarity is at
least 0.57, and BANDS bands of one MinHash each miss the pair with a chance below 0.43 ** 20 = 5e-8. What the bands
retrieve is verified by exact shingle containment.

Only windows with a word that some template of their size cannot do without are cut: if more than a fifth of a
template's shingles hold the word, no window without it reaches four fifths. This drops no match.

Defined results: null or empty texts match nothing; templates of fewer than SHINGLE words are one shingle; a template
without words is ignored; rows with equal ids are one document; each (document, license) is one row.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import named

SHINGLE = 5
LEAST = 0.8
BANDS = 20
# Most templates of one scan; their bands and shingles are handed to every task.
MOST_TEMPLATES = 5_000

# Short license notices as their publishers word them.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " ")))


def _signature(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))))


def _template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _classes(templates) -> list[tuple[int, int, int]]:
    """(shingle size, shingles, stride) of every kind of template."""
    found = set()
    for _, text in templates:
        if n := len(_template_words(text)):
            k = min(SHINGLE, n)
            m = n - k + 1
            found.add((k, m, max(1, int(m * (1 - LEAST)))))
    return sorted(found)


def _needed(templates, kind: tuple[int, int, int]) -> list[str]:
    """For each template of a kind the longest word in more than a fifth of its distinct shingles; empty if one has none."""
    out = set()
    for _, text in templates:
        words = _template_words(text)
        k = min(SHINGLE, len(words))
        if not words or (k, len(words) - k + 1) != kind[:2]:
            continue
        runs = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}
        usable = [w for w in words if sum(w in run for run in runs) > (1 - LEAST) * len(runs) + 1e-9]
        if not usable:
            return []
        out.add(max(usable, key=lambda w: (len(w), w)))
    return sorted(out)


def _starts_around(needed: list[str], span: int, stride: int, last: Column) -> Column:
    """Starts of the windows of ``span`` words, a stride apart and none after ``last``, that hold a needed word."""
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(needed))

    def around(place: Column) -> Column:
        lo = F.ceil(F.greatest(place - span + 1, F.lit(0)) / stride).cast("int") * stride
        hi = F.least(place, last)
        return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi), F.lit(stride))).otherwise(F.array().cast("array<int>"))

    return F.when(F.size("words") > 0, F.array_distinct(F.flatten(F.transform(places, around)))).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates=TEMPLATES, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, containment, n_windows, first_word) for every license found in a document.

    ``containment`` is the largest share of the template's shingles in one window, ``n_windows`` how many windows reach
    LEAST, ``first_word`` where the first of them starts.
    """
    spark = docs.sparkSession
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; a scan takes {MOST_TEMPLATES} at most")
    body = named(docs, text)[0].cast("string")
    rows = docs.select(named(docs, doc_id)[0].alias("doc_id"), body.alias("text"))
    classes = _classes(templates)
    needed = [_needed(templates, kind) for kind in classes]
    if all(needed):
        rows = rows.filter(F.col("text").rlike("(?i)" + "|".join(sorted({re.escape(w) for words in needed for w in words}))))
    rows = rows.select("doc_id", _words(F.col("text")).alias("words"))

    known = spark.createDataFrame([(n, t) for n, t in templates if _template_words(t)], "license string, template string")
    known = known.select("license", _words(F.col("template")).alias("words"))
    size = F.least(F.lit(SHINGLE), F.size("words"))
    parts, windows = [], []
    for c, (k, m, stride) in enumerate(classes):
        mine = known.filter((size == k) & (F.size("words") - k + 1 == m))
        parts.append(mine.select("license", F.lit(c).alias("kind"), F.array_distinct(_shingles(F.col("words"), k)).alias("template")))
        # Positions count from 0; the last window is the one that holds the last full-length place.
        last = F.greatest(F.size(f"s{k}") - m, F.lit(0))
        starts = _starts_around(needed[c], m + stride + k - 2, stride, last) if needed[c] else F.sequence(F.lit(0), last, F.lit(stride))
        cut = lambda s: F.struct(F.lit(c).alias("kind"), s.alias("at"), F.slice(F.col(f"s{k}"), s + 1, m + stride - 1).alias("window"))  # noqa: B023, E731
        windows.append(F.transform(starts, cut))
    if not parts:
        return rows.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).alias("first_word")).limit(0)
    for k in sorted({k for k, _, _ in classes}):
        rows = rows.withColumn(f"s{k}", _shingles(F.col("words"), k))
    cuts = rows.select("doc_id", F.explode(F.flatten(F.array(*windows))).alias("w")).select("doc_id", "w.*").filter(F.size("window") > 0)
    banded = cuts.select("doc_id", "kind", "at", "window", F.posexplode(_signature(F.col("window"))).alias("band", "value"))

    bands = parts[0]
    for p in parts[1:]:
        bands = bands.union(p)
    bands = bands.select("license", "kind", "template", F.posexplode(_signature(F.col("template"))).alias("band", "value"))
    share = F.size(F.array_intersect("window", "template")) / F.size("template")
    found = banded.join(F.broadcast(bands), ["kind", "band", "value"]).select("doc_id", "license", "at", share.alias("containment")).filter(F.col("containment") >= LEAST)
    each = found.groupBy("doc_id", "license", "at").agg(F.max("containment").alias("containment"))  # several bands find it
    return each.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.count("*").alias("n_windows"), F.min("at").alias("first_word"),
    )
