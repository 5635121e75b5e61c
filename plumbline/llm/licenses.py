"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies.

Words are runs of digits, letters a-z and characters beyond ASCII, after lower-casing; shingles are five words. For
every template length of L words a text is covered by windows of 2 L words that start every L words,
so an occurrence of the template lies whole inside one of them. A window without any template
shingle is dropped before it costs anything; for the others one MinHash value per band (one row a
band) is looked up among the templates' values. A window that contains a template of t shingles has
at most 2 L - 4 shingles, so a band collides with probability of t / (2 L - 4) or more (1/6 for five
words), and all 64 bands fail with probability (5/6)^64 < 1e-5 or less. What is retrieved is then
verified exactly: the share of the template's shingles in the window must be 0.8 or more.

Corner cases: null, empty and short texts match nothing unless they hold a template; templates of
fewer than five words are one shingle of all their words and match texts of just these words; every row
of the documents gives a row, and rows that share a doc_id share what any of them matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.native_text import let, shingle_hashes, split_words

SHINGLE = 5
BANDS = 64
CONTAINED = 0.8
#: Template words that may be sent to every executor; a larger set has to be given in parts.
MOST_WORDS = 200_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Notices of widely used licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
)


def words(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return split_words(F.translate(text, upper, lower), _BETWEEN)


def _bands(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))))


def prepare(templates: DataFrame) -> DataFrame:
    """template_id, n_words, shingles of templates(template_id, text) that have words, after a check of their size."""
    w = words(F.col("text"))
    out = templates.select("template_id", F.size(w).alias("n_words"), F.array_distinct(shingle_hashes(w, SHINGLE)).alias("shingles")).where("n_words > 0")
    total = out.agg(F.sum("n_words")).first()[0] or 0
    if total > MOST_WORDS:
        raise ValueError(f"{total} template words; give at most {MOST_WORDS} at a time and unite the results")
    return out


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """docs' doc_id plus n_matches and licenses (template_id, best containment), sorted."""
    ready = prepare(templates)
    rows = [(r["n_words"], list(r["shingles"])) for r in ready.select("n_words", "shingles").collect()]  # bounded by MOST_WORDS
    lengths = sorted({n for n, _ in rows})
    known = F.array(*(F.lit(h) for h in sorted({h for _, s in rows for h in s}))).cast("array<bigint>")
    have = docs.select("doc_id", shingle_hashes(words(F.col("text")), SHINGLE).alias("all"))
    have = have.withColumn("hits", F.when(F.arrays_overlap("all", known), F.col("all")).otherwise(F.array().cast("array<bigint>")))

    def windows(length: int) -> Column:
        n = 2 * length - SHINGLE + 1
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("hits") - 1, F.lit(0)), F.lit(length)), lambda s: s < F.size("hits"))
        return F.transform(starts, lambda s: F.struct(F.lit(length).alias("n_words"), F.array_distinct(F.slice(F.col("hits"), s + 1, max(n, 1))).alias("window")))

    cut = F.filter(F.concat(*(windows(n) for n in lengths)), lambda w: F.arrays_overlap(w["window"], known)) if lengths else F.array().cast("array<struct<n_words:int,window:array<bigint>>>")
    # the outer forms: for the plain ones the optimizer adds a filter below that would work out "cut" a second time
    found = have.select("doc_id", F.explode_outer(cut).alias("w")).where("w is not null")
    banded = found.select("doc_id", "w.n_words", "w.window", F.posexplode_outer(_bands(F.col("w.window"))).alias("band", "value"))
    index = ready.select("template_id", "n_words", "shingles", F.posexplode(_bands(F.col("shingles"))).alias("band", "value"))
    retrieved = banded.join(F.broadcast(index), ["n_words", "band", "value"])
    share = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
    verified = retrieved.select("doc_id", "template_id", share.alias("share")).where(F.col("share") >= CONTAINED)
    best = verified.groupBy("doc_id", "template_id").agg(F.max("share").alias("share"))
    best = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("template_id", "share"))).alias("licenses"))
    out = docs.select("doc_id").alias("d").join(best.alias("b"), F.expr("d.doc_id <=> b.doc_id"), "left").select("d.doc_id", "licenses")
    empty = F.array().cast("array<struct<template_id:string,share:double>>")
    return out.select("doc_id", F.coalesce(F.size("licenses"), F.lit(0)).cast("bigint").alias("n_matches"), F.coalesce("licenses", empty).alias("licenses"))
