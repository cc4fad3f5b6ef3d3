"""License scans by exact set-similarity join [native].

Base labels come from fixed phrases of consecutive words. The method finds
every text block whose token set holds at least ``THRESHOLD`` of a license
template's token set. Blocks are the word windows of a text, across line
breaks: for a template of n words, any n / threshold (rounded up) consecutive
words. With ``windows=False`` they are the lines (``\\n``) instead.

Windows are looked for in pieces of twice the longest window that start at
every multiple of it, so each window lies in a piece; a piece passes the
filters below as a whole, and only then are its windows counted, those that
start at a token of the template (no other window holds more).

Tokens outside the templates' vocabulary cannot add to an overlap, so a block
is its token set within that vocabulary. Tokens are ordered by the number of
blocks of the whole corpus that hold them, rarest first (a table of one row a
vocabulary token). A template that a block must share ``need`` of ``size``
tokens with has one of its first ``size - need + 1`` tokens in the block
(prefix filter), the block has at least ``need`` tokens (length filter) and
the places of the first common token leave room for ``need`` (positional
filter); blocks meet templates by equi-join on prefix tokens and an
intersection confirms.

Defined results: null text is empty; a block that several templates fit gets
all their labels; labels belong to a row's own text, whatever other rows hold
its doc_id or none (rows are told apart by doc_id and a 64-bit hash of the
text), so repeated rows get equal labels; no documents, no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.llm.common import ascii_lower, read, staged, values

#: Everything up to 7F but 0-9 and a-z separates words (fixed by the contract).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: (label, text): notices as projects carry them.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]
THRESHOLD = 0.8
#: Tokens of all templates together: bounds the order table and the join's literal side.
MAX_VOCABULARY = 10_000


def norm_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def template_sets(spark: SparkSession, templates: list[tuple[str, str]]) -> list[tuple[str, list[str], int]]:
    """(label, distinct words, number of words) of each template; templates without a word are left out."""
    if not templates:
        return []
    rows = values(spark, "label string, text string", templates).withColumn("w", norm_words(F.col("text")))
    rows = rows.select("label", F.array_sort(F.array_distinct("w")).alias("w"), F.size("w").alias("n"))
    out = [(r["label"], list(r["w"]), r["n"]) for r in rows.collect() if r["w"]]
    if len({w for _, ws, _ in out for w in ws}) > MAX_VOCABULARY:
        raise ValueError(f"templates of more than {MAX_VOCABULARY} tokens")
    return out


def window(n_words: int, threshold: float) -> int:
    """Words of a block that is held against a template of ``n_words`` words."""
    return math.ceil(n_words / threshold - 1e-9)


def pieces(vocabulary: list[str], reach: int, least: int) -> Column:
    """The pieces of ``__w`` with ``least`` distinct tokens or more: (at, w) of each token of the vocabulary."""

    def piece(k):
        own = F.transform(F.slice("__w", k * reach + 1, 2 * reach), lambda x, i: F.when(x.isin(vocabulary), F.struct(i.alias("at"), x.alias("w"))))
        return F.filter(own, lambda x: x.isNotNull())

    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("__w") - 1, F.lit(0)) / reach).cast("int"))
    return F.filter(F.transform(starts, piece), lambda b: F.size(F.array_distinct(b["w"])) >= least)


def scanned(docs: DataFrame, vocabulary: list[str], text: str = "text", key: str = "doc_id", reach: int = 0, least: int = 1) -> DataFrame:
    """Per row: key, __row (of key and text), n_words, n_base, first_word, last_word, base (labels), blocks.

    Blocks are the lines' token sets within the vocabulary, or with ``reach`` the ``pieces``.
    """
    row = F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("text"))
    a = docs.select(F.col(key), row.alias("__row"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    a = a.withColumn("__w", F.array_remove(F.split("__t", NOT_WORD), ""))
    joined = F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" "))

    def places(phrase: str) -> Column:
        parts = phrase.split(" ")

        def start(x, i):
            whole = x == parts[0]
            for k, p in enumerate(parts[1:], 1):
                whole = whole & (F.get("__w", i + k) == p)
            return F.when(whole, i)

        at = F.filter(F.transform("__w", start), lambda i: i.isNotNull())
        return F.when(F.col("__j").contains(f" {phrase} "), at).otherwise(F.array().cast("array<int>"))

    tokens = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    if reach:
        blocks = pieces(vocabulary, reach, least)
    else:
        line_sets = F.transform(F.split("__t", "\n"), lambda line: F.array_intersect(F.split(line, NOT_WORD), tokens))
        blocks = F.filter(line_sets, lambda b: F.size(b) > 0)
    a = a.withColumn("__j", joined).withColumn("__p", F.array(*map(places, PHRASES)))
    labels = F.filter(
        F.array(*(F.when(F.size(F.get("__p", F.lit(i))) > 0, label) for i, label in enumerate(PHRASES.values()))), lambda x: x.isNotNull()
    )
    starts = F.flatten("__p")
    return a.select(
        key,
        "__row",
        F.size("__w").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base"),
        blocks.alias("blocks"),
    )


def matched(blocks: DataFrame, templates: list[tuple[str, list[str], int]], threshold: float = THRESHOLD) -> DataFrame:
    """(key, label, score) of each block and template whose containment reaches the threshold.

    ``blocks``: key and tokens (distinct, within the templates' vocabulary);
    with spots, (at, w) of each token, the windows of a block are held against
    the template in place of the whole block.
    """
    spark = blocks.sparkSession
    vocabulary = sorted({w for _, ws, _ in templates for w in ws})
    counts = blocks.select(F.explode("tokens").alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counts.collect()}  # at most one row a vocabulary token
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    sets, prefix = [], []
    for t, (label, ws, n) in enumerate(templates):
        ranks = sorted(rank[w] for w in ws)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        sets.append((t, label, ranks, need, sorted(ws), window(n, threshold)))
        prefix += [(r, t, i) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    index = values(spark, "rank int, template int, place int", prefix).join(
        values(spark, "template int, label string, ranks array<int>, need int, own_words array<string>, reach int", sets), "template"
    )
    spots = ["spots"] if "spots" in blocks.columns else []
    ranked = blocks.select(
        "key",
        *spots,
        F.array_sort(F.transform("tokens", lambda w: F.array_position(F.array(*map(F.lit, order)), w).cast("int") - 1)).alias("own"),
    ).where(F.size("own") >= min(s[3] for s in sets))
    first = sorted({r for r, _, _ in prefix})
    hits = (
        ranked.where(F.arrays_overlap("own", F.array(*map(F.lit, first))))
        .select("key", *spots, "own", F.posexplode("own").alias("spot", "rank"))
        .join(index, "rank")
        .where(
            (F.size("own") >= F.col("need"))
            & (F.least(F.size("own") - F.col("spot"), F.size("ranks") - F.col("place")) + F.least("spot", "place") >= F.col("need"))
        )
    )
    overlap = F.size(F.array_intersect("own", "ranks"))
    if spots:
        hits = hits.where(overlap >= F.col("need")).withColumn("spots", F.filter("spots", lambda x: F.array_contains("own_words", x["w"])))

        def held(s):
            inside = F.filter("spots", lambda x: (x["at"] >= s["at"]) & (x["at"] < s["at"] + F.col("reach")))
            return F.size(F.array_distinct(inside["w"]))

        hits = hits.withColumn("held", F.array_max(F.transform("spots", held)))
        overlap = F.col("held")
    return hits.where(overlap >= F.col("need")).select("key", "label", (overlap / F.size("ranks")).alias("score")).groupBy("key", "label").agg(
        F.max("score").alias("score")
    )


def licensed(
    docs: DataFrame, templates: list[tuple[str, str]], threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id", windows: bool = False
) -> DataFrame:
    """One row per document: key, counts of the base phrases, base_labels, labels, score."""
    spark = docs.sparkSession
    sets = template_sets(spark, templates)
    reach = max((window(n, threshold) for _, _, n in sets), default=0) if windows else 0
    least = min((math.ceil(threshold * len(ws) - 1e-9) for _, ws, _ in sets), default=1)
    rows = staged(scanned(docs, sorted({w for _, ws, _ in sets for w in ws}), text, key, reach, least), "licenses")
    out = rows.withColumn("base_labels", F.array_join("base", ","))
    if sets:
        blocks = rows.select(F.col("__row").alias("key"), F.explode("blocks").alias("tokens"))
        if reach:
            blocks = blocks.select("key", F.col("tokens").alias("spots"), F.array_distinct("tokens.w").alias("tokens"))
        found = matched(blocks, sets, threshold).groupBy(F.col("key").alias("__key")).agg(
            F.collect_set("label").alias("__labels"), F.max("score").alias("__score")  # a set of template labels at most
        )
        out = out.join(found, F.col("__row") == F.col("__key"), "left")  # a struct is never null, nulls inside it are equal
    else:
        out = out.withColumns({"__labels": F.lit(None).cast("array<string>"), "__score": F.lit(None).cast("double"), "__key": F.lit(None)})
    none = F.array().cast("array<string>")
    score = F.greatest(F.coalesce("__score", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return out.select(
        key, "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("__labels", none))), ",").alias("labels"),
        score.alias("score"),
    )


def op10_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, labels and score of every document's license notices."""
    return licensed(read(spark, sf_dir, "documents").select("doc_id", "text"), TEMPLATES, windows=True)
