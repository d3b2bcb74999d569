"""License scan by an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, whatever lines they stand on: as many as a template has, and a quarter more
(``reach``); every run of every text is a block. A template is a set of words; a block meets it when it holds at least
THRESHOLD of those words. The words of all templates are ordered by how many documents hold them, rarest first. To reach
an overlap of t out of n, a block must hold one of the template's first n - t + 1 words (prefix), must have t words at
least (length), and a block whose first shared word is at place p of n, and i of its own k template words, can share
1 + min(n - p, k - i) - 1 at most (position). Texts are cut into pieces of PIECE words, each with the words that a block
begun there may still hold, so that no text makes a large row; pieces are joined with the prefix words, filtered, and
blocks around prefix words are verified on full sets. The templates are a small fixed table, so it is broadcast.

Defined results: null or empty text has no words, null places, empty labels and score 0; documents that repeat are
scanned alike, one row each; an empty table gives no rows; further columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, filled, stored

#: Characters that part words; ASCII other than digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Words at which the blocks of a piece begin.
PIECE = 512
#: Phrase, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, sentence that a text block is compared with. Of four words or fewer all are needed, so notices that differ in
#: the license's name only are given by four.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2.0 you may not use this file except in compliance with the license"),
    ("apache", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "under the apache license"),
    ("apache", "spdx license identifier apache"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "use of this source code is governed by a bsd style license"),
    ("bsd", "under the bsd license"),
    ("bsd", "spdx license identifier bsd"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by", "creative commons attribution license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "spdx license identifier gpl"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "released under the mit license"),
    ("mit", "spdx license identifier mit"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "the mozilla public license"),
    ("mpl", "spdx license identifier mpl"),
    ("reserved", "all rights reserved"),
)


def flat(text: Column) -> Column:
    """The words of a text, each between single spaces. Case is folded by ``lower``, which is fast; of letters beyond
    ASCII it makes no other word that counts here: all are word characters before and after."""
    low = F.lower(filled(text))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, GAP, " ")), F.lit(" "))


def words_of(padded: str) -> Column:
    return F.split(F.substring(padded, 2, F.length(padded) - 2), " ")


def places(words: str, phrase: str) -> Column:
    """Word numbers at which a phrase stands in an array column of words."""
    parts = phrase.split()

    def here(word: Column, i: Column) -> Column:
        met = word == parts[0]
        for k, part in enumerate(parts[1:], 1):
            met = met & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return F.when(met, i.cast("long"))

    return F.filter(F.transform(words, here), lambda x: x.isNotNull())


def needed(size: int, threshold: float) -> int:
    return max(1, -(-size * round(threshold * 1000) // 1000))


def reach(text: str) -> int:
    """Words in a run that is compared with a template: those of the template, and a quarter more, or two at least."""
    n = len(split_words(text))
    return n + max(2, n // 4)


def ranked(held: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple[list, list]:
    """(template, label, words, least, reach), and (word, template, place, size, need) of the words of prefixes."""
    table, prefixes = [], []
    for i, (label, text) in enumerate(templates):
        words = sorted(set(split_words(text)), key=lambda w: (held.get(w, 0), w))
        need = needed(len(words), threshold)
        table.append((i, label, words, need, reach(text)))
        prefixes += [(w, i, p, len(words), need) for p, w in enumerate(words[: len(words) - need + 1])]
    return table, prefixes


def pieces(texts: DataFrame, anchors: list[str], most: int) -> DataFrame:
    """row, words of each piece of a text that holds an anchor; ``texts`` has row and padded."""
    pattern = " (?:" + "|".join(anchors) + ") "
    found = texts.filter(F.col("padded").rlike(pattern)).select("row", words_of("padded").alias("words"))
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / PIECE).cast("int"))
    cut = found.select("row", F.explode(F.transform(starts, lambda k: F.slice("words", k * PIECE + 1, PIECE + most - 1))).alias("words"))
    return cut.filter(F.arrays_overlap("words", F.array(*map(F.lit, anchors))))


def containments(cut: DataFrame, order: list[str], table: list, prefixes: list) -> DataFrame:
    """row, label, share of the block that shares most with a template, for each piece and template with enough of it."""
    spark = cut.sparkSession
    prefix = F.broadcast(spark.createDataFrame(prefixes, "word string, template int, place int, size int, need int"))
    full = F.broadcast(spark.createDataFrame(table, "template int, label string, set array<string>, least int, reach int"))
    shared = F.array_intersect(F.array(*map(F.lit, order)), "words")  # the piece's template words, rarest first
    met = cut.select("row", "words", shared.alias("shared")).select("row", "words", "shared", F.posexplode("shared").alias("i", "word")).join(prefix, "word")
    able = met.filter((F.size("words") >= F.col("need")) & (F.least(F.col("size") - F.col("place"), F.size("shared") - F.col("i")) >= F.col("need")))
    # A pair of a piece and a template is verified for the first of its shared prefix words.
    pairs = able.join(full, "template").filter((F.array_position("set", F.col("word")) == 1 + F.col("place")) & (F.size(F.array_intersect("shared", "set")) >= F.col("least")))
    pairs = pairs.filter(F.element_at(F.array_intersect("shared", "set"), 1) == F.col("word"))
    begun = pairs.select("row", "label", "words", "set", "least", "reach", F.explode(begins()).alias("begin"))
    overlap = F.size(F.array_intersect(F.slice("words", F.col("begin"), F.col("reach")), F.col("set")))
    return begun.filter(overlap >= F.col("least")).groupBy("row", "label").agg(F.max(overlap / F.size("set")).alias("share"))


def begins() -> Column:
    """Where blocks begin that hold one of the set's prefix words: from 1, in the row's words, set, least and reach.

    Nothing in a lambda is computed from an array of the row but membership in the few prefix words, so the work is in
    proportion to the words and the blocks even where the optimizer repeats or moves the expression.
    """
    anchors = F.slice("set", 1, F.size("set") - F.col("least") + 1)
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(anchors, w), i + 1)), lambda i: i.isNotNull())
    last = F.greatest(F.size("words") - F.col("reach") + 1, F.lit(1))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - F.col("reach") + 1, F.lit(1)), F.least(i, last)))))


def split_words(text: str) -> list[str]:
    import re

    return [w for w in re.split(GAP, text.translate({a: a + 32 for a in range(65, 91)})) if w]


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and at, all places of base phrases."""
    vocabulary = sorted({w for _, text in templates for w in split_words(text)})
    row = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    texts = docs.select(row.alias("row"), flat(F.col("text")).alias("padded"))
    none = F.array().cast("array<long>")
    known = F.array(*map(F.lit, vocabulary))
    split = texts.select("row", "padded", words_of("padded").alias("words"))
    n_words = F.when(F.length("padded") > 2, F.size("words")).otherwise(0).cast("long")
    base = split.select("row", n_words.alias("n_words"), F.array_intersect(known, "words").alias("shared"), *(F.when(F.col("padded").contains(f" {phrase} "), places("words", phrase)).otherwise(none).alias(f"p{i}") for i, (phrase, _) in enumerate(BASE)))
    base = stored(base, "base")
    held = {r["w"]: r["n"] for r in base.select(F.explode("shared").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # the vocabulary at most
    table, prefixes = ranked(held, templates, threshold)
    cut = pieces(texts, sorted({p[0] for p in prefixes}), max(t[-1] for t in table))
    met = containments(cut, sorted(vocabulary, key=lambda w: (held.get(w, 0), w)), table, prefixes)
    added = stored(met.groupBy("row").agg(F.collect_set("label").alias("added"), F.max("share").alias("share")), "added")
    joined = base.drop("shared").join(added, "row", "left")
    labels = F.filter(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE))), lambda x: x.isNotNull())
    every = F.sort_array(F.concat(*(f"p{i}" for i in range(len(BASE)))))
    out = joined.select(F.col("row.id").alias("doc_id"), "n_words", every.alias("at"), labels.alias("base"), F.coalesce("added", F.array().cast("array<string>")).alias("added"), F.coalesce("share", F.lit(0.0)).alias("share"))
    return out.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").alias("first_word"), F.array_max("at").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "added")), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.col("share")).alias("score"), "at",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("at")


QUERIES, SQL = {"op6_license_scan": op6_license_scan}, {}
