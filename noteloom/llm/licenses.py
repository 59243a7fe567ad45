"""License scans: phrases, and an exact containment join of text blocks with license templates, in DataFrame expressions only.

Words are runs of a-z, 0-9 and characters beyond ASCII, after A-Z are lower-cased. Base places are where a phrase's words stand
consecutively. The join: a text's words are cut into blocks of BLOCK words, a new one every STEP words, so that any passage of
STEP + 1 words lies in one block. A block matches a template if it holds at least ``threshold`` of the template's distinct words.

1. The words of all templates are counted over the corpus, by documents that hold them, and put in one order, rarest first. Only these
   words, of which there are as many as the templates have, play a part.
2. A template of n words of which k are needed must share one of its first n - k + 1 words with the block (prefix filter). Texts
   that hold no word of any prefix are left after one look; for the others the templates left are held against each block.
3. Of the first shared word the places in template and block bound how many more they can share (positional filter), and a block with fewer
   template words than needed is out (length filter). What passes is verified by counting the shared words.

Templates are a fixed list of bounded size, so they travel as literals. Each text is judged in its own row: nothing is shuffled but the
counts, at most one for each template word and task.

Defined results: a null or empty text has no words, labels or places and the score 0; rows that repeat a doc_id are judged each by itself; very long texts
are judged whole; the score is 1 where a phrase stands, else the greatest containment found, and 0 where no block meets the threshold; other
columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Opening words of well-known license texts and notices, with their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one"),
    ("mit", "Released under the MIT License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)
CONTAINMENT = 0.8
#: Words of a block, and words from one block's start to the next; no template has more than STEP + 1 words.
BLOCK, STEP = 64, 32
#: ASCII characters that are no part of a word once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def needed(n: int, threshold: float = CONTAINMENT) -> int:
    return math.ceil(threshold * n - 1e-9)


def template_words(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(label, distinct words) of each template."""
    held = [(label, list(dict.fromkeys(re.findall(r"[a-z0-9]+", text.lower())))) for label, text in templates]
    long = [label for (label, text) in templates if len(re.findall(r"[a-z0-9]+", text.lower())) > STEP + 1]
    if long:
        raise ValueError(f"templates of more than {STEP + 1} words would not fit a block: {long}")
    return held


def spaced(text: Column) -> Column:
    """The words, with one space before each and one after the last; without words one space."""
    bare = F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), CAPITALS, SMALL), BETWEEN, " ")
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.rtrim(bare), F.lit(" "))))


def _count(x: Column) -> Column:
    """Words of a text that has a space after each (or before each), by its spaces."""
    return (F.length(x) - F.length(F.translate(x, " ", ""))).cast("long")


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def rarest_first(docs: DataFrame, words: list[str]) -> list[str]:
    """The words by how many texts of docs(text) hold them, then by code points; one row for each of them reaches the driver."""
    held = docs.select(F.explode(F.array_intersect(_strings(words), F.split(spaced(F.col("text")), " "))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, which is evaluated once however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _matches(words: Column, order: list[str], templates: list[tuple[str, list[str]]], threshold: float) -> Column:
    """array<struct<block, label, containment>> of the blocks that meet a template."""
    place = {w: k for k, w in enumerate(order)}
    listed, prefixes = [], set()
    for label, held in templates:
        held, need = sorted(held, key=place.__getitem__), needed(len(held), threshold)
        prefix = held[: len(held) - need + 1]
        prefixes.update(prefix)
        listed.append(F.struct(F.lit(label).alias("label"), _strings(held).alias("words"), _strings(prefix).alias("prefix"), F.lit(need).alias("need")))

    def shared(t: Column, mine: Column) -> Column:
        """How many words of the template the block holds, or 0 where a filter tells that they are too few."""
        first = F.get(F.array_intersect(t["prefix"], mine), F.lit(0))
        left = lambda x: F.least(F.size(t["words"]) - F.array_position(t["words"], x), F.size(mine) - F.array_position(mine, x))
        passed = (F.size(mine) >= t["need"]) & F.coalesce(_bound(first, lambda x: 1 + left(x) >= t["need"]), F.lit(False))
        return F.when(passed, F.size(F.array_intersect(t["words"], mine))).otherwise(0)

    def met(asked: Column, mine: Column, k: Column) -> Column:
        scored = F.transform(asked, lambda t: F.struct(k.alias("block"), t["label"].alias("label"), shared(t, mine).alias("shared"), t["need"].alias("need"), F.size(t["words"]).alias("n")))
        good = F.filter(scored, lambda s: s["shared"] >= s["need"])
        return F.transform(good, lambda s: F.struct(s["block"].alias("block"), s["label"].alias("label"), (s["shared"] / s["n"]).alias("containment")))

    def of(held: Column) -> Column:
        """Each block's template words in the common order, held against the templates of which the text has a prefix word."""
        places = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / STEP).cast("int"))
        mine = F.transform(places, lambda k: F.array_intersect(_strings(order), F.slice(held, k * STEP + 1, F.lit(BLOCK))))
        asked = F.filter(F.array(*listed), lambda t: F.arrays_overlap(t["prefix"], held))
        return _bound(asked, lambda a: F.flatten(F.transform(mine, lambda m, k: met(a, m, k))))

    none = F.expr("cast(array() as array<struct<block:int,label:string,containment:double>>)")
    return F.when(F.arrays_overlap(_strings(sorted(prefixes)), words), _bound(words, of)).otherwise(none)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, blocks, score.

    base_labels and labels are sorted arrays; blocks(block, label, containment) are all that meet a template, ``block`` counting from 0.
    """
    known = template_words(templates)
    order = rarest_first(docs, sorted({w for _, words in known for w in words}))
    rows = docs.select("doc_id", spaced(F.col("text")).alias("spaced"))
    held, first, last, labels = [], [], [], []
    n_words = _count(F.col("spaced")) - 1
    for phrase, label in PHRASES:
        ours, wide = F.col("spaced").contains(f" {phrase} "), len(phrase.split())
        held.append(F.when(ours, F.regexp_count("spaced", F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long"))
        first.append(F.when(ours, _count(F.substring_index("spaced", f" {phrase} ", 1))))
        last.append(F.when(ours, n_words - wide - _count(F.substring_index("spaced", f" {phrase} ", -1))))
        labels.append(F.when(ours, F.lit(label)))
    words = F.split(F.btrim("spaced"), " ")
    rows = rows.select(
        "doc_id", n_words.alias("n_words"), reduce(Column.__add__, held).alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
        F.sort_array(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base_labels"), _matches(words, order, known, threshold).alias("blocks"),
    )
    both = F.sort_array(F.array_union("base_labels", F.col("blocks.label")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("blocks.containment")), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", both.alias("labels"), "blocks", score.alias("score"))
