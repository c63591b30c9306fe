"""License scanning with Column functions only: fixed phrases, and an exact set-similarity join against templates.

Text blocks are lines and paragraphs between blank lines; for a template of one sentence they are the sentences in those, as
its few words come together by chance in a long paragraph. A block matches a template if it contains at least a given share of the
template's distinct words, all of its telling words (those that set one license apart from the others) and none of those that
belong to another license. The words of all templates are ordered by how many documents hold them, rarest first; a block is
seen as its own words among these, in that order. A block that reaches the share must hold one of the first
|T| - ceil(share |T|) + 1 words of the template (prefix filter: an inverted index from those words to templates), hold as many
of the templates' words as it must share (length filter), and hold that many from the common word on (positional filter). The
filters lose nothing. What passes is counted in full.

Templates, their index and their words are three constants; what a block costs depends on the templates that its rare words
name, not on how many there are. As those words are rare, few documents are cut into blocks at all. The corpus is read twice:
for document frequencies of the templates' words (a row for each word) and for the result, which is worked out within each
row. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Listed one by one, the characters between words are one table lookup to Java's matcher; as four ranges they are ten times slower.
_BETWEEN = "".join(f"\\x{c:02X}" for c in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))
WORD, GAP = f"[^{_BETWEEN}]", f"[{_BETWEEN}]"
#: Fixed values of the contract: phrase, label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Template:
    """A notice and its label; a match holds every one of ``telling`` (words of the notice) and none of ``never``."""

    label: str
    text: str
    telling: tuple[str, ...]
    never: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return sorted(set(re.findall(r"[a-z0-9]+", self.text.lower())))


#: Short notices in general use, and the opening notices that licenses ask for.
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("license", "mit", "released")),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("charge", "sublicense")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("fee", "purpose")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("apache", "2")),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ("apache", "compliance")),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc", "by", "nc"), ("nd", "sa")),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative", "commons", "noncommercial"), ("noderivatives", "sharealike")),
    Template("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ("creative", "commons", "noncommercial", "sharealike")),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative", "commons", "sharealike"), ("noncommercial",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative", "commons", "attribution"), ("noncommercial", "noderivatives", "sharealike")),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived", "neighboring")),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu", "general", "3"), ("affero", "lesser")),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version", ("gnu", "general", "3"), ("affero", "lesser")),
    Template("gpl-2", "This work is licensed under the GNU General Public License, version 2", ("gnu", "general", "2"), ("affero", "lesser")),
    Template("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or at your option any later version", ("gnu", "general", "2"), ("affero", "lesser")),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu", "lesser")),
    Template("agpl-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3", ("gnu", "affero")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution", "binary", "permitted")),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one", ("mozilla",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered",)),
    Template("all-rights-reserved", "All rights reserved", ("reserved",)),
)
SHARE = 0.8
BLANK = r"\n[\x09\x0B-\x0D\x20]*\n\s*"
SENTENCE = r"[.!?](?=\s)"
#: A template of fewer distinct words is one of a sentence.
ONE_SENTENCE = 16


def _words(text: Column) -> Column:
    return F.filter(F.split(text, GAP + "+"), lambda w: w != "")


def _place(phrase: str) -> str:
    """Where the phrase's words stand one after another: its first word, with the others ahead; either case of A-Z."""
    first, *rest = (re.escape(w) for w in phrase.split(" "))
    ahead = "".join(f"{GAP}+{w}" for w in rest)
    return f"(?i)(?<!{WORD}){first}(?={ahead}(?!{WORD}))"


def _count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD + "+"))


def _starts(text: Column, phrase: str) -> Column:
    """First and last word number at which a phrase stands and how often, null without one. Most texts lack one of its words."""
    pattern = _place(phrase)
    pieces = F.split(text, pattern, -1)
    last = _count_words(text) - _count_words(F.element_at(pieces, -1)) - 1
    said = F.struct(_count_words(F.get(pieces, F.lit(0))).cast("long").alias("first"), last.cast("long").alias("last"), (F.size(pieces) - 1).cast("long").alias("n"))
    apart = [F.contains(F.col("low"), F.lit(w)) for w in sorted(set(phrase.split(" ")), key=len, reverse=True)]
    return F.when(functools.reduce(lambda a, b: a & b, apart) & text.rlike(pattern), said)


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, whole, in lower-cased text; words with the same first letter share a branch."""
    branches: dict[str, list[str]] = {}
    for w in words:
        branches.setdefault(w[0], []).append(re.escape(w[1:]))
    return f"(?<!{WORD})(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in branches.items())})(?!{WORD})"


def document_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each word of the templates stands: one row for each word of the templates' vocabulary."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_of(words)), F.lit(0)))
    rows = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return {w: 0 for w in words} | {r["word"]: r["n"] for r in rows}


def _least(n: int, share: float) -> int:
    return math.ceil(share * n - 1e-9)


@dataclass(frozen=True)
class Index:
    """The templates as constants: all words in their global order, prefix words to templates, and the templates themselves."""

    prefixes: tuple[str, ...]
    words: Column
    postings: Column
    templates: Column


def index_of(templates: dict[int, Template], seen: dict[str, int], share: float) -> Index:
    in_order = sorted({w for t in templates.values() for w in t.words}, key=lambda w: (seen[w], w))
    place = {w: i for i, w in enumerate(in_order)}
    rows, postings = [], {}
    for number, (nr, t) in enumerate(templates.items()):
        own = sorted(t.words, key=place.__getitem__)
        least = _least(len(own), share)
        rows.append({"nr": nr, "label": t.label, "words": own, "telling": list(t.telling), "never": list(t.never), "least": least, "n": len(own)})
        for word in own[: len(own) - least + 1]:
            postings.setdefault(word, []).append({"template": number, "least": least})
    constant = lambda value, schema: F.from_json(F.lit(json.dumps(value)), schema)  # noqa: E731  (folded to a literal when planned)
    return Index(
        tuple(sorted(postings)),
        constant(in_order, "array<string>"),
        constant(postings, "map<string, array<struct<template: int, least: int>>>"),
        constant(rows, "array<struct<nr: int, label: string, words: array<string>, telling: array<string>, never: array<string>, least: int, n: int>>"),
    )


def _joined(block: Column, index: Index) -> Column:
    """(template, label, share, told) of every template that a block of distinct words contains to the threshold.

    This is the join. Whether the block also has the telling words, and none that belong to another license, is told beside it.
    """
    nothing = F.expr("cast(array() as array<struct<template: int, least: int>>)")

    def named(own: Column) -> Column:
        """Templates that a prefix word names and that can still share enough from that word on."""
        return F.array_distinct(
            F.flatten(F.transform(own, lambda w, i: F.transform(F.filter(F.coalesce(F.try_element_at(index.postings, w), nothing), lambda p: F.size(own) - i >= p["least"]), lambda p: p["template"])))
        )

    def judged(own: Column, number: Column) -> Column:
        t = F.get(index.templates, number)
        told = (F.size(F.array_except(t["telling"], own)) == 0) & ~F.arrays_overlap(t["never"], block)
        common = F.size(F.array_intersect(t["words"], own))
        return F.struct(t["nr"].alias("template"), t["label"].alias("label"), F.when(common >= t["least"], common / t["n"]).otherwise(0.0).alias("share"), told.alias("told"))

    def verified(own: Column) -> Column:
        return F.filter(F.transform(named(own), lambda number: judged(own, number)), lambda m: m["share"] > 0)

    return F.get(F.transform(F.array(F.array_intersect(index.words, block)), verified), F.lit(0))


def _found(index: Index, ends: tuple[str, ...], none: Column) -> Column:
    """What the join finds in the blocks that the given ends leave of the lower-cased text; most texts hold no prefix word and are not cut."""
    rare = _any_of(list(index.prefixes))
    blocks = F.array_distinct(F.filter(F.concat(*(F.split("low", end) for end in ends)), lambda b: b.rlike(rare)))
    with_block = lambda b, m: F.struct(b.alias("block"), *(m[c].alias(c) for c in ("template", "label", "share", "told")))
    return F.when(F.col("low").rlike(rare), F.flatten(F.transform(blocks, lambda b: F.transform(_joined(F.array_distinct(_words(b)), index), lambda m: with_block(b, m))))).otherwise(none)


def _all_found(docs: DataFrame, templates: tuple[Template, ...], share: float) -> Column:
    """The join of a row's blocks (its text in lower case is the column low) with all templates: block, template, label, share, told."""
    for t in templates:
        if not set(t.telling) <= set(t.words):
            raise ValueError(f"telling words must stand in the notice: {t}")
    none = F.expr("cast(array() as array<struct<block: string, template: int, label: string, share: double, told: boolean>>)")
    seen = document_frequencies(docs, sorted({w for t in templates for w in t.words})) if templates else {}
    short, long = ({i: t for i, t in enumerate(templates) if (len(t.words) < ONE_SENTENCE) == one} for one in (True, False))
    cuts = (short, (rf"{SENTENCE}|\n", rf"{SENTENCE}|{BLANK}")), (long, (r"\n", BLANK))
    return F.concat(none, *(_found(index_of(some, seen, share), ends, none) for some, ends in cuts if some))


def contained(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, share: float = SHARE) -> DataFrame:
    """The set-similarity join itself: doc_id, block, template, label, share, told, one row for every block and template that meet.

    A block is given in lower case; template is the place in ``templates``; share is how much of the template's distinct words the block
    holds, ``share`` or more. told: the block has the template's telling words and none that belong to another license, which ``scan``
    asks for. Nulls, empty texts and repeated rows are as in ``scan``.
    """
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return rows.select("doc_id", F.explode(_all_found(docs, templates, share)).alias("m")).select("doc_id", "m.*")


def scan(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[Template, ...] = TEMPLATES, share: float = SHARE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, contained.

    n_base counts the places of all phrases; first_word and last_word are the smallest and largest word number at which one
    starts, null without any. Labels are distinct, sorted and joined by commas. The score is the largest share of a template
    that a matching block contains, at least ``share`` or else 0, and 1 where a phrase stands. contained: labels of all templates
    that a block contains to the threshold, whether or not it has their telling words (``contained`` gives these blocks). A null text counts as empty: no
    words, no labels, score 0. Rows that repeat each return a row; columns besides doc_id and text are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("low", F.lower("text"))
    rows = rows.withColumn("places", F.array(*(_starts(F.col("text"), p) for p, _ in phrases)))
    rows = rows.withColumn("joined", _all_found(docs, templates, share)).withColumn("matches", F.filter("joined", lambda m: m["told"]))
    base = F.filter(F.transform("places", lambda p, i: F.when(p.isNotNull(), F.get(F.array(*(F.lit(x) for _, x in phrases)), i))), lambda x: x.isNotNull())
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    there = F.filter("places", lambda p: p.isNotNull())
    score = F.when(F.size(there) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)))
    return rows.select(
        "doc_id",
        _count_words(F.col("text")).cast("long").alias("n_words"),
        F.aggregate(there, F.lit(0).cast("long"), lambda t, p: t + p["n"]).alias("n_base"),
        F.array_min(F.transform(there, lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform(there, lambda p: p["last"])).alias("last_word"),
        join(base).alias("base_labels"),
        join(F.concat(base, F.transform("matches", lambda m: m["label"]))).alias("labels"),
        score.alias("score"),
        join(F.transform("joined", lambda m: m["label"])).alias("contained"),
    )
