"""Operator 12, license scans: an exact set-similarity join of text blocks with templates.

A document's words are cut into overlapping blocks of ``2 * stride`` words, a block every
``stride`` words, so each passage of up to ``stride + 1`` words lies whole in a block.  A
block meets a template if it holds ``share`` percent of the template's distinct words
(containment).  Tokens are ordered by the number of documents that hold them, rarest
first; only words of templates can be shared, so only they are counted and a block is
reduced to them.  With ``needed`` words to share, a pair of a template and a block

* is too short if the block has fewer than ``needed`` tokens (length filter);
* shares a token among the first ``size - needed + 1`` of each (prefix filter);
* after the last token shared there must have enough tokens left in both to come to
  ``needed`` (positional filter);
* is verified by the whole intersection.

No filter loses a pair.  A document without any template's prefix token is not cut into
blocks at all.  The templates are constants of the plan: their number bounds what is
counted, collected (a number for each distinct token) and sent.  Everything else stays in
the document's own row, so nothing but the token counts is shuffled, and no group of
equal documents meets in one task.

Base labels come from phrases whose words stand next to each other; the templates' labels
are added to them.  ``score`` is the highest containment of the blocks found, 0 if none.

Rows: a null or empty text has no words and no label; texts of any length are scanned
whole; repeated rows and null keys stay as they are and give equal results; ties need no
rule, since all labels and places count; an empty table gives an empty result.  All
columns of the input are kept in ``row``, so no name can clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: What separates words, and the letters lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The phrases of the registered query and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Containment in percent, and words from one block to the next.
SHARE, STRIDE = 80, 40


@dataclass(frozen=True)
class Template:
    label: str
    text: str

    @property
    def tokens(self) -> list[str]:
        """The distinct words, in the order of the alphabet."""
        return sorted(set(re.findall(WORD, self.text.lower())))

    def needed(self, share: int) -> int:
        return -(-share * len(self.tokens) // 100)


#: Notices and first sentences of public licenses.
TEMPLATES = (
    Template("mit", "Released under the MIT License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the software without restriction",
    ),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template(
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    Template("lgpl", "under the terms of the GNU Lesser General Public License"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    Template("mpl", "subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc", "Licensed under CC BY 4.0"),
    Template("cc", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand next to each other, from 0."""
    parts = phrase.split()
    none = F.array().cast("array<int>")
    possible = (F.size(words) >= len(parts)) & F.array_contains(words, parts[-1])

    def begins(at: Column) -> Column:
        found = F.lit(True)
        for n, part in enumerate(parts):
            found = found & (F.get(words, at + n) == part)
        return found

    starts = F.sequence(F.lit(0), F.size(words) - len(parts))
    return F.when(possible, F.filter(starts, begins)).otherwise(none)


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def token_order(words: DataFrame, templates: tuple[Template, ...]) -> list[str]:
    """The templates' tokens by the number of documents (``words``) that hold them, rarest first."""
    tokens = sorted({token for template in templates for token in template.tokens})
    held = words.select(F.explode(F.array_intersect("words", _texts(tokens))).alias("token"))
    counted = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    seen = {row.token: row.n for row in counted.collect()}  # at most one row a token
    return sorted(tokens, key=lambda token: (seen.get(token, 0), token))


def _index(templates: tuple[Template, ...], order: list[str], share: int) -> Column:
    """The templates as an array: label, tokens in order, how many are needed, prefix."""
    rank = {token: n for n, token in enumerate(order)}
    found = []
    for template in templates:
        tokens, needed = sorted(template.tokens, key=rank.__getitem__), template.needed(share)
        found.append(
            F.struct(
                F.lit(template.label).alias("label"),
                _texts(tokens).alias("tokens"),
                F.lit(needed).alias("needed"),
                _texts(tokens[: len(tokens) - needed + 1]).alias("prefix"),
            )
        )
    return F.array(*found)


def _met(template: Column, block: Column) -> Column:
    """Whether a block, in token order, meets a template: filters, then the intersection."""
    needed, size = template["needed"], F.size(block)
    prefix = F.slice(block, F.lit(1), F.greatest(size - needed + 1, F.lit(0)))
    common = F.array_intersect(template["prefix"], prefix)
    last = F.element_at(common, -1)
    left = F.least(
        F.size(template["tokens"]) - F.array_position(template["tokens"], last),
        size - F.array_position(block, last),
    )
    return (
        (size >= needed)
        & F.arrays_overlap(template["prefix"], prefix)
        & (F.size(common) + left >= needed)
        & (F.size(F.array_intersect(template["tokens"], block)) >= needed)
    )


def scan(
    docs: DataFrame,
    text: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    share: int = SHARE,
    stride: int = STRIDE,
) -> DataFrame:
    """``row`` (the input's columns), the columns of the contract, and ``blocks``.

    ``blocks`` lists label, start, length (in words) and containment of each block that
    meets a template.
    """
    rows = docs.select(F.struct("*").alias("row"), words_of(F.col(text)).alias("words"))
    order = token_order(rows.select("words"), templates)
    index = _index(templates, order, share)
    least = min(template.needed(share) for template in templates)
    rank = {token: n for n, token in enumerate(order)}
    prefixes = set()
    for template in templates:
        ordered = sorted(template.tokens, key=rank.__getitem__)
        prefixes.update(ordered[: len(ordered) - template.needed(share) + 1])

    def block(start: Column) -> Column:
        held = F.slice(F.col("words"), start + 1, 2 * stride)
        # The intersection keeps the order of its first argument.
        return F.struct(
            start.alias("start"), F.size(held).alias("length"), F.array_intersect(_texts(order), held).alias("tokens")
        )

    def meets(found: Column) -> Column:
        met = F.filter(index, lambda template: _met(template, found["tokens"]))
        return F.transform(
            met,
            lambda template: F.struct(
                template["label"].alias("label"),
                found["start"].alias("start"),
                found["length"].alias("length"),
                (
                    F.size(F.array_intersect(template["tokens"], found["tokens"])) / F.size(template["tokens"])
                ).alias("containment"),
            ),
        )

    possible = (F.size("words") > 0) & F.arrays_overlap("words", _texts(sorted(prefixes)))
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(stride))
    long_enough = F.filter(F.transform(starts, block), lambda b: F.size(b["tokens"]) >= least)
    at = [places(F.col("words"), phrase) for phrase, _ in phrases]
    found = rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.array(*at).alias("places"),
        F.when(possible, F.flatten(F.transform(long_enough, meets))).alias("blocks"),
    )
    base = F.array_compact(
        F.array(*[F.when(F.size(F.get("places", F.lit(n))) > 0, label) for n, (_, label) in enumerate(phrases)])
    )
    every = F.flatten("places")
    none = F.array().cast("array<string>")
    added = F.coalesce(F.transform("blocks", lambda b: b["label"]), none)
    score = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return found.select(
        "row",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, added))), ",").alias("labels"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
        "blocks",
    )
