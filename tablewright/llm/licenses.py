"""License scans: named phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.text import LETTERS, LOWERED, whole

# Words, phrases with their labels, and the public notices that serve as templates.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files, to deal in the Software without restriction",
    "apache-notice": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance "
                     "with the License. You may obtain a copy of the License at",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-nd": "Licensed under CC BY-ND 4.0",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "public-domain": "This is free and unencumbered software released into the public domain",
}
CONTAINMENT = 0.9


def lowered(text: Column) -> Column:
    return F.translate(whole(text), LETTERS, LOWERED)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(f"[^{SEPARATORS}]+"), F.lit(0))


def _driver_words(text: str) -> list[str]:
    import re
    return re.findall(f"[^{SEPARATORS}]+", text.translate(str.maketrans(LETTERS, LOWERED)))


@dataclass(frozen=True)
class Template:
    label: str
    length: int  # words of the notice, repeats counted
    tokens: tuple[str, ...]  # distinct, rarest in the corpus first
    need: int  # words a block must share

    @property
    def prefix(self) -> tuple[str, ...]:
        """A block that shares enough words shares one of these."""
        return self.tokens[:len(self.tokens) - self.need + 1]


def order_templates(
    documents: DataFrame, words: str, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT,
) -> list[Template]:
    """The templates with their words in the order of the corpus's document counts.

    Counts cover all documents; only words of templates are counted, so what reaches the driver is
    bounded by the templates.
    """
    split = {label: _driver_words(text) for label, text in templates.items()}
    vocabulary = sorted({w for ws in split.values() for w in ws})
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = documents.select(F.explode(F.array_intersect(words, known)).alias("word"))
    counts = dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}
    out = []
    for label, ws in split.items():
        tokens = tuple(sorted(set(ws), key=lambda w: (counts[w], w)))
        out.append(Template(label, len(ws), tokens, math.ceil(containment * len(tokens) - 1e-9)))
    return out


def template_blocks(words: Column, templates: Sequence[Template]) -> Column:
    """All blocks of a document that meet the threshold: label, first word, word after the last, containment.

    A block is a run of twice a template's length that starts at a multiple of that length, so every
    passage of the template's length lies in one. Templates are looked up by the prefix words that
    the document has; a document too short for the shared words (length filter), or whose words from
    the first matched place on are too few (positional filter), is dropped before blocks are formed.
    """
    index: dict[str, list[int]] = {}
    for number, t in enumerate(templates, 1):
        for w in t.prefix:
            index.setdefault(w, []).append(number)
    postings = F.create_map(*[x for w, ns in index.items() for x in (F.lit(w), F.array(*[F.lit(n) for n in ns]))])
    table = F.array(*[
        F.struct(F.lit(t.label).alias("label"), F.lit(t.length).alias("length"), F.lit(t.need).alias("need"),
                 F.array(*[F.lit(w) for w in t.tokens]).alias("tokens")) for t in templates])
    hits = F.array_intersect(words, F.array(*[F.lit(w) for w in index]))
    candidates = F.array_distinct(F.flatten(F.transform(hits, lambda w: F.element_at(postings, w))))

    def fits(number: Column) -> Column:
        t = F.element_at(table, number)
        remaining = F.size(words) - F.array_position(words, F.element_at(F.array_intersect(words, t["tokens"]), 1)) + 1
        return (F.size(F.array_intersect(words, t["tokens"])) >= t["need"]) & (remaining >= t["need"])

    def blocks(number: Column) -> Column:
        t = F.element_at(table, number)
        starts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / t["length"]).cast("int"))
        runs = F.transform(starts, lambda i: F.struct(
            t["label"].alias("label"), (i * t["length"]).cast("bigint").alias("first"),
            F.least(F.size(words), (i + 2) * t["length"]).cast("bigint").alias("stop"),
            F.size(F.array_intersect(F.slice(words, i * t["length"] + 1, 2 * t["length"]), t["tokens"])).alias("shared")))
        enough = F.filter(runs, lambda r: r["shared"] >= t["need"])
        return F.transform(enough, lambda r: F.struct(
            r["label"].alias("label"), r["first"].alias("first"), r["stop"].alias("stop"),
            (r["shared"] / F.size(t["tokens"])).alias("containment")))

    return F.flatten(F.transform(F.filter(candidates, fits), blocks))


def phrase_places(marked: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often a phrase's words stand consecutively, and the first and last word it starts at (else null).

    ``marked`` holds every word between < and >, so neighbouring places share no character.
    """
    sought = "".join(f"<{w}>" for w in phrase.split(" "))

    def words_before(characters: Column) -> Column:
        before = marked.substr(F.lit(1), characters)
        return (F.length(before) - F.length(F.replace(before, F.lit("<"), F.lit("")))).cast("bigint")

    count = ((F.length(marked) - F.length(F.replace(marked, F.lit(sought), F.lit("")))) / len(sought)).cast("bigint")
    first = F.instr(marked, sought)
    tail = F.instr(F.reverse(marked), sought[::-1])
    return (count, F.when(first > 0, words_before(first - 1)),
            F.when(tail > 0, words_before(F.length(marked) - tail - len(sought) + 1)))


def scan(
    docs: DataFrame, text: str = "text", phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``blocks``, ``labels``, ``score``.

    A null text is empty: no words, no labels, score 0. Repeated rows are scanned each for itself, an
    empty table gives no rows, and columns of ``docs`` with one of these names are replaced. The score
    is 1 where a phrase stands, else the largest containment of a block found, else 0.
    """
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "blocks", "labels", "score")
    given = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    split = docs.drop(*added).withColumn("__words", words_of(F.col(text)))
    ordered = order_templates(split, "__words", templates, containment)
    # Only texts with a word that all phrases hold are marked up; the others have no places.
    last = {p.split(" ")[-1] for p in phrases}
    low = lowered(F.col(text))
    may = F.lit(False)
    for w in sorted(last):
        may = may | F.contains(low, F.lit(w))
    marked = F.when(may, F.regexp_replace(low, f"[{SEPARATORS}]*([^{SEPARATORS}]+)[{SEPARATORS}]*", "<$1>")).otherwise("")
    staged = split.select(*given, "__words", marked.alias("__marked"))
    places = {p: phrase_places(F.col("__marked"), p) for p in phrases}
    staged = staged.select(
        *given, F.size("__words").cast("bigint").alias("n_words"),
        *[c.alias(f"__{kind}{i}") for i, p in enumerate(phrases) for kind, c in zip("nfl", places[p])],
        template_blocks(F.col("__words"), ordered).alias("blocks"))
    every = range(len(phrases))
    labels = F.array_compact(F.array(*[F.when(F.col(f"__n{i}") > 0, F.lit(v)) for i, v in zip(every, phrases.values())]))
    return staged.select(
        *given, "n_words", sum((F.col(f"__n{i}") for i in every), F.lit(0).cast("bigint")).alias("n_base"),
        F.least(*[F.col(f"__f{i}") for i in every]).alias("first_word"),
        F.greatest(*[F.col(f"__l{i}") for i in every]).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(labels)), ",").alias("base_labels"), "blocks",
        F.array_join(F.sort_array(F.array_union(labels, F.transform("blocks", lambda b: b["label"]))), ",").alias("labels"),
        F.when(F.size(labels) > 0, 1.0).otherwise(
            F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))).alias("score"))
