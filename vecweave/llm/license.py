"""License scans: phrases, and an exact set-similarity join of text blocks with notice templates.

A block of a template is a window of words of one paragraph, a quarter longer than the
template (lines do not matter, an empty line ends a paragraph); as the set of its words. A
block meets a template when it holds at least ``CONTAINMENT`` of the template's words, and, for
templates under ``ORDERED`` words, as many of them in the template's order. Tokens are ordered by
how many documents of the corpus hold them, rarest first; a block can only meet a template if
it holds one of the template's first tokens in that order (prefix filter), if it has enough
tokens (length filter), and if enough tokens follow the first common one on both sides
(positional filter). The filters are applied to all words around such a token that can share a
block with it; in what passes, each block is counted exactly. Words outside all templates
cannot count, so the filters see template words only. DataFrame functions only.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINMENT = 0.8
# A template of fewer words must be met in order, as its words are too common apart.
ORDERED = 8
# Templates are handed to all tasks; larger sets belong in several scans.
MAX_TEMPLATE_WORDS = 20_000

# Fixed values of the contract: phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    # So few words that each of them is needed, in order.
    "bsd-2-clause": "BSD 2-Clause License",
    "bsd-3-clause": "BSD 3-Clause License",
    "bsd-short": "BSD License",
    "bsd-spdx": "SPDX-License-Identifier: BSD",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "gnu-short": "under the GNU GPL",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-short": "under the GPL",
    "isc-short": "ISC License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-short": "MIT License",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "mpl-short": "Mozilla Public License",
    "public-domain-notice": "This work has been released into the public domain",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _words(text: str) -> list[str]:
    return re.findall(_WORD + "+", text.lower())


def template(text: str, containment: float = CONTAINMENT) -> tuple[list[str], int, int, str | None]:
    """A template's distinct words, how many a block needs, how long a block is, and the order it must keep.

    The order is a pattern for the block's words joined by spaces; None where any order will do.
    """
    words = _words(text)
    sorts = list(dict.fromkeys(words))
    need = math.ceil(containment * len(sorts) - 1e-9)
    order = None
    if len(words) < ORDERED:
        each = [" (?:.* )?".join(c) for c in dict.fromkeys(itertools.combinations(sorts, need))]
        order = "(?s)(?:^| )(?:" + "|".join(each) + r")(?: |\z)"
    return sorts, need, len(words) + len(words) // 4, order


def any_of(sequences: list[list[str]]) -> str:
    """A pattern for any of the word sequences, ASCII case aside, at word boundaries."""
    firsts = "".join(sorted({s[0][0] for s in sequences}))
    each = "|".join(f"{_APART}+".join(s) for s in sorted(sequences, key=lambda s: (-len(s), s)))
    return f"(?i)(?=[{firsts}])(?<!{_WORD})(?:{each})(?!{_WORD})"


def _count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD + "+")).cast("bigint")


def document_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """How many documents hold each of the given words; one small row per word comes back."""
    words = F.array_intersect(F.lit(vocabulary), F.split(F.lower(F.col(f"`{text}`")), _APART + "+"))
    rows = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return {w: 0 for w in vocabulary} | {r.w: r.n for r in rows}


def match_templates(rows: DataFrame, ordered: list[str], templates: Mapping[str, tuple]) -> DataFrame:
    """``_key, label, containment`` of the templates (of ``_labels``) that a block within ``_words`` meets."""
    rank = {w: i for i, w in enumerate(ordered)}
    index = []
    for name, (words, need, long, order) in templates.items():
        words = sorted(words, key=rank.__getitem__)
        index += [(w, name, j, len(words), need, words, long, order) for j, w in enumerate(words[: len(words) - need + 1])]
    schema = "tok string, label string, j int, size int, need int, words array<string>, long int, order string"
    lookup = F.broadcast(rows.sparkSession.createDataFrame(index, schema))
    each = rows.withColumn("b", F.array_intersect(F.lit(ordered), "_words")).select("*", F.posexplode("b").alias("i", "tok"))
    held = F.size("b")
    passes = (
        F.array_contains("_labels", F.col("label"))
        & (held >= F.col("need"))
        & (F.col("i") <= held - F.col("need"))
        & (1 + F.least(held - F.col("i") - 1, F.col("size") - F.col("j") - 1) >= F.col("need"))
    )
    pairs = each.join(lookup, "tok").filter(passes).filter(F.size(F.array_intersect("b", "words")) >= F.col("need"))

    def common(start: Column) -> Column:
        block = F.slice("_words", start, F.col("long"))
        kept = F.col("order").isNull() | F.regexp_like(F.array_join(block, " "), F.col("order"))
        return F.when(kept, F.size(F.array_intersect("words", block))).otherwise(0)

    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - F.col("long") + 1, F.lit(1)))
    pairs = pairs.withColumn("common", F.array_max(F.transform(starts, common))).filter(F.col("common") >= F.col("need"))
    return pairs.select("_key", "label", (F.col("common") / F.col("size")).alias("containment"))


def surroundings(texts: DataFrame, hint: str, first: Mapping[str, list[str]], long: Mapping[str, int]) -> DataFrame:
    """``_key, _words, _labels``: the words around each of a template's ``first`` words.

    Blocks of ``long`` words that hold such a word lie within as many words on both sides of it.
    The words of a paragraph stay in one row; only the pieces around the hits leave it.
    """
    spans: dict[str, dict[int, list[str]]] = {}
    for name, words in first.items():
        for w in words:
            spans.setdefault(w, {}).setdefault(long[name], []).append(name)
    lookup = F.create_map(*[x for w, of in spans.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(names).alias("names")) for n, names in of.items()]))])
    runs = texts.select("_key", F.explode(F.split("_text", r"\n[ \t\r]*\n")).alias("_run")).filter(F.col("_run").rlike(hint))
    runs = runs.select("_key", F.regexp_extract_all(F.translate("_run", _UPPER, _LOWER), F.lit(f"({_WORD}+)")).alias("w"))
    hits = F.filter(F.transform("w", lambda x, i: F.when(x.isin(list(spans)), i + 1)), lambda i: i.isNotNull())

    def around(i: Column) -> Column:
        def piece(s: Column) -> Column:
            begin = F.greatest(i + 1 - s["n"], F.lit(1))
            return F.struct(F.slice("w", begin, i + s["n"] - begin).alias("words"), s["names"].alias("names"))

        return F.transform(F.element_at(lookup, F.element_at("w", i)), piece)

    each = runs.select("_key", F.explode(F.flatten(F.transform(hits, around))).alias("p"))
    return each.select("_key", F.col("p.words").alias("_words"), F.col("p.names").alias("_labels"))


def scan(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is 1 where a phrase is found, else the highest containment of a template that a
    block meets, else 0. Labels are distinct, sorted and joined by commas, "" for none. A null
    text is an empty one; repeated rows get equal results; other columns are not read; an
    empty table gives no rows.
    """
    known = {k: template(v, containment) for k, v in templates.items()}
    vocabulary = sorted({w for words, *_ in known.values() for w in words})
    if sum(len(words) for words, *_ in known.values()) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words for one scan")
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    counts = document_counts(base, vocabulary, "_text")
    ordered = sorted(vocabulary, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(ordered)}
    # Every block that meets a template holds one of the template's first tokens.
    first = {k: sorted(words, key=rank.__getitem__)[: len(words) - need + 1] for k, (words, need, *_) in known.items()}
    hint = any_of([[w] for w in sorted({w for s in first.values() for w in s})])
    key = F.struct("doc_id", F.xxhash64("_text").alias("h"))
    texts = base.filter(F.col("_text").rlike(hint)).select(key.alias("_key"), "_text")
    matches = match_templates(surroundings(texts, hint, first, {k: long for k, (_, _, long, _) in known.items()}), ordered, known)
    matches = matches.groupBy("_key").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    matches = matches.select(F.col("_key.doc_id").alias("_d"), F.col("_key.h").alias("_h"), "_more", "_best")

    text_col = F.col("_text")
    pattern = any_of([p.split() for p in phrases])
    label = lambda x: F.coalesce(*[F.when(_plain(x) == p, F.lit(v)) for p, v in phrases.items()])
    # Phrases are looked for once; only texts that hold one are looked at again.
    rows = base.withColumn("n_base", F.regexp_count("_text", F.lit(pattern)).cast("bigint")).withColumn("n_words", _count(text_col))
    found = F.when(F.col("n_base") > 0, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    parts = F.when(F.col("n_base") > 0, F.split("_text", pattern))
    rows = rows.select(
        "doc_id",
        "n_words",
        "n_base",
        F.xxhash64("_text").alias("_th"),
        _count(F.element_at(parts, 1)).alias("first_word"),
        (F.col("n_words") - _count(F.element_at(parts, -1)) - _count(F.element_at(found, -1))).alias("last_word"),
        F.coalesce(F.array_distinct(F.transform(found, label)), F.array().cast("array<string>")).alias("_base"),
    )
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h"))
    rows = rows.join(matches, on, "left")
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    every = F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                       joined(F.col("_base")).alias("base_labels"), joined(every).alias("labels"), score.alias("score"))


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, _UPPER, _LOWER), _APART + "+", " ")
