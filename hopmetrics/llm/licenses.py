"""License scan: text blocks that contain a license template almost whole.

Blocks are the lines, and, for notices wrapped over several lines, stretches of words that
begin at a line and go on over its end: ``SLACK`` times as many words as the template has.
Stretches are made of documents only that hold enough of the template's tokens at all.

Set-similarity join. A template's distinct tokens are put in the corpus' frequency order,
rarest first. A block that holds at least ``need`` = ceil(threshold * size) of them must
hold one of the first ``size - need + 1`` (the prefix). So blocks meet templates on prefix
tokens only; the length filter (block has at least ``need`` tokens) and the positional
filter (from the first token met on, the template has at least ``need`` left) thin out the
pairs, and the containment of those left is computed in full. Built-in functions only.

Beside it ``base_places`` finds fixed phrases, word by word.

Cases: a null text has no words, like an empty one. A template whose tokens occur nowhere
finds nothing. Rows with the same ``doc_id`` are scanned each on its own. Lines are whole
blocks, however long; blank ones do not part a stretch. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopmetrics.llm import common

THRESHOLD = 0.8
#: Words in a stretch over several lines, for each word of the template.
SLACK = 1.25

#: Phrases whose places count, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label and notice as published with each license.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: All ASCII that is neither a digit nor a letter.
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_IN_LINE = _BETWEEN.replace("\n", "")


def words_of(text: Column) -> Column:
    """The words, A-Z in lower case, each with a space on both sides."""
    # Line ends stay apart from words like all else that is no word.
    spaced = F.translate(text, common.UPPER + _BETWEEN, common.UPPER.lower() + " " * len(_BETWEEN))
    return F.regexp_replace(F.concat(F.lit(" "), F.trim(spaced), F.lit(" ")), " +", "  ")


def _count_spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def base_places(docs: DataFrame, phrases=BASE) -> DataFrame:
    """Of each row: doc, body (its key), doc_id, n_words, n_base, first_word, last_word, base_labels.

    A phrase must not overlap itself. ``base_labels`` is an array.
    """
    text = common.text_or_empty()
    # "  a  b  " with a space cut off at both ends: each word has its own two spaces.
    marked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        common.doc_key().alias("doc"),
        F.xxhash64(text).alias("body"),
        words_of(text).alias("m"),
    ).select("doc_id", "doc", "body", F.substring("m", F.lit(2), F.length("m") - 2).alias("m"))

    def pattern(phrase: str) -> str:
        return " " + "  ".join(phrase.split()) + " "

    counts = [
        ((F.length("m") - F.length(F.replace("m", F.lit(pattern(p))))) / len(pattern(p))).cast("long") for p, _ in phrases
    ]
    # Words before the first place; after the last place, from the end.
    first = [
        F.when(c > 0, (_count_spaces(F.substring_index("m", pattern(p), 1)) / 2).cast("long"))
        for (p, _), c in zip(phrases, counts, strict=True)
    ]
    last = [
        F.when(
            c > 0,
            ((_count_spaces(F.col("m")) - _count_spaces(F.substring_index("m", pattern(p), -1))) / 2).cast("long")
            - len(p.split()),
        )
        for (p, _), c in zip(phrases, counts, strict=True)
    ]
    named = [F.when(c > 0, F.lit(label)) for (_, label), c in zip(phrases, counts, strict=True)]
    return marked.select(
        "doc_id",
        "doc",
        "body",
        F.when(F.col("m") == "", F.lit(0)).otherwise(_count_spaces(F.col("m")) / 2).cast("long").alias("n_words"),
        reduce(Column.__add__, counts).alias("n_base"),
        F.least(*first).alias("first_word") if len(phrases) > 1 else first[0].alias("first_word"),
        F.greatest(*last).alias("last_word") if len(phrases) > 1 else last[0].alias("last_word"),
        F.array_compact(F.array(*named)).alias("base_labels"),
    )


def _tokens(line: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(words_of(line), " +")), "")


def stretch(template: str) -> int:
    """Words in a stretch for this template."""
    return math.ceil(len(template.split()) * SLACK - 1e-9)


def _template_tokens(spark: SparkSession, templates) -> DataFrame:
    """template, label, reach (words in a stretch for it), token: a row per distinct token of each template."""
    rows = F.array(
        *(
            F.struct(
                F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(stretch(text)).alias("reach"), F.lit(text).alias("text")
            )
            for i, (label, text) in enumerate(templates)
        )
    )
    return (
        spark.range(1)
        .select(F.inline(rows))
        .select("template", "label", "reach", F.explode(F.array_distinct(F.split("text", " "))).alias("token"))
    )


def _vocabulary(templates) -> list[str]:
    return sorted({token for _, text in templates for token in text.split()})


def frequencies(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """token, n: documents with each template token, over all documents."""
    wanted = F.array(*map(F.lit, _vocabulary(templates)))
    return (
        docs.select(F.explode(F.array_intersect(_tokens(common.text_or_empty()), wanted)).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )


def ordered_templates(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """template, label, reach, token, place (from 0, rarest first), size, need: a row per token."""
    by_rarity = Window.partitionBy("template").orderBy("n", "token")
    return (
        _template_tokens(docs.sparkSession, templates)
        .join(frequencies(docs, templates), "token", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumns(
            {
                "place": F.row_number().over(by_rarity) - 1,
                "size": F.count("*").over(Window.partitionBy("template")),
            }
        )
        .withColumn("need", F.ceil(F.col("size") * F.lit(threshold) - 1e-9).cast("int"))
    )


def _lines(texts: DataFrame) -> DataFrame:
    """doc, body, reach (0: for all templates), line (from 0), words (distinct) of each line."""
    lines = texts.select("doc", "body", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    return lines.select("doc", "body", F.lit(0).alias("reach"), "line", _tokens(F.col("words")).alias("words"))


def _stretches(texts: DataFrame, templates, threshold: float, wanted: Column) -> DataFrame:
    """The same of stretches: for templates with that ``reach``; ``line`` counts words and ends of lines."""
    vocabulary = F.array(*map(F.lit, _vocabulary(templates)))

    def once(**values: Column) -> Column:
        # What comes out of a generator is not worked out again for the filters above it.
        return F.inline(F.array(F.struct(*(value.alias(name) for name, value in values.items()))))

    def enough(template: str) -> Column:
        tokens = sorted(set(template.split()))
        needed = math.ceil(len(tokens) * threshold - 1e-9)
        return F.size(F.array_intersect("held", F.array(*map(F.lit, tokens)))) >= needed

    reaches = sorted({stretch(text) for _, text in templates})
    possible = [
        F.when(reduce(Column.__or__, (enough(text) for _, text in templates if stretch(text) == reach)), F.lit(reach))
        for reach in reaches
    ]
    # Words and, between lines with words, a line end each.
    plain = F.translate("text", common.UPPER + _IN_LINE, common.UPPER.lower() + " " * len(_IN_LINE))
    marked = F.regexp_replace(F.regexp_replace(plain, " +", " "), " ?\n[ \n]*", " \n ")
    at_start = F.filter(F.sequence(F.lit(0), F.size("marked") - 1), lambda at: (at == 0) | (F.get("marked", at) == "\n"))
    rows = (
        texts.filter(F.contains("text", F.lit("\n")))
        .select("doc", "body", "text", once(held=F.array_intersect(_tokens(F.col("text")), vocabulary)))
        .select("doc", "body", "text", once(reaches=F.array_compact(F.array(*possible))))
        .filter(F.size("reaches") > 0)
        .select("doc", "body", "reaches", once(marked=F.array_remove(F.split(marked, " +"), "")))
        .filter(F.size("marked") > 0)
        .select("doc", "body", "reaches", "marked", once(at_start=at_start))
        .select("doc", "body", "marked", "at_start", F.explode("reaches").alias("reach"))
    )

    def is_start(at: Column) -> Column:
        goes_on = F.array_contains(F.slice("marked", at + 2, F.col("reach")), "\n")
        return goes_on & F.arrays_overlap(within(at), wanted)

    def within(at: Column) -> Column:
        # At most a line end for each word, and the one that it begins with.
        some = F.array_remove(F.slice("marked", at + 1, 2 * F.col("reach") + 1), "\n")
        return F.slice(some, F.lit(1), F.col("reach"))

    starts = F.filter("at_start", is_start)
    found = F.transform(starts, lambda at: F.struct(at.alias("line"), F.array_distinct(within(at)).alias("words")))
    return rows.select("doc", "body", "reach", once(found=found)).select("doc", "body", "reach", F.inline("found"))


def blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc, body, reach, line, template, label, containment: a row per block and template met.

    ``reach`` is 0 for lines, and ``line`` their number from 0; else the words of the
    stretch, and its place among all words and line ends.
    """
    # A row per template token: as many as the templates have, however large the corpus.
    order = common.durable(ordered_templates(docs, templates, threshold).coalesce(1))
    prefix = order.filter(F.col("place") <= F.col("size") - F.col("need"))
    whole = order.groupBy("template", "label", "size", "need").agg(F.collect_list("token").alias("tokens"))
    # As many as the templates have at most; a block without any meets no template.
    first_tokens = [r.token for r in prefix.select("token").distinct().orderBy("token").collect()]
    if not first_tokens:
        first_tokens = [""]
    wanted = F.array(*map(F.lit, first_tokens))
    text = common.text_or_empty()
    texts = docs.select(common.doc_key().alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"))
    some = _lines(texts)
    if templates:
        some = some.unionByName(_stretches(texts, templates, threshold, wanted))
    met = (
        some.withColumn("met", F.array_intersect("words", wanted))
        .filter(F.size("met") > 0)
        .select("doc", "body", "reach", "line", "words", F.explode("met").alias("token"))
    )
    first = prefix.select("token", "template", F.col("reach").alias("of"), "place", "size", "need")
    pairs = (
        met.join(F.broadcast(first), "token")
        .filter((F.col("reach") == 0) | (F.col("reach") == F.col("of")))
        .filter((F.size("words") >= F.col("need")) & (F.col("size") - F.col("place") >= F.col("need")))
        .groupBy("doc", "body", "reach", "line", "template")
        .agg(F.min("place").alias("place"), F.first("words").alias("words"))
        # Nothing before the first token met on is in the block.
        .join(F.broadcast(whole), "template")
        .filter(F.col("size") - F.col("place") >= F.col("need"))
    )
    return (
        pairs.withColumn("shared", F.size(F.array_intersect("tokens", "words")))
        .filter(F.col("shared") >= F.col("need"))
        .select(
            "doc", "body", "reach", "line", "template", "label", (F.col("shared") / F.col("size")).alias("containment")
        )
    )


def scan(docs: DataFrame, templates=TEMPLATES, phrases=BASE, threshold: float = THRESHOLD) -> DataFrame:
    """Of each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``labels`` has the templates' labels beside the base ones; ``score`` is 1 with a base
    phrase, else the best containment found.
    """
    found = (
        blocks(docs, templates, threshold)
        .groupBy("doc", "body")
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    )
    none = F.array().cast("array<string>")
    return (
        base_places(docs, phrases)
        .join(found, ["doc", "body"], "left")
        .select(
            "doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            F.array_join(F.array_sort(F.array_distinct("base_labels")), ",").alias("base_labels"),
            F.array_join(
                F.array_sort(F.array_union("base_labels", F.coalesce("more", none))), ","
            ).alias("labels"),
            F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"({i}, '{label}', '{text}', {stretch(text)})" for i, (label, text) in enumerate(TEMPLATES))
_PHRASES = ", ".join(f"('{phrase}', '{label}')" for phrase, label in BASE)

#: Containment of every template in every line, and in the words from every line's start on;
#: and every word place, without filters.
ORACLE = f"""
WITH templates AS (
    SELECT id, label, reach, list_distinct(string_split(text, ' ')) AS tokens
    FROM (VALUES {_VALUES}) t(id, label, text, reach)
), phrases AS (
    SELECT string_split(phrase, ' ') AS parts, label FROM (VALUES {_PHRASES}) p(phrase, label)
), docs AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
    FROM documents
), worded AS (
    SELECT doc_id, regexp_extract_all(low, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM docs
), places AS (
    SELECT doc_id, label, i - 1 AS place
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM worded), phrases
    WHERE w[i] = parts[1] AND w[i:i + len(parts) - 1] = parts
), base AS (
    SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
           list_sort(list(DISTINCT label)) AS base_labels
    FROM places GROUP BY doc_id
), lines AS (
    SELECT doc_id, i, regexp_extract_all(line, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS line,
                 generate_subscripts(string_split(low, chr(10)), 1) AS i FROM docs)
), starts AS (
    SELECT doc_id, (sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) - len(w))::BIGINT AS place FROM lines
), met AS (
    SELECT doc_id, label, len(list_intersect(list_distinct(w), tokens)) / len(tokens) AS containment FROM lines, templates
    UNION ALL
    SELECT doc_id, label, len(list_intersect(list_distinct(w[place + 1:place + reach]), tokens)) / len(tokens)
    FROM starts JOIN worded USING (doc_id), templates
), found AS (
    SELECT doc_id, list(DISTINCT label) AS more, max(containment) AS best
    FROM met WHERE containment >= {THRESHOLD} - 1e-9 GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base_labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(more, [])))), ',')
           AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM worded LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""
