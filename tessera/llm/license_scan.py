"""Licence scan by diagonal voting (operator 13, native).

All rolling word k-grams of every document are joined by hash with the positions
of the licence templates that hold the same words (the join compares the words
too). A match at document word ``pos`` and template word ``at`` lies on the
diagonal ``pos - at``: the words of one occurrence share a diagonal, and an
inserted or missing word moves the rest to a neighbouring one. Matches are counted
per (document, template, diagonal), neighbouring diagonals are merged to spans, and
a span is verified by the share of words that it and its template have in common.
Of spans that overlap, the most alike stay.

Beside that stand the base phrases: places where the words of a phrase follow each
other.

All steps are DataFrame functions; only documents with a match go beyond the first
join, and the templates are broadcast while their number of positions, which the
driver knows, is small.

Defined cases: a null text has no words; a document without any label has empty
label strings, null places and score 0; a base phrase has score 1; rows that repeat
both doc_id and text get the same result each; a null doc_id is an id like any
other; extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_UPPER, ascii_lower, checkpointed

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
GAP = 4               # diagonals that differ by no more are neighbours
MIN_LIKENESS = 0.8    # share of common words from which a span is a licence text
BROADCAST = 1_000_000  # template positions that are broadcast

#: Fixed values of the base rule: phrase, label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Licence statements and the distinctive sentences of public licence texts.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "dedicated to the public domain under the Creative Commons Zero license"),
)
_LOWER = str.maketrans(ASCII_UPPER, ASCII_UPPER.lower())
KEY = ["doc_id", "version"]


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(_LOWER))


def template_grams(templates: Sequence[tuple[str, str]], k: int) -> list[tuple[int, str, int, int, list[str]]]:
    """(template, label, words of the template, position, the k words there)."""
    out = []
    for t, (label, text) in enumerate(templates):
        w = template_words(text)
        if len(w) < k:
            raise ValueError(f"template {t} has fewer than {k} words")
        out += [(t, label, len(w), i, w[i:i + k]) for i in range(len(w) - k + 1)]
    return out


def word_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version (hash of the text), words of the lower-cased text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("version"), ascii_lower(text).alias("low"))
    return rows.select("doc_id", "version", "low", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)).alias("words"))


def gram_matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = K, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, version, template, label, t_words, at, pos): every k-gram of a
    document that stands in a template, once per place in both."""
    words = word_rows(docs, id_col, text_col).select(*KEY, "words")
    n = F.greatest(F.size("words") - (k - 1), F.lit(0))
    grams = words.select(*KEY, F.posexplode(F.arrays_zip(*[F.slice("words", i + 1, n).alias(f"w{i}") for i in range(k)])).alias("pos", "g"))
    own = [F.col(f"g.w{i}") for i in range(k)]
    grams = grams.select(*KEY, "pos", *[c.alias(f"w{i}") for i, c in enumerate(own)], F.xxhash64(*own).alias("h"))
    rows = template_grams(templates, k)
    table = docs.sparkSession.createDataFrame([(t, label, n_, i, w) for t, label, n_, i, w in rows],
                                              "template int, label string, t_words int, at int, t array<string>")
    table = table.select("*", F.xxhash64(*[F.get("t", i) for i in range(k)]).alias("th"))
    if len(rows) <= BROADCAST:
        table = F.broadcast(table)
    same = F.col("h") == F.col("th")
    for i in range(k):
        same &= F.col(f"w{i}") == F.get("t", i)
    return grams.join(table, same).select(*KEY, "template", "label", "t_words", "at", "pos").distinct()


def licence_spans(matches: DataFrame, k: int = K, gap: int = GAP, min_likeness: float = MIN_LIKENESS) -> DataFrame:
    """(doc_id, version, template, label, first, n_words, common, likeness) of the
    verified spans; ``matches`` is read more than once."""
    key = [*KEY, "template"]
    voted = matches.withColumn("diagonal", F.col("pos") - F.col("at"))
    lines = voted.groupBy(*key, "label", "t_words", "diagonal").agg(
        F.count("*").alias("votes"), F.min("pos").alias("lo"), (F.max("pos") + k).alias("hi"))
    along = Window.partitionBy(*key).orderBy("diagonal")
    begins = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > gap, F.lit(True))
    lines = lines.withColumn("begins", begins).withColumn("span", F.sum(F.col("begins").cast("int")).over(
        along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = lines.groupBy(*key, "label", "t_words", "span").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # too few votes to reach the likeness even if every match covered k words of its own
    spans = spans.where(F.col("votes") * k >= min_likeness * F.col("t_words"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["doc_id"].eqNullSafe(b["b_id"]) & (a["version"] == b["b_version"]) & (a["template"] == b["b_template"])

    own = lines.select(F.col("doc_id").alias("b_id"), F.col("version").alias("b_version"), F.col("template").alias("b_template"),
                       F.col("diagonal").alias("b_diagonal"), "span")
    placed = voted.join(own, same(voted, own) & (F.col("diagonal") == F.col("b_diagonal"))).select(*key, "span", "at").distinct()
    after = F.lead("at").over(Window.partitionBy(*key, "span").orderBy("at"))
    common = placed.withColumn("new", F.least(F.lit(k), F.coalesce(after - F.col("at"), F.lit(k)))).groupBy(
        F.col("doc_id").alias("b_id"), F.col("version").alias("b_version"), F.col("template").alias("b_template"),
        F.col("span").alias("b_span")).agg(F.sum("new").alias("common"))
    alike = F.col("common") / F.greatest(F.col("t_words"), F.col("hi") - F.col("lo"))
    good = spans.join(common, same(spans, common) & (F.col("span") == F.col("b_span"))).withColumn("likeness", alike).where(
        F.col("likeness") >= min_likeness)
    # spans that overlap, one after the other, are one place; the most alike stay
    reach = F.max("hi").over(Window.partitionBy(*KEY).orderBy("lo", "hi", "template", "span").rowsBetween(Window.unboundedPreceding, -1))
    good = good.withColumn("reach", reach).withColumn("apart", F.coalesce(F.col("reach") <= F.col("lo"), F.lit(True)))
    place = F.sum(F.col("apart").cast("int")).over(
        Window.partitionBy(*KEY).orderBy("lo", "hi", "template", "span").rowsBetween(Window.unboundedPreceding, 0))
    best = F.rank().over(Window.partitionBy(*KEY, "place").orderBy(F.desc("likeness"), F.desc("common")))
    return good.withColumn("place", place).withColumn("best", best).where("best = 1").select(
        *KEY, "template", "label", F.col("lo").cast("long").alias("first"), (F.col("hi") - F.col("lo")).cast("long").alias("n_words"),
        F.col("common").cast("long").alias("common"), "likeness")


def base_rows(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version, n_words, places (array of starts), base (array of labels)."""
    rows = word_rows(docs, id_col, text_col)
    parts = [(p.split(" "), label) for p, label in phrases]

    def stands(i: Column, ws: list[str]) -> Column:
        hit = F.get("words", i) == ws[0]
        for j, w in enumerate(ws[1:], 1):
            hit &= F.coalesce(F.get("words", i + j) == w, F.lit(False))
        return hit

    # few texts hold all words of a phrase; only these are searched word by word
    def may(ws: list[str]) -> Column:
        hit = F.lit(True)
        for w in ws:
            hit &= F.col("low").contains(w)
        return hit

    def starts(ws: list[str]) -> Column:
        every = F.sequence(F.lit(0), F.size("words") - 1)
        return F.when(may(ws) & (F.size("words") > 0), F.filter(every, lambda i: stands(i, ws))).otherwise(F.array().cast("array<int>"))

    found = rows.select(*KEY, F.size("words").cast("long").alias("n_words"), *[starts(ws).alias(f"p{n}") for n, (ws, _) in enumerate(parts)])
    labels = [F.when(F.size(f"p{n}") > 0, F.lit(label)) for n, (_, label) in enumerate(parts)]
    return found.select(*KEY, "n_words", F.concat(*[f"p{n}" for n in range(len(parts))]).alias("places"),
                        F.array_distinct(F.array_compact(F.array(*labels))).alias("base"))


def licence_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES,
                 k: int = K, gap: int = GAP, min_likeness: float = MIN_LIKENESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of ``docs``."""
    spans = licence_spans(checkpointed(gram_matches(docs, templates, k, id_col, text_col)), k, gap, min_likeness)
    found = spans.groupBy(F.col("doc_id").alias("f_id"), F.col("version").alias("f_version")).agg(
        F.collect_set("label").alias("added"), F.max("likeness").alias("likeness"))
    rows = base_rows(docs, phrases, id_col, text_col).join(
        found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("version") == F.col("f_version")), "left")
    none = F.array().cast("array<string>")

    def joined(c: Column) -> Column:
        return F.array_join(F.array_sort(c), ",")

    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"), joined(F.col("base")).alias("base_labels"),
        joined(F.array_union("base", F.coalesce("added", none))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("likeness", F.lit(0.0))).alias("score"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({t}, {quote(label)}, {n}, {i}, {', '.join(map(quote, w))})" for t, label, n, i, w in template_grams(TEMPLATES, K))
    bases = " UNION ALL ".join(
        f"SELECT doc_id, pos, {quote(label)} AS label FROM g WHERE " + " AND ".join(f"w{i} = {quote(w)}" for i, w in enumerate(p.split(" ")))
        for p, label in PHRASES)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'),
                  '{WORD}') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w0, generate_subscripts(ws, 1) - 1 AS pos FROM d),
g AS (SELECT doc_id, pos, w0, lead(w0) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
t(template, label, t_words, spot, t0, t1, t2) AS (VALUES {values}),
m AS (SELECT doc_id, template, label, t_words, spot, pos, pos - spot AS diagonal FROM g JOIN t ON w0 = t0 AND w1 = t1 AND w2 = t2),
l AS (SELECT doc_id, template, label, t_words, diagonal, min(pos) AS lo, max(pos) + {K} AS hi FROM m GROUP BY ALL),
b AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER o > {GAP}, true) AS begins FROM l
      WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM b),
e AS (SELECT doc_id, template, label, t_words, span, min(lo) AS lo, max(hi) AS hi FROM s GROUP BY ALL),
p AS (SELECT DISTINCT m.doc_id, m.template, span, spot FROM m JOIN s USING (doc_id, template, diagonal)),
c AS (SELECT doc_id, template, span, sum(new) AS common FROM (
        SELECT *, least({K}, coalesce(lead(spot) OVER (PARTITION BY doc_id, template, span ORDER BY spot) - spot, {K})) AS new FROM p) GROUP BY ALL),
a AS (SELECT *, CAST(common AS DOUBLE) / greatest(t_words, hi - lo) AS likeness FROM e JOIN c USING (doc_id, template, span)),
v AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi, template, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= lo, true) AS apart
      FROM a WHERE likeness >= {MIN_LIKENESS}),
x AS (SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY doc_id ORDER BY lo, hi, template, span ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM v),
r AS (SELECT *, rank() OVER (PARTITION BY doc_id, place ORDER BY likeness DESC, common DESC) AS best FROM x),
f AS (SELECT doc_id, max(likeness) AS likeness FROM r WHERE best = 1 GROUP BY doc_id),
h AS ({bases}),
n AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT doc_id, label FROM h UNION SELECT doc_id, label FROM r WHERE best = 1) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(likeness, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN f USING (doc_id)
"""


ORACLE = _oracle()
