"""License scans by diagonal voting, in DataFrame operations alone.

Every word k-gram of every text is joined with the k-grams of the templates (a small fixed table) on two hashes. A match
votes for its diagonal, the position in the text less the position in the template, and votes are summed by diagonal.
Neighbouring diagonals (words put in or left out shift a template along) merge into one span, which counts if its k-grams
cover enough of the template's words: all of a license's name, most of a notice. A base phrase must stand on one diagonal, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
COVERAGE = 0.75
#: Diagonals belong to one span if they differ by DIAGONALS at most, or by GAP of the template's words: so many words may be
#: put in, or left out, at one place.
DIAGONALS, GAP = 3, 0.5

# Base phrases with their labels; names of licenses, which must stand whole (their last word tells them apart);
# customary notices, of which COVERAGE is enough.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NAMES = [
    ("mit", "released under the mit license"), ("mit", "spdx license identifier mit"), ("apache-2", "licensed under the apache license version 2 0"), ("apache-2", "apache license 2 0"), ("apache-2", "spdx license identifier apache 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"), ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"), ("cc-by-sa", "licensed under cc by sa"), ("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-sa", "spdx license identifier cc by sa 4 0"), ("cc-by", "creative commons attribution 4 0 international"), ("cc-by", "spdx license identifier cc by 4 0"), ("cc0", "cc0 1 0 universal"), ("cc0", "spdx license identifier cc0 1 0"),
    ("gpl-3", "gnu general public license version 3"), ("gpl-3", "gnu general public license v3 0"), ("gpl-3", "spdx license identifier gpl 3 0"), ("gpl-2", "gnu general public license version 2"), ("gpl-2", "gnu general public license v2 0"),
    ("gpl-2", "spdx license identifier gpl 2 0"), ("lgpl-3", "gnu lesser general public license version 3"), ("lgpl-3", "gnu lesser general public license v3 0"), ("lgpl-2.1", "gnu lesser general public license version 2 1"),
    ("lgpl-2.1", "gnu lesser general public license v2 1"), ("lgpl-2.1", "spdx license identifier lgpl 2 1"), ("agpl-3", "gnu affero general public license version 3"), ("agpl-3", "gnu affero general public license v3 0"), ("agpl-3", "spdx license identifier agpl 3 0"),
    ("bsd-2", "bsd 2 clause license"), ("bsd-2", "spdx license identifier bsd 2 clause"), ("bsd-3", "bsd 3 clause license"), ("bsd-3", "spdx license identifier bsd 3 clause"), ("isc", "spdx license identifier isc"), ("mpl-2", "mozilla public license version 2 0"),
    ("mpl-2", "mozilla public license v 2 0"), ("mpl-2", "spdx license identifier mpl 2 0"), ("unlicense", "spdx license identifier unlicense"), ("all-rights-reserved", "all rights reserved"),
]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """Runs of 0-9, a-z and characters beyond ASCII, after A-Z became a-z."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def template_list() -> list[tuple[str, str, bool, float]]:
    """``label, text, base, least``: the share of its words that a span has to cover."""
    return [(v, k, True, 1.0) for k, v in PHRASES.items()] + [(a, b, False, 1.0) for a, b in NAMES] + [(a, b, False, COVERAGE) for a, b in NOTICES]


def template_rows() -> list[tuple]:
    """``template, at, n_words, label, base, least, gap, w0, w1, w2``: a row per k-gram of a template; some hundred, fixed."""
    rows = []
    for number, (label, text, base, least) in enumerate(template_list()):
        w = text.split()
        rows += [(number, at, len(w), label, base, least, max(DIAGONALS, int(GAP * len(w))), *w[at : at + K]) for at in range(len(w) - K + 1)]
    return rows


def templates(spark: SparkSession) -> DataFrame:
    table = spark.createDataFrame(template_rows(), "template int, at int, template_words int, label string, base boolean, least double, gap int, w0 string, w1 string, w2 string")
    return table.select("template", "at", "template_words", "label", "base", "least", "gap", F.xxhash64("w0", "w1", "w2").alias("h"), F.hash("w0", "w1", "w2").alias("g"))


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``, one row per input row.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are their smallest and largest start
    (null without any). ``score`` is the largest share of a template's words that one span covers (0 without a match);
    ``labels`` joins labels of spans that cover enough of their template to the base labels; ``spans`` lists those (label, first
    word, words, share). Null and empty texts have no words. Null ids pass through; rows that repeat are each returned.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("words"))
    gram = lambda i: (F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    grams = F.when(F.size("words") >= K, F.transform(F.sequence(F.lit(0), F.size("words") - K), lambda i: F.struct(F.xxhash64(*gram(i)).alias("h"), F.hash(*gram(i)).alias("g"))))
    posted = keyed.select("doc_id", "key", F.posexplode(grams).alias("pos", "gram")).select("doc_id", "key", "pos", "gram.h", "gram.g")
    text, kind = ["doc_id", "key"], ["template", "template_words", "label", "base", "least", "gap"]
    votes = posted.join(F.broadcast(templates(docs.sparkSession)), ["h", "g"]).select(*text, *kind, "pos", "at").distinct()

    covers = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda at: F.sequence(at, at + K - 1))))
    by_diagonal = votes.groupBy(*text, *kind, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_list("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy(*text, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > F.col("gap")), F.lit(True))
    merged = by_diagonal.withColumn("apart", apart).withColumn("span", F.sum(F.col("apart").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*text, *kind, "span").agg(F.size(covers(F.flatten(F.collect_list("ats")))).alias("held"), F.min("first").alias("first"), (F.max("last") - F.min("first") + K).alias("length"))
    spans = spans.withColumn("share", F.col("held") / F.col("template_words"))
    spans = spans.withColumn("whole", F.col("base") & (F.col("held") == F.col("template_words"))).withColumn("found", ~F.col("base") & (F.col("share") >= F.col("least")))
    by_doc = spans.groupBy(*text).agg(
        F.count_if("whole").alias("n_base"),
        F.min(F.when(F.col("whole"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("whole"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("whole") | F.col("found"), F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("label", "first", "length", "share")))).alias("spans"),
    )
    counted = keyed.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), F.size("words").cast("long").alias("n_words"))
    joined = counted.join(by_doc, counted["id"].eqNullSafe(by_doc["doc_id"]) & (counted["k"] == by_doc["key"]), "left")
    none = F.array().cast("array<struct<label:string,first:int,length:int,share:double>>")
    return joined.select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", none).alias("spans"),
    )


def span_digest(spans: Column) -> Column:
    """Spans as text: label@first word+words, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["label"], F.lit("@"), s["first"].cast("string"), F.lit("+"), s["length"].cast("string"))), ",")


_TEMPLATES = ", ".join(f"({t}, {at}, {n}, '{label}', {str(base).lower()}, {least}::DOUBLE, {gap}, '{w0}', '{w1}', '{w2}')" for t, at, n, label, base, least, gap, w0, w1, w2 in template_rows())
#: DuckDB SQL for license_scan (spans as span_digest) with the production parameters.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
t(template, place, template_words, label, base, least, gap, w0, w1, w2) AS (VALUES {_TEMPLATES}),
p AS (SELECT r, w, unnest(range(len(w))) AS pos FROM d),
g AS (SELECT r, pos, w[pos + 1] AS w0, w[pos + 2] AS w1, w[pos + 3] AS w2 FROM p),
v AS (SELECT r, template, template_words, label, base, least, gap, pos, place, pos - place AS diagonal FROM g JOIN t USING (w0, w1, w2)),
y AS (SELECT r, template, template_words, label, base, least, gap, diagonal, list(place) AS ats, min(pos) AS first, max(pos) AS last FROM v GROUP BY ALL),
a AS (SELECT *, coalesce(base OR diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > gap, true)::INT AS apart FROM y),
m AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM a),
c AS (SELECT r, template, template_words, label, base, least, span, min(first) AS first, max(last) - min(first) + {K} AS length,
      len(list_distinct(flatten([[x, x + 1, x + 2] FOR x IN flatten(list(ats))]))) AS held FROM m GROUP BY r, template, template_words, label, base, least, span),
s AS (SELECT *, held / template_words AS share, base AND held = template_words AS whole, NOT base AND held / template_words >= least AS found FROM c),
b AS (SELECT r, count(*) FILTER (whole) AS n_base, min(first) FILTER (whole) AS first_word, max(first) FILTER (whole) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole OR found) AS labels, max(share) AS score, string_agg(label || '@' || first || '+' || length, ',' ORDER BY label, first, length, share) FILTER (found) AS spans FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
 coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score, coalesce(spans, '') AS spans FROM d LEFT JOIN b USING (r)
"""
