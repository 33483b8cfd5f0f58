"""License scans by diagonal voting, DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The phrases of the base labels.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Public license notices, the words that identify each.
NOTICES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

K = 5           # words of one gram of a notice; a shorter template is one gram
DRIFT = 3       # diagonals of one notice at most this far apart belong to one copy with words put in or left out
SHARE = 60      # percent of a template's words that a copy must hold
BLOCK = 1024    # words exploded at a time, so that no row holds shifted copies of a whole text


def words_of(text: Column) -> Column:
    """Words as an array, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), "")


def _plain(text: str) -> list[str]:
    return [w for w in re.split(GAPS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_rows(templates: list[tuple[str, str]], phrases: int) -> list[tuple]:
    """``(template, label, phrase, n_words, k, position, words of the gram)`` of each gram; the first ``phrases`` are base."""
    out = []
    for n, (label, text) in enumerate(templates):
        words = _plain(text)
        if len(words) < 2:
            raise ValueError(f"a template needs two words: {text!r}")
        k = min(K, len(words))
        out += [(n, label, n < phrases, len(words), k, at, words[at:at + k]) for at in range(len(words) - k + 1)]
    return out


def gram_hash(words: list[Column], k: int) -> Column:
    return F.xxhash64(*words[:k])


def template_grams(spark: SparkSession, rows: list[tuple], widths: list[int]) -> DataFrame:
    """Grams with the hash of their first two words, which places them, and of all of them."""
    schema = "t int, label string, phrase boolean, m int, k int, q int, gram array<string>"
    grams = spark.createDataFrame(rows, schema)
    word = [F.get("gram", F.lit(i)) for i in range(max(widths))]
    whole = F.coalesce(*[F.when(F.col("k") == k, gram_hash(word, k)) for k in widths])
    return grams.select("t", "k", "q", gram_hash(word, 2).alias("_pair"), whole.alias("_whole"), "gram")


def _grams(rows: DataFrame, width: int) -> DataFrame:
    """``(_key, p, w0, w1, ...)``: every word position of every text with the words that follow, null beyond the end."""
    blocks = rows.select("_key", words_of(F.col("_text")).alias("_words")).where(F.size("_words") > 1).select(
        "_key", F.explode(F.transform(
            F.sequence(F.lit(0), F.size("_words") - 1, F.lit(BLOCK)),
            lambda at: F.struct(at.alias("at"), F.slice("_words", at + 1, BLOCK + width - 1).alias("words")))).alias("_block"))
    shifted = [F.slice("_block.words", i + 1, BLOCK).alias(f"w{i}") for i in range(width)]
    return blocks.select("_key", "_block.at", F.posexplode(F.arrays_zip(*shifted)).alias("_pos", "_w")).select(
        "_key", (F.col("at") + F.col("_pos")).alias("p"), *[F.col(f"_w.w{i}").alias(f"w{i}") for i in range(width)])


def found_grams(rows: DataFrame, grams: DataFrame, widths: list[int]) -> DataFrame:
    """``(_key, t, k, p, q)``: word position p of a text starts the gram at position q of template t.

    All word positions meet the template grams in a broadcast join on the hash of two words; a gram counts when the
    hash of all its words and then the words themselves agree. Templates are a parameter, so their grams are few.
    """
    width = max(widths)
    word = [F.col(f"w{i}") for i in range(width)]
    here = F.coalesce(*[F.when(F.col("k") == k, gram_hash(word, k)) for k in widths])
    same = F.slice(F.array(*word), 1, F.col("k")) == F.col("gram")
    return (
        _grams(rows, width).where("w1 IS NOT NULL").withColumn("_pair", gram_hash(word, 2))
        .join(F.broadcast(grams), "_pair").where((here == F.col("_whole")) & same)
        .select("_key", "t", "k", "p", "q")
    )


def license_spans(
    rows: DataFrame, templates: list[tuple[str, str]], phrases: int, drift: int = DRIFT, share: int = SHARE,
) -> DataFrame:
    """``(_key, t, label, phrase, first, last, covered, m)``: verified copies of templates in ``rows(_key, _text)``.

    Grams vote for the diagonal p - q of (text, template); the diagonals of a notice not further apart than ``drift``
    are one copy, which needs ``share`` percent of the template's words under its grams. A phrase is a single gram,
    so each place of it is a copy of its own. ``first`` and ``last`` are word positions in the text.
    """
    spark = rows.sparkSession
    made = template_rows(templates, phrases)
    widths = sorted({r[4] for r in made})
    about = spark.createDataFrame(sorted({r[:4] for r in made}), "t int, label string, phrase boolean, m int")
    hits = found_grams(rows, template_grams(spark, made, widths), widths)
    votes = hits.groupBy("_key", "t", (F.col("p") - F.col("q")).alias("_diagonal"), "k").agg(
        F.min("p").alias("first"), F.max(F.col("p") + F.col("k") - 1).alias("last"), F.collect_set("q").alias("_at"))
    in_text = Window.partitionBy("_key", "t").orderBy("_diagonal")
    step = F.col("_diagonal") - F.lag("_diagonal").over(in_text)
    far = F.when(F.col("phrase") | (F.coalesce(step, F.lit(drift + 1)) > drift), 1).otherwise(0)
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        F.flatten(F.collect_list("_at")), lambda q: F.sequence(q, q + F.max("k") - 1)))))
    return (
        votes.join(F.broadcast(about), "t").withColumn("_far", far).withColumn("_copy", F.sum("_far").over(in_text))
        .groupBy("_key", "t", "label", "phrase", "m", "_copy")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), covered.alias("covered"))
        .where(F.col("covered") * 100 >= F.col("m") * share).drop("_copy")
    )


def license_scan(
    docs: DataFrame, notices: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row per input row.

    ``score`` is the largest share of a phrase's or notice's words that a copy in the text holds; without one it is 0 and
    the labels are empty texts. A null text is empty. Rows repeated with one id, also a null one, each get the answer for
    their own text; no rows give no rows; other columns are ignored. Texts of any length are cut into overlapping blocks
    of words after the split, so a long one is never held in more than a few copies. Groups are those of one text.
    """
    notices = NOTICES if notices is None else notices
    name = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.unhex(F.md5(name)).alias("_key"))
    spans = license_spans(rows, PHRASES + notices, len(PHRASES))
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    told = spans.groupBy("_key").agg(
        F.count_if("phrase").alias("n_base"), F.min(F.when(F.col("phrase"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first"))).alias("last_word"),
        joined(F.collect_set(F.when(F.col("phrase"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"), F.max(F.col("covered") / F.col("m")).alias("score"))
    sizes = rows.select("doc_id", "_key", F.size(words_of(F.col("_text"))).cast("long").alias("n_words"))
    return sizes.join(told, "_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def _sql() -> str:
    """The same over ``documents`` in DuckDB: word lists instead of hashes, one row per (text position, gram)."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    values = ", ".join(
        f"({t}, '{label}', {str(phrase).lower()}, {m}, {k}, {q}, {quoted(gram)})"
        for t, label, phrase, m, k, q, gram in template_rows(PHRASES + NOTICES, len(PHRASES)))
    return rf"""
WITH g(t, label, phrase, m, k, q, gram) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAPS}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, w, unnest(range(len(w))) AS p FROM d),
h AS (SELECT r, t, label, phrase, m, k, p, q FROM p JOIN g ON w[p + 1] = gram[1] AND w[p + 2] = gram[2]
  WHERE w[p + 1:p + k] = gram),
v AS (SELECT r, t, label, phrase, m, k, p - q AS diagonal, min(p) AS a, max(p) AS b, list(q) AS qs FROM h GROUP BY ALL),
s AS (SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER w, {DRIFT + 1}) > {DRIFT} THEN 1 ELSE 0 END AS far
  FROM v WINDOW w AS (PARTITION BY r, t ORDER BY diagonal)),
c AS (SELECT *, sum(far) OVER (PARTITION BY r, t ORDER BY diagonal) AS copy FROM s),
f AS (SELECT r, t, label, phrase, m, min(a) AS a, len(list_distinct(flatten(list(flatten(
  list_transform(qs, lambda x: range(x, x + k))))))) AS covered FROM c GROUP BY r, t, label, phrase, m, copy),
o AS (SELECT r, count(*) FILTER (phrase) AS n_base, min(a) FILTER (phrase) AS first_word, max(a) FILTER (phrase) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered / m) AS score
  FROM f WHERE covered * 100 >= m * {SHARE} GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN o USING (r)
"""


SQL = _sql()
