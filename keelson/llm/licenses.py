"""License scans by diagonal voting.

Every rolling k-gram hash of a document is joined to the places of the same k-gram in the templates.
A hit votes for the diagonal (document place - template place); votes of a diagonal are summed, runs
of neighbouring diagonals are merged, and the spans they cover are verified against the template: its k-grams must
stand in the template's order, in a span that is not much longer than the template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, sliding, small, words

# Phrases that name a license, and passages of license texts and notices.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
TEXTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

PHRASE_GRAM, TEXT_GRAM = 2, 4
#: Diagonals this near are one match with words put in or left out.
BAND = 3
#: Part of a passage's k-grams that a verified span holds in order, and its length at most, as a multiple of theirs.
COVERAGE, STRETCH = 0.6, 2


def templates(spark: SparkSession, phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """template, label, kind (0 phrase, 1 passage), n_grams, and for each gram its place and words.

    A phrase's grams have two words, a passage's four; the table is as large as the templates."""
    rows = []
    for t, (kind, label, text) in enumerate([(0, label, p) for p, label in phrases] + [(1, label, x) for label, x in texts]):
        rows.append((t, kind, label, text))
    df = spark.createDataFrame(rows, "template int, kind int, label string, text string").withColumn("w", words(F.col("text")))
    df = df.withColumn("grams", F.when(F.col("kind") == 0, _grams(F.col("w"), PHRASE_GRAM)).otherwise(_grams(F.col("w"), TEXT_GRAM)))
    df = df.withColumn("n_grams", F.size("grams"))
    k = F.when(F.col("kind") == 0, PHRASE_GRAM).otherwise(TEXT_GRAM)
    return df.select("template", "kind", "label", "n_grams", "w", k.alias("k"), F.posexplode("grams").alias("place", "h")).select(
        "template", "kind", "label", "n_grams", "place", "h", F.expr("slice(w, place + 1, k)").alias("gram")
    )


def _grams(w, k: int):
    return sliding(w, k, lambda *x: F.xxhash64(F.lit(k), *x))


#: A hash that every document has once more, so that documents without hits keep a row.
SELF = -1


def hits(docs: DataFrame, grams: DataFrame, n_grams: int) -> DataFrame:
    """Of docs(row, doc_id, w): row, doc_id, n_words, template, kind, label, n_grams, place, at for each
    gram of a document that a template has, compared as words after the join by hash; and a row of
    kind -1 for each document."""
    grams = grams.union(grams.sparkSession.createDataFrame([(-1, -1, "", 0, 0, SELF, None)], grams.schema))
    hs = F.concat(_grams(F.col("w"), PHRASE_GRAM), _grams(F.col("w"), TEXT_GRAM), F.array(F.lit(SELF).cast("long")))
    rows = docs.select("row", "doc_id", "w", hs.alias("hs"))
    rows = rows.select("row", "doc_id", "w", F.posexplode_outer("hs").alias("i", "h")).join(small(grams, n_grams + 1), "h")
    first = F.greatest(F.size("w") - F.lit(PHRASE_GRAM - 1), F.lit(0))  # grams of two words, then of four
    rows = rows.withColumn("at", F.when(F.col("kind") == 1, F.col("i") - first).otherwise(F.col("i")))
    real = (F.col("at") >= 0) & (F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, F.greatest(F.size("gram"), F.lit(0))) == F.col("gram"))
    own = (F.col("kind") == -1) & (F.col("i") == first + F.greatest(F.size("w") - F.lit(TEXT_GRAM - 1), F.lit(0)))
    return rows.where(F.coalesce(real, F.lit(False)) | own).select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "template", "kind", "label", "n_grams", "place", "at")


def spans(found: DataFrame, band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """row, kind, label, first, last (grams' places in the document), part: verified matches.

    part is the share of the template's grams that the merged diagonals hold in the template's order; a
    phrase needs all of them on one diagonal."""
    diagonal = found.withColumn("diagonal", F.col("at") - F.col("place"))
    votes = diagonal.groupBy("row", "kind", "template", "label", "n_grams", "diagonal").agg(
        F.count_distinct("place").alias("votes"), F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    phrases = votes.where((F.col("kind") == 0) & (F.col("votes") == F.col("n_grams"))).select("row", "kind", "label", F.col("diagonal").alias("first"), F.col("diagonal").alias("last"), F.lit(1.0).alias("part"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    runs = votes.where("kind = 1").withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= band, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(order))
    # each gram of the template once, at its first place in the run's span
    grams = runs.select("row", "kind", "template", "label", "n_grams", "run", "diagonal", F.explode("places").alias("place"))
    grams = grams.groupBy("row", "kind", "template", "label", "n_grams", "run", "place").agg(F.min(F.col("diagonal") + F.col("place")).alias("at"))
    along = Window.partitionBy("row", "template", "run").orderBy("place")
    grams = grams.withColumn("held", F.when(F.coalesce(F.col("at") > F.lag("at").over(along), F.lit(True)), 1).otherwise(0))
    merged = grams.groupBy("row", "kind", "template", "label", "n_grams", "run").agg(F.sum("held").alias("held"), F.min("at").alias("first"), F.max("at").alias("last"))
    part = F.col("held") / F.col("n_grams")
    verified = merged.where((part >= coverage) & (F.col("last") - F.col("first") + 1 <= F.col("n_grams") * STRETCH))
    return phrases.union(verified.select("row", "kind", "label", "first", "last", part.alias("part")))


def license_scan(spark: SparkSession, docs: DataFrame, band: int = BAND, coverage: float = COVERAGE, phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    The base are the places at which all words of a phrase stand in a row. labels adds those of the
    passages of which a text holds the coverage or more; score is the largest part held of any
    template (1 for a phrase), 0 if none. Null and empty texts have no words, no labels ('') and
    score 0. A very long text is one row of words; of several spans that verify, all count. phrases and texts are pairs
    (phrase, label) and (label, text): whole license texts may be given. Repeated rows are scanned each; other columns are ignored; no rows give none.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    grams = materialize(templates(spark, phrases, texts), "templates")
    found = materialize(hits(numbered, grams, grams.count()), "hits")
    per = summary(spans(found.where("kind >= 0"), band, coverage)).withColumnRenamed("row", "r")
    every = found.where("kind = -1").select("row", "doc_id", "n_words")
    out = every.join(per, every.row == per.r, "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def summary(verified: DataFrame) -> DataFrame:
    base = F.col("kind") == 0
    label = F.array_join(F.array_sort(F.collect_set("label")), ",")
    return verified.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        label.alias("labels"),
        F.round(F.max("part"), 6).alias("score"),
    )


def _values() -> str:
    rows = [(0, label, text) for text, label in PHRASES] + [(1, label, text) for label, text in TEXTS]
    return ", ".join("({}, {}, '{}', '{}')".format(i, kind, label, text.replace("'", "''")) for i, (kind, label, text) in enumerate(rows))


_SPLIT = r"list_filter(string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SPLIT.format("text")} AS w FROM documents),
t AS (SELECT template, kind, label, {_SPLIT.format("txt")} AS w, CASE kind WHEN 0 THEN {PHRASE_GRAM} ELSE {TEXT_GRAM} END AS k FROM (VALUES {_values()}) v(template, kind, label, txt)),
tg AS (SELECT template, kind, label, k, len(w) - k + 1 AS n_grams, i - 1 AS place, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM t)),
dg AS (SELECT doc_id, k, i - 1 AS at_word, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES ({PHRASE_GRAM}), ({TEXT_GRAM})) v(k))),
votes AS (SELECT doc_id, template, kind, label, n_grams, at_word - place AS diagonal, count(DISTINCT place) AS votes, list(DISTINCT place) AS places FROM dg JOIN tg USING (k, g) GROUP BY ALL),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM
  (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {BAND} THEN 0 ELSE 1 END AS fresh FROM votes WHERE kind = 1)),
firsts AS (SELECT doc_id, kind, template, label, n_grams, run, place, min(diagonal + place) AS spot FROM (SELECT *, unnest(places) AS place FROM runs) GROUP BY ALL),
ordered AS (SELECT *, CASE WHEN coalesce(spot > lag(spot) OVER (PARTITION BY doc_id, template, run ORDER BY place), true) THEN 1 ELSE 0 END AS held FROM firsts),
spans AS (SELECT doc_id, kind, label, diagonal AS spot, 1.0::DOUBLE AS part FROM votes WHERE kind = 0 AND votes = n_grams
  UNION ALL SELECT doc_id, kind, label, NULL, sum(held) / n_grams AS part FROM ordered GROUP BY doc_id, kind, template, label, n_grams, run HAVING sum(held) / n_grams >= {COVERAGE} AND max(spot) - min(spot) + 1 <= n_grams * {STRETCH}),
s AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_base, min(spot) FILTER (kind = 0) AS first_word, max(spot) FILTER (kind = 0) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(max(part), 6) AS score FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN s USING (doc_id)
"""
