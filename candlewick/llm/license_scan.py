r"""License scans by diagonal voting, in DataFrame operations alone.

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text. Every rolling pair of words is hashed and joined with
the templates' pairs; a hit is confirmed by its words. A hit at word p of the text and place o of a template votes for
the diagonal p - o. Votes are summed by document, template and diagonal. A base phrase stands where one diagonal has all
of its pairs. For a license text neighbouring diagonals are merged (words were put in or left out), which keeps the span
within the template's length plus twice NEAR, and verified: at least COVERED of the template's places, each counted
once, have a vote there. score is, as the SQL has it, the largest share of votes, in which a repeated pair counts again.

One scan, one shuffle: only hits and one row for each document leave the scan, dealt by document. The template table is
fixed in this file (some hundred pairs) and therefore broadcast.

Defined results: a null text is empty: no words, no labels, score 0; repeated rows are judged by themselves; ties
between diagonals change nothing, as labels are sets. Very long texts are scanned whole, their words as rows that only
leave the scan if they hit. Extra columns are ignored. An empty table gives no rows.
lower() maps one character beyond ASCII to a letter of words here (the Kelvin sign to k); no base phrase has a k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm._shared import table

NEAR = 3
COVERED = 0.7
#: The base phrases and their labels.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: License notices, as words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def pairs() -> list[tuple]:
    """Template number, label, base or not, pairs in all, place, and the pair."""
    rows = []
    for t, (label, text, base) in enumerate([*((*x, True) for x in PHRASES), *((*x, False) for x in TEMPLATES)]):
        w = text.split()
        rows += [(t, label, base, len(w) - 1, o, w[o], w[o + 1]) for o in range(len(w) - 1)]
    return rows


def _listed() -> str:
    return ", ".join(f"({t}, '{label}', {str(base).lower()}, {n}, {o}, '{a}', '{b}')" for t, label, base, n, o, a, b in pairs())


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row of docs."""
    spark = docs.sparkSession
    grams = spark.sql(f"SELECT *, xxhash64(a, b) AS gram FROM VALUES {_listed()} AS x(t, label, base, pairs, o, a, b)")
    words = F.expr(rf"filter(split(lower(coalesce({text}, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), x -> x <> '')")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words.alias("w"))
    rows = rows.select("row", "doc_id", "w", F.size("w").cast("long").alias("n_words"), F.posexplode_outer("w").alias("p", "x"))
    rows = rows.select("row", "doc_id", "n_words", "p", "x", F.expr("get(w, p + 1)").alias("y"))
    same = (F.xxhash64("x", "y") == F.col("gram")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))
    hits = rows.join(F.broadcast(grams), same, "left").where("t IS NOT NULL OR p IS NULL OR p = 0")
    # all that follows is by row, so this is the one exchange
    hits = hits.select("row", "doc_id", "n_words", "t", "label", "base", "pairs", "p", F.expr("p - o").alias("d")).repartition("row")

    votes = hits.groupBy("row", "doc_id", "n_words", "t", "label", "base", "pairs", "d").agg(F.count("*").alias("v"), F.expr("bit_or(shiftleft(1L, CAST(p - d AS INT)))").alias("o"))
    near = Window.partitionBy("row", "t").orderBy("d").rangeBetween(-NEAR, NEAR)
    merged = votes.withColumns({"m": F.least(F.sum("v").over(near), F.col("pairs")), "places": F.bit_count(F.bit_or("o").over(near))})  # templates have fewer than 64 pairs
    place = F.expr("base AND v = pairs")
    share = F.expr("CAST(m AS DOUBLE) / pairs")
    verified = F.expr(f"NOT base AND places >= {COVERED} * pairs")
    found = F.when(place, F.lit(1.0)).when(F.expr("NOT base"), share).otherwise(F.lit(0.0))
    return (
        merged.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(place, 1)).alias("n_base"),
            F.min(F.when(place, F.col("d"))).cast("long").alias("first_word"),
            F.max(F.when(place, F.col("d"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(place | verified, F.col("label")))), ",").alias("labels"),
            F.coalesce(F.max(F.when(F.col("t").isNotNull(), found)), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def op9_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    return rf"""
WITH g AS (SELECT * FROM (VALUES {_listed()}) AS x(t, label, base, pairs, o, a, b)),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT k, unnest(range(0, len(w) - 1)) AS p, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM d WHERE len(w) > 1),
v AS (SELECT k, t, label, base, pairs, p - o AS d, count(*) AS v, min(p) AS lo, max(p) AS hi FROM e JOIN g USING (a, b) GROUP BY ALL),
m AS (SELECT *, least(sum(v) OVER n, pairs) AS m, min(lo) OVER n AS mlo, max(hi) OVER n AS mhi FROM v WINDOW n AS (PARTITION BY k, t ORDER BY d RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING)),
f AS (SELECT *, base AND v = pairs AS place, NOT base AND m >= {COVERED} * pairs AND mhi - mlo < pairs + {2 * NEAR} AS verified FROM m),
r AS (SELECT k, count(*) FILTER (place) AS n_base, min(d) FILTER (place) AS first_word, max(d) FILTER (place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place OR verified) AS labels, max(CASE WHEN place THEN 1.0 WHEN NOT base THEN CAST(m AS DOUBLE) / pairs ELSE 0.0 END) AS score FROM f GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN r USING (k)
"""


ORACLE = _oracle()
