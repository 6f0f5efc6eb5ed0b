"""License scan by diagonal voting, with DataFrame functions only.

Every rolling word 2-gram of every text is joined with the positions of the same 2-gram in the templates (a parameter
list, so its join table is bounded and broadcast). A hit votes for the diagonal text position - template position; votes
are gathered per (row, template, diagonal) with partial aggregation, as a bit mask of the template positions that voted, which leaves
a few rows per document. Neighbouring diagonals (a word more or less) merge, and a merged span is verified by the share of the
template's positions that it covers. Phrases are templates that need every position on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.session import table

#: Phrases whose every place counts, as (label, phrase).
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Templates of the method's own labels, as (label, text). All are short public notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: 2-grams of one template at most, as many as a mask of votes has bits for; a longer notice is given as several templates.
MOST_GRAMS = 62
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_grams(spark, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(gram, tpl, label, exact, tpos, n_grams): the 2-grams of each template by position. Bounded by the parameter lists."""
    rows = []
    for exact, group in ((True, phrases), (False, templates)):
        for label, text in group:
            words = text.split()
            if len(words) - 1 > MOST_GRAMS:
                raise ValueError(f"template {label!r} has more than {MOST_GRAMS + 1} words; give it as several templates")
            rows += [(a, b, f"{label}/{exact}", label, exact, i, len(words) - 1) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    grams = spark.createDataFrame(rows, "a string, b string, tpl string, label string, exact boolean, tpos int, n_grams int")
    return grams.select(F.xxhash64("a", "b").alias("gram"), F.col("a").alias("t_a"), F.col("b").alias("t_b"), "tpl", "label", "exact", "tpos", "n_grams")


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, drift: int = 2, least: float = 0.7) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of phrases, first_word and last_word are their smallest and largest start (null without one), labels
    are distinct, sorted and comma-joined ('' for none), score is 1 where a phrase stands, else the largest share of a template's
    2-grams that one verified span covers (0 without hits). A template counts where that share is at least `least`
    after diagonals at most `drift` apart were merged. A null or empty text has no words. Rows are told apart by a number of their own, so
    a repeated or null doc_id gives one result for each of its rows; other columns are ignored.
    """
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD), 0)
    keys = ["row", "doc_id"]
    grams = (
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("w"))
        .select(*keys, F.size("w").cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))))
        .select(*keys, "n_words", F.col("pos").alias("at"), F.col("col.a").alias("a"), F.col("col.b").alias("b"))
        .withColumn("gram", F.xxhash64("a", "b"))
    )
    table = F.broadcast(template_grams(docs.sparkSession, phrases, templates))
    hits = grams.join(table, (grams.gram == table.gram) & (F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")), "left")
    votes = hits.groupBy(*keys, "tpl", "label", "exact", "n_grams", (F.col("at") - F.col("tpos")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("tpos"))).alias("covered"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    w = Window.partitionBy(*keys, "tpl").orderBy("diagonal")
    far = F.lag("diagonal").over(w).isNull() | (F.col("diagonal") - F.lag("diagonal").over(w) > drift) | F.coalesce("exact", F.lit(True))
    spans = (
        votes.withColumn("span", F.sum(far.cast("int")).over(w))
        .groupBy(*keys, "tpl", "label", "exact", "n_grams", "span")
        .agg(F.max("n_words").alias("n_words"), F.bit_count(F.bit_or("covered")).alias("n_covered"), F.min("low").alias("low"), F.max("high").alias("high"))
        .withColumn("share", F.col("n_covered") / F.col("n_grams"))
    )
    base = F.col("exact") & (F.col("n_covered") == F.col("n_grams"))
    own = ~F.col("exact") & (F.col("share") >= least) & (F.col("high") - F.col("low") <= F.col("n_grams") + drift)
    names = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("label")))), ",")
    return (
        spans.groupBy(*keys)
        .agg(
            F.max("n_words").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("low"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("low"))).cast("long").alias("last_word"),
            names(base).alias("base_labels"),
            names(base | own).alias("labels"),
            F.round(F.coalesce(F.max(F.when(base, F.lit(1.0)).when(own, F.col("share"))), F.lit(0.0)), 6).alias("score"),
        )
        .drop("row")
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents, whole texts."""
    return scan(table(spark, sf_dir, "documents"))


def _values(group, exact: str) -> str:
    return ", ".join(f"('{label}', '{text}', {exact})" for label, text in group)


ORACLE_SQL = rf"""
WITH t(label, text, exact) AS (VALUES {_values(PHRASES, "true")}, {_values(TEMPLATES, "false")}),
tw AS (SELECT label, exact, string_split(text, ' ') AS w FROM t),
tg AS (SELECT label, exact, len(w) - 1 AS n_grams, i - 1 AS tpos, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT *, unnest(range(1, len(w))) AS i FROM tw)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, i - 1 AS place, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)),
votes AS (
  SELECT doc_id, label, exact, n_grams, place - tpos AS diagonal, bit_or(1::BIGINT << tpos::BIGINT) AS covered, min(place) AS low, max(place) AS high
  FROM dg JOIN tg USING (gram) GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER w <= 2 IS NOT TRUE THEN 1 ELSE 0 END AS far
  FROM votes WINDOW w AS (PARTITION BY doc_id, label, exact ORDER BY diagonal)),
numbered AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, label, exact ORDER BY diagonal) AS span FROM marked),
spans AS (
  SELECT doc_id, label, exact, n_grams, min(low) AS low, max(high) AS high, bit_count(bit_or(covered)) / n_grams AS share
  FROM numbered GROUP BY doc_id, label, exact, n_grams, span),
kept AS (
  SELECT *, exact AND share = 1 AS base, NOT exact AND share >= 0.7 AND high - low <= n_grams + 2 AS own FROM spans)
SELECT d.doc_id, len(any_value(w))::BIGINT AS n_words, count(*) FILTER (base) AS n_base,
  min(low) FILTER (base) AS first_word, max(low) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR own), '') AS labels,
  round(coalesce(max(CASE WHEN base THEN 1.0 WHEN own THEN share END), 0.0), 6)::DOUBLE AS score
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""
