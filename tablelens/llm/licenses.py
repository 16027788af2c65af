"""License scans by diagonal voting, in DataFrame operations only.

Templates are word sequences with a label.  Every run of ``K`` words of a
document is hashed and joined with the runs of the templates; a hit at word p
of the document and word t of a template is a vote for the diagonal p - t,
which is where the template would start.  Votes are counted by document,
template and diagonal.  Neighbouring diagonals, at most ``DRIFT`` apart, belong
to one copy with words put in or left out and are merged; the merged span is
verified by the share of the template's runs it holds, word by word.

A base phrase is a template that must be there in full: all its runs on one
diagonal.  The templates are few and fixed in advance, so their runs are
broadcast; documents are shuffled only as hits, by row, which bounds a group by
the hits of one document.

Edge cases: a NULL or empty text has no words, no labels and score 0;
repeated rows are scanned each for itself; a NULL id stays NULL; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_columns

K = 2
DRIFT = 2
COVERAGE = 0.6

# Separators of words, and the base phrases with their labels.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Well-known sentences of public licenses, with their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN_WORDS, -1), "")


def rolling_hashes(ws: Column, k: int = K) -> Column:
    """Hash of the k words from each place on; places with fewer are left out."""
    single = F.transform(ws, lambda w: F.xxhash64(w))
    rolled = single
    for j in range(1, k):
        rolled = F.zip_with(rolled, F.slice(single, F.lit(j + 1), F.greatest(F.size(ws) - j, F.lit(0))),
                            lambda a, b: F.xxhash64(a, b))
    return F.slice(rolled, F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(0)))


def template_runs(spark: SparkSession, templates: dict[str, str], base: dict[str, str], k: int = K) -> DataFrame:
    """One row per run of a template: its place, hash and words, and what is known of the template."""
    rows = []
    for is_base, group in ((True, base), (False, templates)):
        for text, label in group.items():
            own = [w for w in re.split(BETWEEN_WORDS, text) if w]
            if len(own) < k:
                raise ValueError(f"a template needs at least {k} words: {text!r}")
            rows += [(f"{int(is_base)} {text}", label, is_base, len(own) - k + 1, t, own[t:t + k])
                     for t in range(len(own) - k + 1)]
    frame = spark.createDataFrame(rows, "template string, label string, is_base boolean, n_runs int, t int, "
                                        "run array<string>")
    return frame.withColumn("hash", rolling_hashes(F.col("run"), k)[0])


def hits(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None,
         k: int = K) -> DataFrame:
    """Votes of every row: uid, doc_id, n_words and, for each hit, template and diagonal.

    A row without hits is there once, with a NULL template.  The runs of a
    document are compared with the broadcast templates where they arise; a hit
    must have the same words, not only the same hash.
    """
    runs = template_runs(docs.sparkSession, TEMPLATES if templates is None else templates,
                         BASE_PHRASES if base is None else base, k)
    split = doc_columns(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("uid"), "doc_id",
                                                       words(F.col("text")).alias("words"))
    # place 0 stands for the document itself; word p is at place p + 1
    itself = F.array(F.lit(None).cast("long"))
    rolled = split.select("uid", "doc_id", "words", F.size("words").cast("long").alias("n_words"),
                          F.posexplode(F.concat(itself, rolling_hashes(F.col("words"), k))).alias("place", "hash"))
    joined = rolled.join(F.broadcast(runs), "hash", "left")
    same = F.slice("words", F.col("place"), F.lit(k)) == F.col("run")
    return (joined.filter((F.col("place") == 0) | (F.col("template").isNotNull() & same))
            .select("uid", "doc_id", "n_words", "template", "label", "is_base", "n_runs", "t",
                    (F.col("place") - 1 - F.col("t")).cast("long").alias("diagonal")))


def spans(voted: DataFrame, drift: int = DRIFT, coverage: float = COVERAGE) -> DataFrame:
    """Verified spans of templates: uid, doc_id, n_words, label, is_base, first, last word and score.

    Rows without any span keep one row with NULLs.
    """
    keys = ["uid", "doc_id", "n_words", "template", "label", "is_base", "n_runs"]
    votes = (voted.repartition("uid").groupBy(*keys, "diagonal")
             .agg(F.collect_set("t").alias("seen"), F.min("t").alias("low"), F.max("t").alias("high")))
    by_diagonal = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.col("is_base") | (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > drift)
    merged = (votes.withColumn("opens", F.coalesce(apart.cast("int"), F.lit(1)))
              .withColumn("copy", F.sum("opens").over(by_diagonal))
              .groupBy(*keys, "copy")
              .agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("held"),
                   F.min(F.col("diagonal") + F.col("low")).alias("first"),
                   F.max(F.col("diagonal") + F.col("high")).alias("last")))
    score = F.col("held") / F.col("n_runs")
    kept = F.when(F.col("is_base"), score == 1).otherwise(score >= coverage)
    return merged.select("uid", "doc_id", "n_words", *[
        F.when(kept, F.col(c)).alias(c) for c in ("label", "is_base", "first", "last")],
        F.when(kept, score).alias("score"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None,
         k: int = K, drift: int = DRIFT, coverage: float = COVERAGE) -> DataFrame:
    """One row per row of ``docs``: n_words, the places of base phrases, the labels and the best score."""
    found = spans(hits(docs, templates, base, k), drift, coverage)
    is_base = F.col("is_base")
    joined = (lambda c: F.array_join(F.sort_array(F.collect_set(c)), ","))
    return found.groupBy("uid", "doc_id", "n_words").agg(
        F.count(F.when(is_base, 1)).alias("n_base"), F.min(F.when(is_base, F.col("first"))).alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score")).drop("uid")


def scan_sql(templates: dict[str, str] | None = None, base: dict[str, str] | None = None, k: int = K,
             drift: int = DRIFT, coverage: float = COVERAGE) -> str:
    """The same scan of a table ``documents`` in standard SQL, for checks: compares words, not hashes."""
    known = []
    for is_base, group in (("true", BASE_PHRASES if base is None else base),
                           ("false", TEMPLATES if templates is None else templates)):
        known += [f"('{text}', '{label}', {is_base})" for text, label in group.items()]
    return f"""
WITH known(phrase, label, is_base) AS (VALUES {', '.join(known)}),
split AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words
          FROM documents),
runs AS (SELECT phrase, label, is_base, len(own) - {k - 1} AS n_runs, t - 1 AS t, own[t:t + {k - 1}] AS run
         FROM (SELECT *, unnest(range(1, len(own) - {k - 2})) AS t
               FROM (SELECT *, string_split(phrase, ' ') AS own FROM known))),
rolled AS (SELECT uid, p - 1 AS p, words[p:p + {k - 1}] AS run
           FROM (SELECT uid, words, unnest(range(1, greatest(len(words) - {k - 2}, 1))) AS p FROM split)),
votes AS (SELECT uid, phrase, label, is_base, n_runs, p - t AS diagonal, t FROM rolled JOIN runs USING (run)),
diagonals AS (SELECT DISTINCT uid, phrase, is_base, diagonal FROM votes),
opened AS (SELECT *, CASE WHEN is_base OR coalesce(diagonal - lag(diagonal) OVER w > {drift}, true)
                     THEN 1 ELSE 0 END AS opens
           FROM diagonals WINDOW w AS (PARTITION BY uid, phrase ORDER BY diagonal)),
copies AS (SELECT *, sum(opens) OVER (PARTITION BY uid, phrase ORDER BY diagonal) AS copy FROM opened),
spans AS (SELECT v.uid, v.label, v.is_base, count(DISTINCT t) / any_value(n_runs) AS score,
                 min(v.diagonal + t) AS first
          FROM votes v JOIN copies c ON v.uid = c.uid AND v.phrase = c.phrase AND v.diagonal = c.diagonal
                                    AND v.is_base = c.is_base
          GROUP BY v.uid, v.phrase, v.label, v.is_base, c.copy),
kept AS (SELECT * FROM spans WHERE CASE WHEN is_base THEN score = 1 ELSE score >= {coverage} END)
SELECT s.doc_id, len(any_value(s.words)) AS n_words, count(*) FILTER (WHERE k.is_base) AS n_base,
       min(k.first) FILTER (WHERE k.is_base) AS first_word, max(k.first) FILTER (WHERE k.is_base) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT k.label) FILTER (WHERE k.is_base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT k.label) FILTER (WHERE k.label IS NOT NULL)), ','), '')
           AS labels,
       coalesce(max(k.score), 0.0) AS score
FROM split s LEFT JOIN kept k USING (uid) GROUP BY s.uid, s.doc_id"""
