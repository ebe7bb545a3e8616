"""License scans by diagonal voting, in DataFrame functions only.

All rolling word pairs of all documents are hashed and joined to the places where templates hold the same pair; the words are compared as well, so a
hash can't mislead. A match at document word p and template word t votes for the diagonal p - t. Votes of one diagonal that lie
close in the text are a segment; segments of a notice on neighbouring diagonals (insertions and deletions move the
diagonal) that follow each other both in the text and in the template are merged into a span, so a notice told twice is two spans, and stray
pairs beside a notice stay out of its span. A span is verified if it holds enough pairs of its template over a
stretch not much longer than the template.

A base phrase is a template that must match whole on one diagonal; each such diagonal is one place.
The templates are a fixed list of a few hundred pairs, so that side is broadcast. Each document brings one pair of nulls, which a
template of its own holds, so documents without a match stay. What matches is shuffled once, by document.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Phrase and label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Usual notices, by the label they give. They are matched fuzzily.
NOTICES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software",
        "mit-text",
    ),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
        "warranties or conditions of any kind either express or implied",
        "apache-text",
    ),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
        "gpl-text",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer",
        "bsd-text",
    ),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("released under the mit license", "mit-release"),
    ("all rights reserved", "all-rights-reserved"),
)

MIN_SHARE = 0.75
#: Merged are diagonals up to MAX_DRIFT apart, over up to MAX_GAP words of text; a segment has MIN_VOTES, or all of a shorter template.
MAX_DRIFT, MAX_GAP, MIN_VOTES = 3, 12, 3


def _templates() -> list[tuple]:
    """(template, label, base, pairs of the template, first word, second word, place); the one of template -1 stands for a document."""
    out: list[tuple] = [(-1, "", False, 1, None, None, 0)]
    for number, (text, label, base) in enumerate([(*x, True) for x in PHRASES] + [(*x, False) for x in NOTICES]):
        words = re.findall(r"[0-9a-z]+", text)
        out += [(number, label, base, len(words) - 1, a, b, i) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return out


def _sides(spark: SparkSession) -> DataFrame:
    quoted = lambda x: "CAST(NULL AS STRING)" if x is None else f"'{x}'"
    rows = ", ".join(f"({n}, '{label}', {str(base).lower()}, {pairs}, {quoted(a)}, {quoted(b)}, {place})" for n, label, base, pairs, a, b, place in _templates())
    return spark.sql(f"SELECT *, xxhash64(t1, t2) AS hash FROM VALUES {rows} AS t (template, label, base, pairs, t1, t2, place)")


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: label, first word and the one beyond of each verified span of a notice and each place of a base phrase, in order. score: the
    greatest share of a template's pairs found in a span, 1 for a base phrase. A null text is empty: no words, empty
    labels, score 0. A very long text is scanned whole. Repeated rows and rows with a null id are scanned each; an empty table gives
    an empty one; other columns are not read.
    """
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text")
    ).select("row", "doc_id", F.concat(words, F.array(F.lit(None).cast("string"))).alias("words"))
    n = F.size("words")
    rolled = rows.select("row", "doc_id", (n - 1).cast("bigint").alias("n_words"), F.posexplode(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, n).alias("b"))).alias("at", "p"))
    rolled = rolled.select("row", "doc_id", "n_words", "at", F.col("p.a").alias("w1"), F.col("p.b").alias("w2"), F.xxhash64("p.a", "p.b").alias("hash"))
    sides = F.broadcast(_sides(docs.sparkSession))
    same = (rolled["hash"] == sides["hash"]) & rolled["w1"].eqNullSafe(sides["t1"]) & rolled["w2"].eqNullSafe(sides["t2"])
    met = rolled.join(sides, same).select("row", "doc_id", "n_words", "template", "label", "base", "pairs", "at", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    keys = ["row", "doc_id", "n_words", "template", "label", "base", "pairs"]
    # Votes of one diagonal, in segments.
    along = W.partitionBy("row", "template", "diagonal").orderBy("at")
    far = F.coalesce(F.col("at") - F.lag("at").over(along) > MAX_GAP, F.lit(False))
    segments = met.repartition("row").withColumn("segment", F.sum(far.cast("int")).over(along)).groupBy(*keys, "diagonal", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("from_word"), (F.max("at") + 2).alias("to_word"), F.min("place").alias("from_place"), F.max("place").alias("to_place")
    )
    segments = segments.where(F.col("n") >= F.least(F.lit(MIN_VOTES), F.col("pairs")))
    # Segments that follow each other in the text and in the template.
    order = W.partitionBy("row", "template").orderBy("from_word", "diagonal")
    before = lambda c: F.lag(c).over(order)
    follows = (F.abs(F.col("diagonal") - before("diagonal")) <= MAX_DRIFT) & (F.col("from_word") - before("to_word") <= MAX_GAP) & (F.col("from_place") > before("to_place"))
    islands = segments.withColumn("island", F.sum((F.col("base") | ~F.coalesce(follows, F.lit(False))).cast("int")).over(order))
    spans = islands.groupBy(*keys, "island").agg(
        F.sum("n").alias("n"), F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word"), F.min("diagonal").alias("diagonal")
    )
    notice = ~F.col("base") & (F.col("template") >= 0)
    whole = F.col("base") & (F.col("n") == F.col("pairs"))
    fuzzy = notice & (F.col("n") >= MIN_SHARE * F.col("pairs")) & (F.col("to_word") - F.col("from_word") <= 1.5 * F.col("pairs") + MAX_DRIFT)
    sure = spans.withColumn("base_hit", whole).withColumn("hit", whole | fuzzy)
    share = F.when(F.col("hit"), F.least(F.lit(1.0), F.col("n") / F.col("pairs")))
    of = lambda flag, x: F.when(F.col(flag), x)
    place = F.col("diagonal").cast("bigint")
    out = sure.groupBy("row", "doc_id", "n_words").agg(
        F.count(of("base_hit", F.lit(1))).alias("n_base"),
        F.min(of("base_hit", place)).alias("first_word"),
        F.max(of("base_hit", place)).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(of("base_hit", F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(of("hit", F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(of("hit", F.struct(F.col("from_word").cast("bigint").alias("first"), F.col("to_word").cast("bigint").alias("last"), "label")))).alias("spans"),
    )
    return out.drop("row")
