"""License scan by diagonal voting, in DataFrame and SQL functions only.

All rolling word k-grams of all documents are joined by hash with the k-grams of license templates, and
confirmed word for word. A hit at word p of a document and word q of a template votes for the diagonal
p - q. Votes are gathered for each diagonal, neighbouring diagonals are merged (words put in or left out
move a passage from one to the next), and a merged span is a match where it covers enough of its
template within a span that is not much longer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words after A-Z are lower-cased: digits, letters a-z and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GRAM, GAP, COVER, STRETCH = 2, 2, 0.6, 1.5
#: Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Positions of a template whose hits one long holds; a template has as many longs as it needs.
CHUNK = 60
#: Public license notices, openings and whole texts, in words.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
     "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
     "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     "the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
     "purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
     "arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
     "notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability "
     "and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
     "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must "
     "retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
     "conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and "
     "contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
     "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
     "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability "
     "or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
)


def _templates(phrases, notices):
    """(template, label, base, grams, position, gram) for every k-gram of every template."""
    out = []
    for n, (label, text) in enumerate([*phrases, *notices]):
        words = text.split()
        grams = [" ".join(words[k:k + GRAM]) for k in range(len(words) - GRAM + 1)]
        if not grams:
            raise ValueError(f"a template has {GRAM} words or more: {text!r}")
        out += [(n, label, n < len(phrases), len(grams), k, g) for k, g in enumerate(grams)]
    return out


def scan(spark: SparkSession, docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> tuple[DataFrame, DataFrame]:
    """(spans, documents) of ``docs`` (doc_id, text).

    documents has a row for each row of ``docs``: doc_id, n_words, n_base (places of base phrases),
    first_word and last_word (least and greatest start among them, from 0, else null), base_labels and
    labels (distinct, sorted, comma-joined), score (the largest share of a template that a span covers).
    spans has doc_id, label, base, first_word, words and cover of each match. Null and empty texts have no
    words; rows with equal or null doc_id are scanned each by itself; empty tables give empty results and
    further columns are ignored.
    """
    tpl = _templates(phrases, notices)
    schema = "template int, label string, base boolean, grams int, q int, t_gram string"
    # The templates are this call's arguments: a row for each word of them.
    tpl = F.broadcast(spark.createDataFrame(tpl, schema).withColumn("h", F.xxhash64("t_gram")))
    # U+212A is the one character outside ASCII that lower() makes an ASCII letter.
    words = F.regexp_extract_all(F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("K"), F.lit("å"))), F.lit(WORD), F.lit(0))
    x = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), words.alias("w"))
    grams = F.expr(f"concat(transform(w, (x, i) -> {' || '.join(['x'] + [chr(39) + ' ' + chr(39) + f' || coalesce(get(w, i + {k}), {chr(39) * 2})' for k in range(1, GRAM)])}), array(cast(null as string)))")
    x = x.select("row", "doc_id", F.posexplode(grams).alias("p", "gram")).withColumn("h", F.xxhash64("gram"))
    # The last element of every document is null: it carries the number of words, hits or not.
    x = x.join(tpl, "h", "left").where("gram is null or gram = t_gram")
    # A template's hits as bits, CHUNK of its positions in a long.
    votes = x.groupBy("row", "doc_id", "template", "label", "base", "grams", F.col("p") - F.coalesce("q", F.lit(0)), F.expr(f"q div {CHUNK}")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, q % {CHUNK})")).alias("mask"), F.min("q").alias("lo"), F.max("q").alias("hi"))
    votes = votes.toDF("row", "doc_id", "template", "label", "base", "grams", "diagonal", "chunk", "mask", "lo", "hi")
    by = Window.partitionBy("row", "template").orderBy("diagonal", "chunk")
    # Diagonals near each other go together; those of base phrases, which must be whole, don't.
    off = F.col("diagonal") - F.lag("diagonal").over(by)
    fresh = F.coalesce(F.when(F.col("base"), off > 0).otherwise(off > GAP).cast("int"), F.lit(1))
    merged = votes.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by))
    of = ["row", "doc_id", "template", "label", "base", "grams", "run"]
    merged = merged.groupBy(*of, "chunk").agg(
        F.bit_or("mask").alias("mask"), F.min(F.col("diagonal") + F.coalesce("lo", F.lit(0))).alias("first_word"),
        F.max(F.col("diagonal") + F.coalesce("hi", F.lit(0))).alias("last_gram"))
    merged = merged.groupBy(*of).agg(F.sum(F.bit_count("mask")).alias("hits"), F.min("first_word").alias("first_word"), F.max("last_gram").alias("last_gram"))
    cover = F.col("hits") / F.col("grams")
    length = F.col("last_gram") - F.col("first_word") + GRAM
    sure = F.when(F.col("base"), F.col("cover") == 1).otherwise((F.col("cover") >= COVER) & (F.col("words") <= STRETCH * (F.col("grams") + GRAM - 1)))
    merged = merged.withColumns({"cover": cover, "words": length}).withColumn("sure", F.coalesce(sure, F.lit(False)))
    spans = merged.where("sure").select("doc_id", "label", "base", F.col("first_word").cast("long"), F.col("words").cast("long"), "cover")

    place = F.col("sure") & F.col("base")
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    result = merged.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template").isNull(), F.col("first_word"))).cast("long").alias("n_words"),
        F.count(F.when(place, True)).alias("n_base"),
        F.min(F.when(place, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("first_word"))).cast("long").alias("last_word"),
        labels(place).alias("base_labels"), labels(F.col("sure")).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"))
    return spans, result.drop("row")


def scan_sql(phrases=PHRASES, notices=NOTICES) -> str:
    """DuckDB SQL over ``documents`` for the rows of the second result of ``scan``."""
    rows = ", ".join(f"({n}, '{label}', {base}, {grams}, {q}, '{gram}')" for n, label, base, grams, q, gram in _templates(phrases, notices))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gram = " || ' ' || ".join(f"coalesce(w[i + {k}], '')" for k in range(GRAM))
    return rf"""
    WITH t(template, label, base, grams, q, t_gram) AS (VALUES {rows}),
    d AS (SELECT row_number() OVER () AS row, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w FROM documents),
    g AS (SELECT row, i - 1 AS p, {gram} AS gram FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
    v AS (SELECT row, template, label, base, grams, p - q AS diagonal, q // {CHUNK} AS chunk, bit_or(1::BIGINT << (q % {CHUNK})) AS mask, min(q) AS lo, max(q) AS hi
        FROM g JOIN t ON gram = t_gram GROUP BY ALL),
    f AS (SELECT *, CASE WHEN coalesce(diagonal - lag(diagonal) OVER o > CASE WHEN base THEN 0 ELSE {GAP} END, true) THEN 1 ELSE 0 END AS fresh FROM v
        WINDOW o AS (PARTITION BY row, template ORDER BY diagonal, chunk)),
    u AS (SELECT *, sum(fresh) OVER (PARTITION BY row, template ORDER BY diagonal, chunk) AS run FROM f),
    c AS (SELECT row, template, label, base, grams, run, chunk, bit_count(bit_or(mask)) AS hits, min(diagonal + lo) AS lo, max(diagonal + hi) AS hi FROM u GROUP BY row, template, label, base, grams, run, chunk),
    m AS (SELECT row, template, label, base, grams, run, sum(hits)::DOUBLE / grams AS cover,
        min(lo) AS first_word, max(hi) - min(lo) + {GRAM} AS words FROM c GROUP BY row, template, label, base, grams, run),
    s AS (SELECT *, CASE WHEN base THEN cover = 1 ELSE cover >= {COVER} AND words <= {STRETCH} * (grams + {GRAM} - 1) END AS sure FROM m)
    SELECT doc_id, len(any_value(w))::BIGINT AS n_words, count(*) FILTER (sure AND base) AS n_base,
        min(first_word) FILTER (sure AND base)::BIGINT AS first_word, max(first_word) FILTER (sure AND base)::BIGINT AS last_word,
        coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (sure AND base))), ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (sure))), ','), '') AS labels,
        coalesce(max(cover), 0.0) AS score
    FROM d LEFT JOIN s USING (row) GROUP BY row, doc_id"""
