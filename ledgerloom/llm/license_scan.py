"""License notices by diagonal voting of word k-grams against templates.

Every rolling k-gram hash of every text is joined to the templates' positions
(a constant table, so it is broadcast). Hits vote for a diagonal, document
position minus template position; neighbouring diagonals are merged, so that a
dropped or added word doesn't part a notice; a merged span counts if it covers
enough of its template and isn't much longer. Of notices with different labels
at one place, only the best covered count: "CC BY-NC 4.0" isn't "CC BY 4.0"
with a word more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from .blocks import ALNUM, blocks, follow, word_hashes, words
from .salted import looked_up

K = 2
COVERAGE = 0.8
DRIFT = 2

#: Phrases that count wherever their words stand consecutively.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Opening words of public notices, in lower case and without punctuation.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
)


def template_table(df: DataFrame, phrases, notices) -> DataFrame:
    """(h, template, t): the k-gram hashes of all templates."""
    rows = []
    for k, (text, _) in enumerate([*phrases, *notices]):
        h = word_hashes(text)
        rows += [(int(x), k, t) for t, x in enumerate(follow(h[:-1], h[1:]).view(np.int64))]
    return df.sparkSession.createDataFrame(rows, "h long, template int, t long")


def rolling(df: DataFrame) -> DataFrame:
    """(key, pos, h) of every k-gram of every text of df (key, text)."""
    schema = pa.schema([("key", pa.int64()), ("pos", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, bounds in blocks(batch.column(1)):
                h, _, first = words(data, bounds, ALNUM)
                if len(h) < K:
                    continue
                row = np.repeat(np.arange(b - a), np.diff(first))
                keep = row[:-1] == row[1:]
                pos = np.arange(len(h)) - first[row]
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][row[:-1][keep]]), pa.array(pos[:-1][keep]), pa.array(follow(h[:-1], h[1:])[keep].view(np.int64))], schema=schema)

    return df.mapInArrow(run, "key long, pos long, h long")


def word_counts(df: DataFrame) -> DataFrame:
    """(doc_id, key, n_words) of df (doc_id, key, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in blocks(batch.column(2)):
                first = words(data, bounds, ALNUM)[2]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(first), pa.int64())], schema=schema)

    return df.mapInArrow(run, "doc_id long, key long, n_words long")


def spans(df: DataFrame, phrases=PHRASES, notices=NOTICES, coverage: float = COVERAGE, drift: int = DRIFT) -> DataFrame:
    """(key, template, label, base, start, end, coverage) of verified spans in df (key, text); word numbers, end excluded."""
    sizes = [len(text.split()) for text, _ in [*phrases, *notices]]
    info = df.sparkSession.createDataFrame([(k, label, k < len(phrases), sizes[k] - K + 1, sizes[k]) for k, (_, label) in enumerate([*phrases, *notices])], "template int, label string, base boolean, grams int, size int")
    hits = rolling(df).join(F.broadcast(template_table(df, phrases, notices)), "h").select("key", "template", "t", "pos").distinct()
    votes = hits.groupBy("key", "template", (F.col("pos") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"), F.min("pos").alias("start"), (F.max("pos") + K).alias("end"))
    votes = votes.join(F.broadcast(info), "template")
    order = W.partitionBy("key", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("base"), 0).otherwise(drift)
    group = F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    merged = votes.withColumn("group", group).groupBy("key", "template", "label", "base", "grams", "size", "group")
    merged = merged.agg(F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("covered"), F.min("start").alias("start"), F.max("end").alias("end"))
    share = F.col("covered") / F.col("grams")
    whole = F.when(F.col("base"), F.col("covered") == F.col("grams")).otherwise((share >= coverage) & (F.col("end") - F.col("start") <= F.col("size") + 2 * drift))
    found = merged.where(whole).select("key", "template", "label", "base", "start", "end", "covered", share.alias("coverage"))
    # spans have at most this many words, so few others begin near enough to overlap
    reach = max(sizes) + 2 * drift
    near = W.partitionBy("key").orderBy("start").rangeBetween(-reach, reach)
    others = F.collect_set(F.when(~F.col("base"), F.struct("coverage", "covered", "label", "start", "end"))).over(near)
    better = F.exists("others", lambda o: (o["label"] != F.col("label")) & (o["start"] < F.col("end")) & (o["end"] > F.col("start")) & (F.struct(o["coverage"], o["covered"]) > F.struct("coverage", "covered")))
    return found.withColumn("others", others).where(F.col("base") | ~better).select("key", "template", "label", "base", "start", "end", "coverage")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per input row.

    Null and empty texts have no words, no labels and a score of 0; rows with
    one text have one result; a null id stays null; an empty table gives an
    empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    found = spans(docs.select("key", "text"), **settings)
    base = F.col("base")
    each = found.groupBy("key").agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"),
    )
    out = looked_up(word_counts(docs), "key", ["doc_id"], each, "left")  # very many documents may have one text
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
