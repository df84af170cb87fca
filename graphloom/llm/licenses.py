"""License scans by diagonal voting.

Every rolling word k-gram of every text is hashed and joined to the positions of the same k-grams in
known notices; a text is read once, for the k-grams that notices have and for the phrases. A copy of a notice puts its hits on one diagonal (place in the text less place in the
notice); edits move them to neighbouring ones. Hits are counted by diagonal, neighbours are merged, and
a span is verified by the share of the notice's words that it covers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, let, union_of_spans, window_hashes, words_of

#: Words: ASCII digits and lower-case letters, and all that is not ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, BAND, COVER = 3, 2, 0.75

#: Phrases whose mere presence gives a label (fixed values).
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Customary notices, by label (fixed values).
NOTICES = [
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-notice", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("no-warranty", "The software is provided as is, without warranty of any kind, express or implied"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced without prior written permission"),
]


def _words(text: Column) -> Column:
    """Words of the lower-cased text. Beyond A-Z lower() changes no ASCII letter of a phrase and no word's bounds."""
    return words_of(F.lower(text), LICENSE_WORD)


def template_positions(spark: SparkSession, notices: list[tuple[str, str]], k: int = K) -> DataFrame:
    """(hash, template, label, t_words, t_pos): one row for each k-gram of each notice."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(notices)]
    df = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.template", "t.label", _words(F.col("t.text")).alias("w"))
    return df.select("template", "label", F.size("w").alias("t_words"), F.posexplode(window_hashes(F.col("w"), k)).alias("t_pos", "hash"))


def _stands(words: Column, phrase: list[str]):
    return lambda i: reduce(lambda a, b: a & b, [F.get(words, i + j) == w for j, w in enumerate(phrase)])


def _base(words: Column, phrases: list[tuple[str, str]]) -> Column:
    """Struct of the base columns. Places are looked for only where the joined words hold the phrase."""
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def places(spaced: Column) -> Column:
        found = []
        for phrase, label in phrases:
            p = phrase.split()
            at = F.filter(F.sequence(F.lit(0), F.size(words) - len(p)), _stands(words, p))
            at = F.transform(at, lambda i: i.cast("long"))
            found.append(F.struct(F.when(F.contains(spaced, F.lit(f" {phrase} ")), at).otherwise(F.array().cast("array<bigint>")).alias("at"), F.lit(label).alias("label")))
        return F.array(*found)

    def summary(found: Column) -> Column:
        at = F.flatten(F.transform(found, lambda f: f["at"]))
        return F.struct(
            F.size(at).cast("long").alias("n_base"),
            F.array_min(at).alias("first_word"),
            F.array_max(at).alias("last_word"),
            F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda f: F.size(f["at"]) > 0), lambda f: f["label"]))).alias("base"),
        )

    return F.struct(F.size(words).cast("long").alias("n_words"), let(let(spaced, places), summary).alias("b"))


def _grams(words: Column, k: int, hashes: list[int]) -> Column:
    """Array of (pos, hash) of the word k-grams whose hash is one of ``hashes``."""
    hashed = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    at = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(at, lambda i: hashed(i).isin(hashes)), lambda i: F.struct(i.alias("pos"), hashed(i).alias("hash")))


def _known(spark: SparkSession, notices: list[tuple[str, str]] | None, k: int) -> tuple[DataFrame, list[int]]:
    """The positions of the notices' k-grams, and their hashes.

    The notices are a constant of this module or an argument: a few hundred rows.
    """
    known = template_positions(spark, NOTICES if notices is None else notices, k)
    return known, [r[0] for r in known.select("hash").distinct().collect()]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str]] | None = None, k: int = K, band: int = BAND, cover: float = COVER) -> DataFrame:
    """(doc_id, text_key, label, score, start_word, end_word): verified copies of notices.

    text_key is a hash of the text, so rows of one id keep apart. score is the covered share of the
    notice's words.
    """
    known, hashes = _known(docs.sparkSession, notices, k)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), let(_words(text), lambda w: _grams(w, k, hashes)).alias("grams"))
    return _spans(rows, known, k, band, cover)


def _spans(rows: DataFrame, known: DataFrame, k: int = K, band: int = BAND, cover: float = COVER) -> DataFrame:
    """``spans`` of rows (doc_id, text_key, grams)."""
    grams = rows.select("doc_id", "text_key", F.inline("grams"))
    hits = grams.join(F.broadcast(known), "hash").select("doc_id", "text_key", "template", "label", "t_words", "t_pos", "pos", (F.col("pos") - F.col("t_pos")).alias("diag"))
    by_diag = hits.groupBy("doc_id", "text_key", "template", "label", "t_words", "diag").agg(F.collect_set("t_pos").alias("at"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    w = W.partitionBy("doc_id", "text_key", "template").orderBy("diag")
    fresh = F.coalesce((F.col("diag") - F.lag("diag").over(w) > band).cast("int"), F.lit(1))
    merged = (
        by_diag.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(w))
        .groupBy("doc_id", "text_key", "template", "label", "t_words", "run")
        .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.min("lo").alias("start_word"), (F.max("hi") + k).alias("end_word"))
    )
    scored = merged.withColumn("score", union_of_spans(F.col("at"), k) / F.col("t_words"))
    return scored.where(F.col("score") >= cover).select("doc_id", "text_key", "label", "score", "start_word", "end_word")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None, k: int = K, **how) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row.

    score is the best covered share of a notice, 1 where a phrase stands, else 0. A null text counts as
    empty. Rows are told apart by id and text, so a repeated row gets the same result as its twin; null
    ids are kept. Extra columns are not read; an empty table gives no rows.
    """
    known, hashes = _known(docs.sparkSession, notices, k)
    text = F.coalesce(docs[text_col], F.lit(""))
    read = lambda w: F.struct(_base(w, PHRASES if phrases is None else phrases).alias("s"), _grams(w, k, hashes).alias("grams"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), let(_words(text), read).alias("x"))
    rows = cut(rows.select("doc_id", "text_key", "x.s.n_words", "x.s.b.n_base", "x.s.b.first_word", "x.s.b.last_word", "x.s.b.base", "x.grams"))
    found = _spans(rows, known, k, **how).groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    both = rows.join(found, rows["doc_id"].eqNullSafe(found["d"]) & (rows["text_key"] == found["t"]), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0)))).alias("score"),
    )
