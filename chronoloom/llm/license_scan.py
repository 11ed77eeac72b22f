"""License scan by diagonal voting.

All rolling 3-word hashes of all documents are joined with the positions of the same hashes in license templates. A hit lies on the
diagonal document position minus template position; hits are counted by diagonal, neighbouring diagonals of a template are merged (words
put in or left out shift the diagonal), and a merged span counts if it has enough of its template's word runs. A hit has two equal hashes
of its words, of 64 and 32 bits. The join is against a fixed table of templates, which is broadcast; a group is one document, template and diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import materialise, require, row_key

GRAM = 3
#: Diagonals this close are one span; a span needs this share of its template's word runs.
NEIGHBOUR = 4
LEAST_SHARE = 0.6

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Public license notices by label.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "proprietary": "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited",
}


def words_of(column: str) -> str:
    r"""SQL for the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased."""
    return rf"filter(split(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+', -1), w -> w <> '')"


_RUN = "w, get(words, i + 1), get(words, i + 2)"
GRAMS = f"transform(slice(words, 1, greatest(size(words) - {GRAM - 1}, 0)), (w, i) -> struct(xxhash64({_RUN}) as gram, hash({_RUN}) as check))"


def templates(spark, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """gram, check, tid, label, base, tpos, tgrams: a row for each word run of each template."""
    rows = [(f"p{k}", label, True, text) for k, (text, label) in enumerate(phrases.items())] + [(f"n{k}", label, False, text) for k, (label, text) in enumerate(notices.items())]
    df = spark.createDataFrame(rows, "tid string, label string, base boolean, text string").selectExpr("tid", "label", "base", f"{words_of('text')} as words").selectExpr("*", f"{GRAMS} as grams")
    return df.selectExpr("tid", "label", "base", "size(grams) as tgrams", "posexplode(grams) as (tpos, g)").selectExpr("tid", "label", "base", "tgrams", "tpos", "g.gram", "g.check")


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, neighbour: int = NEIGHBOUR, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are not read): doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans (label, start and end word, share).

    A null or empty text has no words, no labels and the score 0. Rows that repeat id and text have equal results; rows that share an id
    only, or have none, are scanned on their own. Spans of equal labels and starts are sorted by their ends. Texts of any length are scanned
    whole; columns of docs with names that are used here do no harm. An empty table gives an empty result.
    """
    require(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    known = templates(spark, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    split = docs.select(F.col("doc_id"), row_key(F.col("doc_id"), F.col("text"))["h"].alias("h"), F.expr(words_of("text")).alias("words"))
    # the words stay behind: a text of a million words makes a million short rows
    rolled = split.select("doc_id", "h", F.expr(f"posexplode({GRAMS})").alias("pos", "g")).select("doc_id", "h", "pos", "g.gram", "g.check")
    hits = (
        rolled.join(F.broadcast(known), ["gram", "check"])
        .select("doc_id", "h", "tid", "label", "base", "tgrams", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    )
    lines = hits.groupBy("doc_id", "h", "tid", "label", "base", "tgrams", "diagonal").agg(F.collect_set("tpos").alias("at"))
    beside = Window.partitionBy("doc_id", "h", "tid").orderBy("diagonal")
    merged = (
        lines.withColumn("new", F.when((F.col("diagonal") - F.lag("diagonal").over(beside) <= neighbour) & ~F.col("base"), 0).otherwise(1))
        .withColumn("span", F.sum("new").over(beside))
        .groupBy("doc_id", "h", "tid", "label", "base", "tgrams", "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min(F.col("diagonal") + F.array_min("at")).alias("start"), F.max(F.col("diagonal") + F.array_max("at") + GRAM).alias("end"))
        .withColumn("share", F.size("at") / F.col("tgrams"))
        .where(F.when(F.col("base"), F.size("at") == F.col("tgrams")).otherwise(F.col("share") >= least_share))
    )
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.when(F.col("base"), F.col("start"))
    found = materialise(
        merged.groupBy("doc_id", "h").agg(
            F.count(base).alias("n_base"),
            F.min(base).cast("long").alias("first_word"),
            F.max(base).cast("long").alias("last_word"),
            names(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
            names("label").alias("labels"),
            F.max("share").alias("score"),
            F.array_sort(F.collect_list(F.struct("label", "start", "end", "share"))).alias("spans"),
        )
    ).select(F.col("doc_id").alias("fid"), F.col("h").alias("fh"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    counts = split.select("doc_id", "h", F.size("words").cast("long").alias("n_words"))
    out = counts.join(found, counts["doc_id"].eqNullSafe(found["fid"]) & (counts["h"] == found["fh"]), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.drop("spans")
