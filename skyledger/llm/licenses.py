"""Licence scan by diagonal voting.

Every rolling word k-gram of every text is hashed and joined to the positions of the same gram in the templates. A match
of text position p with template position t is a vote for the diagonal p - t. Votes of one template that follow each
other on neighbouring diagonals (words put in or left out) make a chain. Of a chain, every diagonal alone, every group
of diagonals within the drift, and the whole are verified as spans: a span counts if enough of its template is covered
and it is not much longer than the template. So stray votes that chain with a notice can't hide it. The join compares
the words too, so a vote is never a mere hash collision. Only votes are shuffled, by document; the templates' grams are
broadcast up to a bound that is counted first, and joined by a shuffle beyond it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import LOWER, UPPER, WORD_CLASS, cut, row_key, words

K = 2
SHORT = 12  # words up to which a template must be covered whole
BROADCAST_GRAMS = 200_000  # of all templates; about 20 MB


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False  # only exact occurrences count, all places of it


#: Phrases and labels: fixed values.
BASE = [Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True)]
NOTICES = [
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
]


def template_words(text: str) -> list[str]:
    return re.findall(WORD_CLASS, text.translate(str.maketrans(UPPER, LOWER)))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = (*BASE, *NOTICES), *, id_col: str = "doc_id", text_col: str = "text", drift: int = 3, coverage: float = 0.75) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places where a base template's words stand consecutively; first_word and last_word are the
    smallest and largest start of them, in words from 0. labels adds those of other templates of which a span covers at
    least coverage (all of it, for templates of up to SHORT words). spans lists what counted: label, start, stop (words),
    covered (share of the template). score is the largest covered share, 0 if there is none. A null or empty text has no words; rows that repeat each get the same
    result; null ids are kept. Columns other than id_col and text_col are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    grams = []
    for i, t in enumerate(templates):
        ws = template_words(t.text)
        if len(ws) < K:
            raise ValueError(f"a template of fewer than {K} words: {t.text!r}")
        grams += [(i, t.label, t.base, len(ws), p, *ws[p : p + K]) for p in range(len(ws) - K + 1)]
    table = spark.createDataFrame(grams, "template int, label string, base boolean, n int, t_pos int, t_first string, t_second string")
    table = table.withColumn("hash", F.xxhash64("t_first", "t_second"))
    if len(grams) <= BROADCAST_GRAMS:
        table = F.broadcast(table)

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    keys = row_key(F.col(id_col), F.col("_text"))
    tokens = rows.where("_text is not null").select(*keys, words(F.col("_text")).alias("_words"))
    pairs = tokens.select("_k1", "_k2", F.arrays_zip(F.col("_words").alias("first"), F.slice("_words", 2, F.lit(2**31 - 1)).alias("second")).alias("_pairs"))
    # the outer form: for the plain one Spark would add a filter that splits every text a second time
    grams_at = pairs.select("_k1", "_k2", F.posexplode_outer("_pairs").alias("pos", "_gram")).select("_k1", "_k2", "pos", "_gram.first", "_gram.second")
    votes = grams_at.join(table, (F.xxhash64("first", "second") == F.col("hash")) & (F.col("first") == F.col("t_first")) & (F.col("second") == F.col("t_second")))

    of = ["_k1", "_k2", "template", "label", "base", "n"]
    diagonals = votes.groupBy(*of, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("hits"))
    # written, as the texts would else be read for base templates and for the others
    strong = cut(diagonals.where(F.when(F.col("base"), F.size("hits") == F.col("n") - K + 1).otherwise((F.size("hits") > 1) | (F.col("n") <= 6))))
    covers = lambda hits: F.size(F.array_union(hits, F.transform(hits, lambda t: t + 1))) / F.col("n")  # noqa: E731  K = 2: a gram covers two words
    span = lambda start, stop, hits: F.struct(start.alias("start"), stop.alias("stop"), covers(hits).alias("covered"))
    # in a short notice a single word tells one licence from another
    enough = F.when(F.col("n") <= SHORT, F.lit(1.0)).otherwise(coverage)
    counts = lambda s: (s["covered"] >= enough) & (s["stop"] - s["start"] <= 1.5 * F.col("n") + drift)

    lined = strong.withColumns({"_first": F.col("diagonal") + F.array_min("hits"), "_last": F.col("diagonal") + F.array_max("hits") + K})
    alone = span(F.col("_first"), F.col("_last"), F.col("hits"))
    base = lined.where("base").select("_k1", "_k2", "label", "base", alone.alias("s"))
    order = Window.partitionBy("_k1", "_k2", "template").orderBy("diagonal")
    near = order.rangeBetween(0, drift)
    chained = lined.where("not base").withColumn("_new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > drift, F.lit(True)).cast("int"))
    chained = chained.withColumn("_chain", F.sum("_new").over(order)).withColumn("_near", span(F.min("_first").over(near), F.max("_last").over(near), F.flatten(F.collect_list("hits").over(near))))
    chains = chained.groupBy(*of, "_chain").agg(
        F.collect_list(F.when(counts(alone), alone)).alias("_alone"), F.collect_list(F.when(counts(F.col("_near")), F.col("_near"))).alias("_near"), F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.flatten(F.collect_list("hits")).alias("_hits")
    )
    whole = span(F.col("_first"), F.col("_last"), F.col("_hits"))
    looser = F.concat("_near", F.when(counts(whole), F.array(whole)).otherwise(F.array().cast("array<struct<start:int,stop:int,covered:double>>")))
    best = F.array_max(F.transform(looser, lambda s: F.struct(s["covered"], (s["start"] - s["stop"]).alias("_short"), s.alias("s"))))["s"]
    # notices found on one diagonal; else the chain's best span
    kept = F.when(F.size("_alone") > 0, F.col("_alone")).when(best.isNotNull(), F.array(best))
    spans = base.unionByName(chains.select("_k1", "_k2", "label", "base", F.explode(kept).alias("s"))).select("_k1", "_k2", "label", "base", "s.start", "s.stop", "s.covered")

    found = spans.groupBy("_k1", "_k2").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("covered").alias("score"), F.sort_array(F.collect_list(F.struct("start", "stop", "label", "covered"))).alias("spans"),
    )
    return rows.select(F.col(id_col), F.size(words(F.col("_text"))).cast("long").alias("n_words"), *keys).join(found, ["_k1", "_k2"], "left").select(
        id_col, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int,label:string,covered:double>>")).alias("spans"),
    )
