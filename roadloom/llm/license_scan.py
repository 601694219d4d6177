"""License scan: phrases, and an exact set-similarity join of text blocks with license templates, in DataFrame functions alone."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.cluster import stored

# Fixed values of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: (label, statement): a block that holds ``THRESHOLD`` of a statement's distinct words carries its label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.9

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A block ends at a line feed, or at a mark that ends a sentence before white space.
_BLOCK_END = r"\n|[.!?;](?=\s)"
#: Statements wrapped over lines are sought in windows of words that end at a blank line or such a mark only.
_PARAGRAPH_END = r"\n[\x20\t\r]*\n|[.!?;](?=\s)"
_PHRASE = "(?<![^ ])(?:" + "|".join(PHRASES) + ")(?![^ ])"


def words_of(text: str) -> list[str]:
    """Words of a template, as the scan takes them."""
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def joined_words(lowered: Column) -> Column:
    return F.trim(F.regexp_replace(lowered, SEPARATORS, " "))


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("bigint")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: places where the words of a phrase stand one after the other. The method adds the labels of
    the templates of which some block of the text holds at least ``threshold`` of the distinct words;
    blocks are lines or sentences, and overlapping windows of words that run on over line ends, each
    statement of up to twice the longest template's words whole in one of them (a wrapped statement);
    score is 1 where a phrase stands, else the greatest such share, else 0. A null or empty text has
    no words and no labels; repeated rows are each scanned; templates of equal words each give their
    label; other columns are not read; an empty table gives no rows.

    The join is exact. The template words of each text are cut out in one scan, and counted over all
    texts; templates are ordered by these counts, rarest first. To reach the threshold a block must
    hold one of the first |T| - need + 1 words of the template (prefix), have ``need`` template words
    (length), and have enough left after the first common word on both sides (position); what passes
    is counted in full. A text whose own words can't reach any template is never cut into blocks.
    """
    sets = [(label, sorted(set(words_of(text)))) for label, text in templates]
    need = [math.ceil(threshold * len(words) - 1e-9) for _, words in sets]
    vocabulary = sorted({w for _, words in sets for w in words})
    vocabulary_lit = F.array(*map(F.lit, vocabulary))

    lowered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _UPPER.lower()).alias("lowered"))
    joined = lowered.select("row", "id", "lowered", joined_words(F.col("lowered")).alias("words"))
    counted = joined.select("row", "id", "lowered", "words", F.regexp_count("words", F.lit(_PHRASE)).alias("n_base"), F.array_intersect(F.split("words", " "), vocabulary_lit).alias("tokens"))
    has = F.col("n_base") > 0
    labels = F.array(*(F.when(F.concat(F.lit(" "), "words", F.lit(" ")).contains(f" {phrase} "), F.lit(label)) for phrase, label in PHRASES.items()))
    reaches = [F.size(F.array_intersect("tokens", F.array(*map(F.lit, words)))) >= n for (_, words), n in zip(sets, need, strict=True)]
    any_reach = reaches[0]
    for r in reaches[1:]:
        any_reach = any_reach | r
    facts = counted.select(
        "row",
        "id",
        F.when(F.col("words") == "", F.lit(0).cast("bigint")).otherwise(spaces(F.col("words")) + 1).alias("n_words"),
        F.col("n_base").cast("bigint").alias("n_base"),
        F.when(has, spaces(F.split("words", _PHRASE, 2)[0])).alias("first_word"),
        F.when(has, spaces(F.regexp_extract("words", f"(?s)^(.*){_PHRASE}", 1))).alias("last_word"),
        F.when(has, F.array_sort(F.array_compact(labels))).otherwise(F.array().cast("array<string>")).alias("base"),
        "tokens",
        F.when(any_reach, F.col("lowered")).alias("lowered"),
    )
    facts = stored(facts, "license-facts")

    # At most one row for each word of the templates.
    counts = {r["token"]: r["n"] for r in facts.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rank_of = F.create_map(*(F.lit(x) for w in order for x in (w, rank[w])))
    index = []
    for t, ((label, words), n) in enumerate(zip(sets, need, strict=True)):
        ranks = sorted(rank[w] for w in words)
        index += [(token, t, label, i, ranks, n) for i, token in enumerate(ranks[: len(ranks) - n + 1])]
    index_df = docs.sparkSession.createDataFrame(index, "token int, template int, label string, place int, ranks array<int>, need int")

    reaching = facts.where("lowered is not null")
    lines = reaching.select("row", F.explode(F.split("lowered", _BLOCK_END)).alias("text")).select("row", F.split(joined_words(F.col("text")), " ").alias("words"))
    runs = reaching.select("row", F.explode(F.split("lowered", _PARAGRAPH_END)).alias("text")).where(F.col("text").contains("\n"))
    runs = runs.select("row", F.split(joined_words(F.col("text")), " ").alias("words"))
    step = 2 * max(len(words_of(text)) for _, text in templates)
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(step)), lambda i: F.slice("words", i + 1, 2 * step))
    blocks = lines.unionAll(runs.select("row", F.explode(windows).alias("words")))
    blocks = blocks.select("row", F.array_intersect("words", vocabulary_lit).alias("tokens")).where(F.size("tokens") >= min(need))
    blocks = blocks.select("row", F.array_sort(F.transform("tokens", lambda w: rank_of[w])).alias("held"))
    met = blocks.select("row", "held", F.posexplode("held").alias("at", "token")).join(F.broadcast(index_df), "token")
    met = met.where((F.size("held") >= F.col("need")) & (F.least(F.size("ranks") - F.col("place"), F.size("held") - F.col("at")) >= F.col("need")))
    share = F.size(F.array_intersect("held", "ranks")) / F.size("ranks")
    hits = met.where(F.size(F.array_intersect("held", "ranks")) >= F.col("need")).select("row", "label", share.alias("share"))
    found = hits.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))

    out = facts.drop("tokens", "lowered").join(found, "row", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
