"""License scans: phrases that stand in a text, and text blocks that hold a notice, found by an exact set-similarity join.

Blocks (lines, and paragraphs between empty lines) and templates are sets of words. Words of templates are ordered by
their document frequency, rare ones first. A block holds a template if it has at least need of its words; then the
two share a word of the template's first (size - need + 1). Such pairs are found by an equi-join on the word, dropped
where lengths or positions leave too few words, and verified. All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torvane.llm.shared import cut, release

# Phrases with their labels, and notices with theirs.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words; A-Z count as words before they are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _tokens(text: str) -> list[str]:
    out, word = [], ""
    for c in text.translate(str.maketrans(UPPER, LOWER)) + " ":
        if c in LOWER or c in "0123456789" or ord(c) > 127:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def _phrase_columns(phrases: dict[str, str]) -> tuple[dict, dict, dict]:
    """Three steps of columns: the text as words between blanks, its pieces around each phrase, and what these say."""
    tail = "|".join(sorted({p.split()[-1] for p in phrases}))
    spaced = F.when(F.col("text").rlike(f"(?i)(?:{tail})"), F.concat(F.lit(" "), F.array_join(words(lowered(F.col("text"))), " "), F.lit(" ")))
    pieces = {f"p{i}": F.split("spaced", f"(?<= ){p}(?= )") for i, p in enumerate(phrases)}
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    facts = []
    for i, p in enumerate(phrases):
        own = F.col(f"p{i}")
        first = blanks(F.element_at(own, 1)) - 1
        last = F.col("n_words") - (blanks(F.element_at(own, -1)) - 1) - len(p.split())
        facts.append(F.when(F.size(own) > 1, F.struct((F.size(own) - 1).cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"), F.lit(phrases[p]).alias("label"))))
    return {"spaced": spaced}, pieces, {"facts": F.array_compact(F.array(*facts))}


def scan(docs: DataFrame, *, threshold: float = 0.8, phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of all documents (doc_id, text).

    Base: places where a phrase's words follow each other. labels adds those of notices of which a line or paragraph
    holds at least threshold of the distinct words; score is the largest share so held, 1 where a phrase stands, else
    0. Null and empty texts have no words, no places and empty labels; repeated rows are each returned; other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = [(label, sorted({*_tokens(text)})) for label, text in notices]
    vocabulary = sorted({t for _, ts in sets for t in ts})
    found = docs.select(F.explode(F.array_intersect(F.array_distinct(words(F.lower("text"))), _strings(vocabulary))).alias("token"))
    count = {r[0]: r[1] for r in found.groupBy("token").count().collect()}  # at most a row for each word of the notices
    order = sorted(vocabulary, key=lambda t: (count.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    index, rows = [], []
    for k, (label, ts) in enumerate(sets):
        ts, need = sorted(ts, key=rank.get), max(1, math.ceil(threshold * len(ts) - 1e-9))
        rows.append((k, label, ts, len(ts), need))
        index += [(t, k, p, len(ts), need) for p, t in enumerate(ts[: len(ts) - need + 1])]
    prefix = _strings(sorted({t for t, *_ in index}))
    least = min((need for *_, need in rows), default=1)

    flat = F.col("text")
    blocks = F.array_union(F.split(flat, "\n"), F.filter(F.split(flat, r"\n[\x20\x09-\x0D]*\n"), lambda b: F.contains(b, F.lit("\n"))))
    hold = F.filter(blocks, lambda b: F.arrays_overlap(words(lowered(b)), prefix))
    spaced, pieces, facts = _phrase_columns(phrases)
    told = docs.withColumn("n_words", F.size(words(F.col("text"))).cast("long")).withColumns(spaced).withColumns(pieces).withColumns(facts)
    any_prefix = "|".join(sorted({t for t, *_ in index})) or "(?!)"
    told = told.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "n_words", "facts", F.when(F.col("text").rlike(f"(?i){any_prefix}"), hold).alias("blocks"))
    told = cut(told)

    placed = told.filter(F.size("blocks") > 0).select("key", F.explode("blocks").alias("block")).select("key", F.xxhash64("block").alias("b"), "block").distinct()
    texts = placed.groupBy("b").agg(F.first("block").alias("block"))
    own = texts.select("b", F.array_intersect(_strings(order), words(lowered(F.col("block")))).alias("own")).withColumn("m", F.size("own"))
    probes = own.filter(F.col("m") >= least).select("b", "own", "m", F.posexplode(F.slice("own", F.lit(1), F.col("m") - least + 1)).alias("q", "token"))
    firsts = F.broadcast(spark.createDataFrame(index, "token string, notice int, p int, n int, need int"))
    room = 1 + F.least(F.col("m") - F.col("q") - 1, F.col("n") - F.col("p") - 1)
    near = probes.join(firsts, "token").filter((F.col("m") >= F.col("need")) & (room >= F.col("need"))).select("b", "own", "notice").distinct()
    whole = F.broadcast(spark.createDataFrame(rows, "notice int, label string, tokens array<string>, n int, need int"))
    common = F.size(F.array_intersect("own", "tokens"))
    held = near.join(whole, "notice").withColumn("common", common).filter("common >= need").select("b", "label", (F.col("common") / F.col("n")).alias("share"))
    by_key = placed.select("key", "b").join(held, "b").groupBy("key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))

    base = F.array_sort(F.array_distinct(F.transform("facts", lambda x: x.label)))
    out = told.drop("blocks").join(by_key, "key", "left")
    out = cut(out.select(
        "doc_id", "n_words",
        F.aggregate("facts", F.lit(0).cast("long"), lambda a, x: a + x.n).alias("n_base"),
        F.array_min(F.transform("facts", lambda x: x.first)).alias("first_word"),
        F.array_max(F.transform("facts", lambda x: x.last)).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("facts") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    ))
    release(told)
    return out
