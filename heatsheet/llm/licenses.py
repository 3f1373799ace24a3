"""License scans as an exact set-similarity join of text blocks and templates.

A text is cut into blocks of words, each overlapping the next by half, so that whatever is
no longer than the longest template lies in one block. A block meets a template when it
holds ``SHARE`` percent of the template's distinct words or more. Only words of templates can
count, so blocks are sets of those. All sets go by one order, rarest words over all blocks
first. Two sets that share enough must share a word of both prefixes, which is the key of
the join; sizes and the places of the shared word bound what can be shared, and
what the bounds let through is counted exactly. Only built-in functions are used.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of a text whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Percent of a template's words that a block must hold.
SHARE = 80

# Phrases and their labels, and the notices by which licenses are granted.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = {
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit",
    "cc-by-sa": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of "
    "this license, visit",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
    "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means.",
}


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def required(size: int, share: int = SHARE) -> int:
    """Least number of shared words for a template of ``size`` distinct words."""
    return -(-share * size // 100)


def stride(templates: Mapping[str, str]) -> int:
    """Words from one block to the next; a block is twice as long."""
    return max((len(words_of(t)) for t in templates.values()), default=1)


def _words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _places(words: Column, phrases: Mapping[str, str]) -> Column:
    """place and label of every place where a phrase begins; phrases that begin alike all count."""
    def place_of(first: str, more: list[str], label: str):
        def at(word: Column, i: Column) -> Column:
            here = word == first
            for k, other in enumerate(more, 1):
                here = here & F.coalesce(F.get(words, i + k) == other, F.lit(False))
            return F.when(here, F.struct(i.alias("place"), F.lit(label).alias("label")))

        return at

    found = [F.array().cast("array<struct<place:int,label:string>>")]
    for phrase, label in phrases.items():
        first, *more = words_of(phrase)
        some = F.filter(F.transform(words, place_of(first, more, label)), lambda p: p.isNotNull())
        # texts without the longest word of a phrase are not looked through
        found.append(F.when(F.array_contains(words, max((first, *more), key=len)), some))
    return F.flatten(F.array_compact(F.array(*found)))


def read_blocks(docs: DataFrame, phrases: Mapping[str, str], templates: Mapping[str, str], share: int = SHARE) -> DataFrame:
    """doc_id, key, n_words, places and blocks of every row; blocks too small for any template are left out."""
    step = stride(templates)
    vocabulary = sorted({w for t in templates.values() for w in words_of(t)})
    least = min((required(len({*words_of(t)}), share) for t in templates.values()), default=1)
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / step).cast("int") - 2))
    block = F.transform(starts, lambda b: F.array_distinct(F.filter(F.slice("words", b * step + 1, 2 * step), lambda w: w.isin(vocabulary))))
    # the words are made once: a lambda would have them made again for each use
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"), F.explode(F.array(_words(F.col("text")))).alias("words"))
    return rows.select(
        "doc_id", "key", n.cast("long").alias("n_words"), _places(F.col("words"), phrases).alias("places"),
        F.filter(block, lambda b: F.size(b) >= least).alias("blocks"),
    )


def join_templates(blocks: DataFrame, templates: Mapping[str, str], share: int = SHARE) -> DataFrame:
    """key, label, share of every template that a block (key, words) meets; ``share`` is of its words, 0 to 1.

    The vocabulary of the templates bounds what the driver orders and what is sent to tasks.
    """
    spark = blocks.sparkSession
    sets = {label: {*words_of(t)} for label, t in templates.items()}
    counted = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    often = {row["word"]: row["n"] for row in counted}
    order = sorted({w for s in sets.values() for w in s}, key=lambda w: (often.get(w, 0), w))
    rows = []
    for label, words in sets.items():
        ordered = [w for w in order if w in words]
        need = required(len(ordered), share)
        rows += [(w, i, label, need, F.array(*map(F.lit, ordered))) for i, w in enumerate(ordered[: len(ordered) - need + 1])]
    names = ("word", "at_t", "label", "need", "of_t")
    listed = [F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    listed = spark.range(1).select(F.inline(F.array(*listed)))
    least = min(row[3] for row in rows)
    own = F.array_intersect(F.array(*map(F.lit, order)), "words")  # in the common order
    ordered = blocks.select("key", own.alias("words"))
    prefix = F.slice("words", 1, F.size("words") - least + 1)
    entries = ordered.filter(F.size("words") >= least).select("key", "words", F.posexplode(prefix).alias("at_b", "word"))
    entries = entries.filter(F.col("word").isin(sorted({row[0] for row in rows})))
    size_b, size_t = F.size("words"), F.size("of_t")
    behind = F.least(size_t - F.col("at_t"), size_b - F.col("at_b"))  # the shared word and all after it
    met = entries.join(F.broadcast(listed), "word").filter((size_b >= F.col("need")) & (behind >= F.col("need")))
    shared = F.size(F.array_intersect("of_t", "words"))
    met = met.select("key", "label", shared.alias("shared"), "need", size_t.alias("size")).filter("shared >= need")
    return met.select("key", "label", (F.col("shared") / F.col("size")).alias("share"))


def scan(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, share: int = SHARE
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Base labels are those of phrases whose words stand in the text one after the other;
    first_word and last_word are the first and last place where one begins, null without
    any. ``labels`` adds those of all templates that a block of the text meets; a text
    that holds a template within a longer one meets both. ``score`` is 1 with a base
    label, else the largest share of a template's words found, or 0 where none is met.
    A null text is an empty one. Rows of equal text get equal results, whatever their ids;
    further columns are not looked at.
    """
    found = settle(read_blocks(docs.select("doc_id", "text"), phrases, templates, share))
    base = F.array_sort(F.array_distinct("places.label"))
    places = F.col("places.place")
    rows = found.select(
        "doc_id", "key", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), base.alias("base"),
    )
    if templates:
        blocks = found.select("key", F.explode("blocks").alias("words"))
        met = join_templates(blocks, templates, share)
        met = settle(met.groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("more"), F.max("share").alias("share")))
        rows = rows.join(met.withColumnRenamed("key", "__key"), F.col("key") == F.col("__key"), "left")
    else:
        rows = rows.withColumns({"more": F.lit(None).cast("array<string>"), "share": F.lit(None).cast("double")})
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
