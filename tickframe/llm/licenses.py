"""Operator 11, license scans by diagonal voting.

Every text is cut into lower-cased words (A-Z only; digits, letters and all
non-ASCII characters are word characters). All its rolling word k-grams
are hashed and joined with the template positions of the same gram. A hit
votes for the diagonal ``text position - template position``; neighbouring
diagonals of one template (words inserted or left out) are merged into one
span, and a span is verified by the share of the template's words that its
grams cover. The join also compares the words themselves, so a hash collision
casts no vote.

Two kinds of templates share this path: short phrases (grams of 2 words, only
whole and contiguous places count) and notices (grams of 4 words, spans that
cover at least ``min_share`` of the notice).

Scale: all in JVM expressions, texts are read once and never shuffled. The
template table is broadcast up to ``MAX_BROADCAST_GRAMS`` grams (its exact
length is known before the join); beyond it the join is left to the planner, with
AQE splitting grams that are frequent on the text side. Only hits leave the scan
(plus one row per document), combined map side; a group is one
document's hits on one template.

* null or empty text: no words, no spans, score 0, ``labels`` empty;
* very long texts are scanned whole; every place counts, however many;
* a text under 4 words can hold phrases but no notice;
* several labels may apply to one place; ties need no order, as labels are sorted;
* repeated rows each give one row; rows that share an id but not the text are judged apart;
* null ids are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.llm.common import ascii_lower, stored

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE_WORDS, NOTICE_WORDS = 2, 4
MIN_SHARE = 0.5
# Diagonals this close belong to one span of a notice: words may be inserted, dropped or replaced.
MAX_SHIFT = 8
MAX_BROADCAST_GRAMS = 1_000_000

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public texts of common license notices.
NOTICES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License,
        or (at your option) any later version."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("cc-by", """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy
        of this license, visit http://creativecommons.org/licenses/by/4.0/"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means."""),
]


@dataclass(frozen=True)
class Template:
    """A text to look for; ``base`` ones count only where all their words stand together."""
    label: str
    words: tuple[str, ...]
    base: bool

    @property
    def gram(self) -> int:
        return PHRASE_WORDS if self.base else NOTICE_WORDS


def template(label: str, text: str, base: bool = False) -> Template:
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    found = Template(label, tuple(w for w in re.split(NOT_WORD, lower) if w), base)
    if len(found.words) < found.gram:
        raise ValueError(f"a template of {found.gram}-word grams needs as many words: {text!r}")
    return found


TEMPLATES = ([template(label, text, base=True) for text, label in PHRASES.items()]
             + [template(label, text) for label, text in NOTICES])

# What marks the one row that every document sends besides its hits; template number, never a gram.
_DOCUMENT = -1


def gram_hashes(words: Column) -> tuple[Column, Column]:
    """Hashes of all 2-word and all 4-word grams, in text order; empty where there are too few words."""
    pairs = lambda a, step: F.zip_with(
        F.slice(a, F.lit(1), F.greatest(F.size(a) - step, F.lit(0))),
        F.slice(a, F.lit(1 + step), F.greatest(F.size(a) - step, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    two = pairs(words, 1)
    return two, pairs(two, 2)


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """One row per template position: gram hash, template, label, size in words, position, words."""
    rows = [(i, t.label, t.base, len(t.words), p, list(t.words[p:p + t.gram]))
            for i, t in enumerate(templates) for p in range(len(t.words) - t.gram + 1)]
    rows.append((_DOCUMENT, None, False, 0, 0, []))
    table = spark.createDataFrame(rows, "template int, label string, base boolean, size int, tpos int, "
                                        "gram array<string>")
    two, four = gram_hashes(F.col("gram"))
    key = F.when(F.size("gram") == 0, F.lit(0).cast("long")).when(F.col("base"), two[0]).otherwise(F.get(four, 0))
    table = table.select(key.alias("hash"), "template", "label", "base", "size", "tpos", "gram")
    return F.broadcast(table) if len(rows) <= MAX_BROADCAST_GRAMS else table


def votes(docs: DataFrame, templates: list[Template] | None = None, text: str = "text",
          id_col: str = "doc_id") -> DataFrame:
    """Positions voted for, by ``(key, id, n_words, template, diagonal)``, and a row per document (template -1)."""
    spark = docs.sparkSession
    lower = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    # rows with equal id and text share a key (and are counted); others never meet
    key = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-")), F.lit("\0"),
                         F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("-"))))
    data = docs.select(F.col(id_col).alias("id"), key.alias("key"),
                       F.array_remove(F.split(lower, NOT_WORD, -1), "").alias("words"))
    two, four = gram_hashes(F.col("words"))
    mark = F.array(F.lit(0).cast("long"))
    data = data.select("id", "key", "words", F.size("words").cast("long").alias("n_words"),
                       F.posexplode(F.concat(mark, two, four)).alias("at", "hash"))
    n_two = F.greatest(F.col("n_words") - 1, F.lit(0))
    data = data.withColumn("is_two", F.col("at") <= n_two).withColumn(
        "place", (F.col("at") - 1 - F.when(F.col("is_two"), 0).otherwise(n_two)).cast("long"))
    same_words = F.slice("words", F.col("place").cast("int") + 1, F.size("gram")) == F.col("gram")
    vote = (F.col("at") > 0) & (F.col("template") >= 0) & (F.col("is_two") == F.col("base")) & same_words
    hit = data.join(template_grams(spark, templates or TEMPLATES), "hash").filter(
        F.when(F.col("at") == 0, F.col("template") == _DOCUMENT).otherwise(vote))
    diagonal = F.when(F.col("template") >= 0, F.col("place") - F.col("tpos")).otherwise(F.lit(0).cast("long"))
    return hit.groupBy("key", "id", "n_words", "template", "label", "base", "size", diagonal.alias("diagonal")).agg(
        F.collect_set("tpos").alias("tpos"), F.count(F.lit(1)).alias("rows"))


def merged_spans(voted: DataFrame, max_shift: int = MAX_SHIFT) -> DataFrame:
    """Spans with the share of the template they hold: neighbouring diagonals of a notice as one.

    ``start``/``end`` are word positions, end exclusive. A phrase's diagonals are never merged.
    """
    line = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > F.when(F.col("base"), 0).otherwise(max_shift)
    runs = voted.filter(F.col("template") >= 0).withColumn("new", F.coalesce(apart.cast("int"), F.lit(1)))
    runs = runs.withColumn("span", F.sum("new").over(line))
    gram = F.when(F.col("base"), PHRASE_WORDS).otherwise(NOTICE_WORDS)
    runs = runs.select("key", "id", "template", "label", "base", "size", "span",
                       (F.col("diagonal") + F.array_min("tpos")).alias("first"),
                       (F.col("diagonal") + F.array_max("tpos") + gram).alias("last"),
                       F.flatten(F.transform("tpos", lambda p: F.sequence(p, p + gram - 1))).alias("covered"))
    spans = runs.groupBy("key", "id", "template", "label", "base", "size", "span").agg(
        F.min("first").alias("start"), F.max("last").alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("held"))
    return spans.withColumn("share", F.col("held") / F.col("size")).drop("span", "held")


def license_spans(docs: DataFrame, templates: list[Template] | None = None, min_share: float = MIN_SHARE,
                  text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Verified spans: id, label, whether a base phrase, first word, end word, share of the template."""
    spans = merged_spans(votes(docs, templates, text, id_col)).filter(_verified(min_share))
    return spans.select(F.col("id").alias(id_col), "label", "base", "start", "end", "share")


def _verified(min_share: float) -> Column:
    return F.col("share") >= F.when(F.col("base"), 1.0).otherwise(min_share)


def license_report(docs: DataFrame, templates: list[Template] | None = None, min_share: float = MIN_SHARE,
                   text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: words, places of base phrases, labels, and a score.

    ``score`` is 1 where a base phrase stands, else the largest share of a
    notice held in one span (0 without any).
    """
    voted = stored(votes(docs, templates, text, id_col), "license-votes")  # read twice: the texts only once
    documents = voted.filter(F.col("template") == _DOCUMENT).select(
        "key", "id", "n_words", "rows", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("label", "string"), ("base", "boolean"), ("start", "long"), ("share", "double"))])
    spans = merged_spans(voted).select("key", "id", F.lit(None).cast("long").alias("n_words"),
                                       F.lit(None).cast("long").alias("rows"), "label", "base", "start", "share")
    whole = F.col("base") & (F.col("share") >= 1.0)
    label = F.when(_verified(min_share), F.col("label"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    report = documents.unionByName(spans).groupBy("key", "id").agg(
        F.max("n_words").alias("n_words"), F.max("rows").alias("rows"),
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).alias("first_word"),
        F.max(F.when(whole, F.col("start"))).alias("last_word"),
        joined(F.when(whole, F.col("label"))).alias("base_labels"), joined(label).alias("labels"),
        F.max(F.when(whole, 1.0).when(~F.col("base"), F.col("share"))).alias("score"))
    each = report.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
                       "labels", F.coalesce("score", F.lit(0.0)).alias("score"))
