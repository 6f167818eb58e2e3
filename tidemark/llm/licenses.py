"""License scans by diagonal voting over word k-grams.

Every word k-gram of every text is hashed and joined to the positions at which templates
have that hash. A pair of a document's position and a template's lies on a diagonal, their
difference; votes are aggregated by diagonal, and diagonals at most ``slack`` words apart
are merged, so a quotation with words put in or left out still meets in one place. A merged
place is verified exactly: each vote compares the k words themselves, and the place's
agreement is the number of template words that votes cover, over the words of the template
or of the place, whichever are more. It needs LEAST, and all words that the template marks
as telling (a version's number), each in a vote together with the word before it.

Phrases are templates too, without slack: all their words must stand in a row.

The votes of a document are as many as its own words and the templates' repeats allow, and
only they are shuffled, by document; texts are not. Templates are broadcast up to
BROADCAST_GRAMS k-grams, and joined by shuffle beyond.

Nulls and odd input: a null text is empty, has no word and no place. Repeated rows give
their result each; rows of one doc_id and different texts are kept apart. An empty table
gives none. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import prepare

K, LEAST, BROADCAST_GRAMS = 3, 0.8, 1 << 20
#: Fixed value: a word, in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that name a license by themselves, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Texts of license notices, and their labels. A telling word has a # before it.
NOTICES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "bsd"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-3"),
    ("Licensed under the Apache License, Version #2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2"),
    ("redistribute it and/or modify it under the terms of the GNU #General Public License as published by the Free Software Foundation, either version #3 of the License, or (at your option) any later version.", "gpl-3"),
    ("redistribute it and/or modify it under the terms of the GNU #General Public License as published by the Free Software Foundation; either version #2 of the License, or (at your option) any later version.", "gpl-2"),
    ("licensed under the GNU #General Public License, version #3", "gpl-3"),
    ("licensed under the GNU #General Public License, version #2", "gpl-2"),
    ("under the terms of the GNU #Lesser General Public License", "lgpl"),
    ("licensed under the GNU #Affero General Public License, version #3", "agpl-3"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. #2.0.", "mpl-2"),
    ("licensed under a Creative Commons #Attribution #4.0 International License", "cc-by"),
    ("licensed under a Creative Commons Attribution #ShareAlike #4.0 International License", "cc-by-sa"),
    ("licensed under a Creative Commons Attribution #NonCommercial #4.0 International License", "cc-by-nc"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "cc0"),
]


@dataclass
class Template:
    """Words of a phrase or notice; places of telling words; diagonals at most ``slack`` apart merge."""

    label: str
    words: list[str]
    telling: list[int]
    slack: int
    base: bool

    @classmethod
    def of(cls, text: str, label: str, base: bool = False) -> Template:
        marked = re.findall(r"#?[A-Za-z0-9\u0080-\U0010FFFF]+", text)
        words = [w.lstrip("#").translate(str.maketrans(_UPPER, _LOWER)) for w in marked]
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text}")
        return cls(label, words, [i for i, w in enumerate(marked) if w[0] == "#"], 0 if base else min(8, len(words) // 8), base)


def templates() -> list[Template]:
    return [*(Template.of(text, label, True) for text, label in PHRASES), *(Template.of(text, label) for text, label in NOTICES)]


def _low(word: Column) -> Column:
    return F.translate(word, _UPPER, _LOWER)


def _hash(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(K)])


def template_grams(spark: SparkSession, known: list[Template]) -> DataFrame:
    """The k-grams of all templates, with their hash and place."""
    rows = [(t, i, x.words[i : i + K]) for t, x in enumerate(known) for i in range(len(x.words) - K + 1)]
    grams = spark.createDataFrame(rows, "template int, at int, gram array<string>").withColumn("hash", _hash(F.col("gram"), F.lit(0)))
    return F.broadcast(grams) if len(rows) <= BROADCAST_GRAMS else grams


def votes(docs: DataFrame, known: list[Template]) -> DataFrame:
    """doc_id, h (hash of the text), template, diagonal and pos of every vote, with how many equal rows cast it.

    Every document has one row more, of template -1, with its number of words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), F.regexp_extract_all(text, F.lit(_ANY_CASE), 0).alias("words"))
    rows = rows.select("doc_id", "h", F.transform("words", _low).alias("words"), F.size("words").cast("long").alias("n_words"))
    last = F.col("n_words").cast("int") - K
    # A gram's own words go with its hash: a row that carried all words would be as long as the text.
    gram = lambda i: F.struct(_hash(F.col("words"), i).alias("hash"), F.array(*[F.get("words", i + j) for j in range(K)]).alias("words"))
    kind = "array<struct<hash: bigint, words: array<string>>>"
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), gram)).otherwise(F.array().cast(kind))
    each = rows.select("doc_id", "h", "n_words", F.posexplode(F.concat(F.array(F.lit(None)).cast(kind), grams)).alias("pos", "own"))
    each = each.withColumn("hash", F.col("own.hash"))
    met = each.join(template_grams(docs.sparkSession, known), "hash", "left")
    met = met.where((F.col("pos") == 0) | (F.col("own.words") == F.col("gram")))  # the first gram is at 1
    pos = F.col("pos") - 1
    keys = ["doc_id", "h", F.coalesce("template", F.lit(-1)).alias("template"), F.coalesce(pos - F.col("at"), F.lit(0)).alias("diagonal"), pos.alias("pos")]
    return met.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words"))


def places(cast: DataFrame, known: list[Template]) -> DataFrame:
    """Merged diagonals with their first word, end, covered template words and agreement.

    The row of a document itself stays, as a place of no template.
    """
    spark = cast.sparkSession
    rows = [(t, x.label, len(x.words), x.telling, x.slack, x.base) for t, x in enumerate(known)]
    table = F.broadcast(spark.createDataFrame(rows, "template int, label string, size int, telling array<int>, slack int, base boolean"))  # a row a template
    by = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal", "pos")
    met = cast.join(table, "template", "left")
    far = F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= F.col("slack"), 0).otherwise(1)
    met = met.withColumn("new", far).withColumn("place", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.collect_set((F.col("pos") - F.col("diagonal")).cast("int")).alias("at")  # a template's places at most
    found = met.groupBy("doc_id", "h", "template", "label", "size", "telling", "base", "place").agg(F.min("pos").alias("start"), (F.max("pos") + K).alias("end"), at, F.max("copies").alias("copies"), F.max("n_words").alias("n_words"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + K - 1))))
    found = found.withColumn("covered", covered).withColumn("agreement", F.size("covered") / F.greatest(F.col("size"), F.col("end") - F.col("start")))
    told = F.forall("telling", lambda p: F.exists("at", lambda a: (a > p - K) & (a <= F.greatest(p - 1, F.lit(0)))))
    enough = (F.col("agreement") >= F.when(F.col("base"), 1.0).otherwise(LEAST)) & told
    own = F.col("template") >= 0
    return found.withColumns({"whole": own & enough, "agreement": F.when(own, F.col("agreement"))})


def scan_licenses(docs: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, places and score of every row.

    places: start and end (words, from 0), label, template, agreement and base of what was
    verified, by start; score: the largest agreement, also where it was not enough.
    """
    known = known or templates()
    prepare(docs.sparkSession)
    place = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label", "template", "agreement", "base")
    every = places(votes(docs, known), known).groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_list(F.when(F.col("whole"), place))).alias("places"), F.coalesce(F.max("agreement"), F.lit(0.0)).alias("score"),
        F.max("n_words").alias("n_words"), F.max(F.when(F.col("template") < 0, F.col("copies"))).cast("int").alias("copies"),
    )
    return every.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "n_words", "places", "score")
