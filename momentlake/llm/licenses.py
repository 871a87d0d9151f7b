"""License scans by diagonal voting, in DataFrame functions only.

One pass over the texts rolls k-grams of words and keeps those whose hash some known notice has, with their words. They are joined
with the positions at which notices have them, word by word. A hit votes for the diagonal text position minus template position;
votes are grouped per text, template and diagonal, diagonals that lie close together are merged (words put in or left out shift a
match), and so are runs that follow each other in text and template. What covers enough of its template, all of a short one, is a
finding; where several variants of one notice match the same place, the one with the most words of it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bind, lower_ascii, materialize

#: k-grams; merged are diagonals at most SHIFT apart, and runs in order with at most GAP words between them.
K, SHIFT, GAP, COVERAGE = 3, 3, 40, 0.6
#: Notices of up to so many words are found only whole: a word more or less makes another licence of them.
SHORT_WORDS = 12
#: Templates that share this part of the shorter one's k-grams are variants of one notice, of which a place in a text has the best one only.
VARIANT = 0.6
#: Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public licences that fit a page, and the notices of longer ones, by label.
_FREE = "this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1}general public license as published by the free software foundation either version {2} of the license or at your option any later version"
_HOPE = "this {0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {1}general public license for more details you should have received a copy of the gnu {1}general public license along with this {0}"
_GNU = (("gpl", "program", "", "3"), ("lgpl", "library", "lesser ", "2 1"), ("agpl", "program", "affero ", "3"))
TEMPLATES = (
    *((label, text.format(what, kind, version)) for text in (_FREE, _HOPE) for label, what, kind, version in _GNU),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd", "licensed under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("boost-1.0", "distributed under the boost software license version 1 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
)


def words_of(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lowered; a null text has none."""
    plain = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _notices() -> list[int]:
    """Of each template the first one that it is a variant of, or itself."""
    grams = [{tuple(w[i : i + K]) for i in range(len(w) - K + 1)} for _, text in TEMPLATES for w in [text.split(" ")]]
    out: list[int] = []
    for i, g in enumerate(grams):
        out.append(next((out[j] for j in range(i) if len(g & grams[j]) >= VARIANT * min(len(g), len(grams[j]))), i))
    return out


def template_grams(spark: SparkSession) -> DataFrame:
    """h, own (its words), template, label, notice, at, grams, least (the share to be found): a fixed table of under two thousand rows."""
    rows = [(i, label, text, notice, 1.0 if len(text.split(" ")) <= SHORT_WORDS else None) for i, ((label, text), notice) in enumerate(zip(TEMPLATES, _notices(), strict=True))]
    known = spark.createDataFrame(rows, "template int, label string, text string, notice int, least double")
    rolled = known.withColumn("w", F.split("text", " ")).withColumn("g", F.transform(F.sequence(F.lit(1), F.size("w") - (K - 1)), lambda i: F.slice("w", i, K)))
    return rolled.select("template", "label", "notice", F.size("g").alias("grams"), "least", F.posexplode("g").alias("at", "own")).withColumn("h", F.xxhash64("own"))


def base_places(w: Column) -> Column:
    """Array of struct<at, label>: where the words of a phrase stand consecutively."""

    def here(i: Column, phrase: str) -> Column:
        same = F.lit(True)
        for j, p in enumerate(phrase.split(" ")):
            same = same & F.coalesce(F.get(w, i + j) == p, F.lit(False))
        return same

    def label(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            out = F.when(here(i, phrase), name).otherwise(out)
        return out

    # Only words that begin a phrase are looked at further; a word begins one phrase at most.
    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(*[p.split(" ")[0] for p in PHRASES]))
    found = F.filter(F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), label(i).alias("label"))), lambda x: x["label"].isNotNull())
    return F.when(F.size(w) > 0, found).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))


def _measured(docs: DataFrame, known: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, th (hash of the text), n_words, base (see base_places) and hits: position, hash and words of the k-grams that a template has; written."""
    hashes = [r[0] for r in known.select("h").distinct().collect()]  # of the fixed templates

    def hits(w: Column) -> Column:
        rolled = F.transform(F.sequence(F.lit(1), F.size(w) - (K - 1)), lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(F.slice(w, i, K)).alias("h")))
        met = F.transform(F.filter(rolled, lambda x: x["h"].isin(*hashes)), lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), F.slice(w, x["pos"] + 1, K).alias("words")))
        return F.when(F.size(w) >= K, met).otherwise(F.array().cast("array<struct<pos:int,h:bigint,words:array<string>>>"))

    w = bind(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), base_places(w).alias("base"), hits(w).alias("hits")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), w.alias("w"))
    return materialize(rows.select("doc_id", "th", "w.*"), "notices")


def _findings(measured: DataFrame, known: DataFrame, coverage: float, shift: int, gap: int) -> DataFrame:
    """Findings: doc_id, th, label, template, first_word, last_word (inclusive), score (share of the template's k-grams found)."""
    rolled = measured.where(F.size("hits") > 0).select("doc_id", "th", F.explode("hits").alias("x")).select("doc_id", "th", "x.*")
    # The templates are fixed; equal hashes count only with equal words.
    hits = rolled.join(F.broadcast(known), "h").where(F.col("words") == F.col("own")).withColumn("diagonal", F.col("pos") - F.col("at"))
    key = ["doc_id", "th", "template", "label", "notice", "grams", "least"]
    votes = hits.groupBy(*key, "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("at").alias("from"), F.max("at").alias("to"))
    one = Window.partitionBy("doc_id", "th", "template")

    def merged(rows: DataFrame, fresh: Column, order: list[str]) -> DataFrame:
        by = one.orderBy(*order)
        runs = rows.withColumn("fresh", fresh).withColumn("run", F.sum(F.coalesce(F.col("fresh").cast("int"), F.lit(0))).over(by))
        return runs.groupBy(*key, "run").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("from").alias("from"), F.max("to").alias("to"))

    by_diagonal, in_text = one.orderBy("diagonal"), one.orderBy("lo", "hi", "from")
    runs = merged(votes, F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > shift, ["diagonal"])
    # A run within the text of another is an echo: words that the template has twice.
    before = one.orderBy("lo", F.desc("hi"), F.desc(F.size("ats")), "from").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("reach", F.max("hi").over(before)).where(F.col("reach").isNull() | (F.col("hi") > F.col("reach"))).drop("run", "reach")
    apart = (F.col("from") <= F.lag("from").over(in_text)) | (F.col("to") <= F.lag("to").over(in_text)) | (F.col("lo") - F.lag("hi").over(in_text) > gap + K)
    found = merged(runs, apart, ["lo", "hi", "from"]).withColumn("score", F.size("ats") / F.col("grams"))
    found = found.where(F.col("score") >= F.coalesce("least", F.lit(coverage)))
    # Variants that match one place overlap there.
    variants = Window.partitionBy("doc_id", "th", "notice").orderBy("lo", "hi", "template")
    apart = F.col("lo") > F.max("hi").over(variants.rowsBetween(Window.unboundedPreceding, -1))
    placed = found.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("place", F.sum("apart").over(variants))
    best = Window.partitionBy("doc_id", "th", "notice", "place").orderBy(F.desc(F.size("ats")), F.desc("score"), "template")
    found = placed.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return found.select("doc_id", "th", "label", "template", F.col("lo").alias("first_word"), (F.col("hi") + K - 1).alias("last_word"), "score")


def find_notices(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE, shift: int = SHIFT, gap: int = GAP) -> DataFrame:
    """Verified spans: doc_id, th (hash of the text), label, template, first_word, last_word (inclusive), score (share of the template's k-grams found)."""
    known = template_grams(docs.sparkSession)
    return _findings(_measured(docs, known, doc_id, text), known, coverage, shift, gap)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE, shift: int = SHIFT) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels and labels (arrays), score, spans.

    Labels are the base ones and those of verified notices: notices of up to SHORT_WORDS words whole, of longer ones the share `coverage`,
    and of the variants of one notice the one that matches best; the score is 1 with a base place, else the best coverage, else 0.
    A null, empty or blank text has no words. Null ids are allowed; repeated rows get the same answer each; other columns are
    ignored; an empty table gives no rows.
    """
    known = template_grams(docs.sparkSession)
    rows = _measured(docs, known, doc_id, text)
    # A repeated row repeats its hits, but coverage counts template positions once.
    spans = _findings(rows, known, coverage, shift, GAP).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("first_word", "last_word", "label", "score"))).alias("spans")).toDF("_d", "_t", "spans")
    joined = rows.join(spans.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    extra = F.coalesce(F.transform("spans", lambda x: x["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))
    return joined.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.get("base", F.lit(0))["at"].alias("first_word"), F.element_at(F.when(F.size("base") > 0, F.col("base")), -1)["at"].alias("last_word"), base.alias("base_labels"), F.array_sort(F.array_union(base, extra)).alias("labels"), F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(best, F.lit(1.0))).alias("score"), "spans")
