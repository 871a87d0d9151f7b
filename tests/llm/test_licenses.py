from __future__ import annotations

import random
import re

from momentlake.llm import licenses as L

TEXTS = [
    "All Rights Reserved. all rights\nreserved", "Licensed under CC BY-NC 4.0.", "cc by cc by", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any person obtaining a new copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense",
    "under the terms of the agreement nothing is granted", "", None, "é all rights 漢 reserved", "general public license",
]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    places = [(i, name) for phrase, name in L.PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, sorted({n for _, n in places})


def test_base_and_labels(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in L.scan_licenses(docs).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text)
        assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
    assert rows[3]["labels"] == rows[5]["labels"] == ["mit"] and "cc-by-nc" in rows[1]["labels"] and rows[6]["labels"] == []
    assert rows[5]["score"] > 0.6 and rows[5]["spans"][0]["first_word"] == 0


def test_findings_of_every_template_with_edits(spark):
    """Each template is found, whole, with words put in, taken out or replaced, and with a paragraph in its middle; its words stand where the span says."""
    rng = random.Random(4)
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    docs, want = [], []
    for label, template in L.TEMPLATES:
        words = template.split()
        for kind in range(4):
            body, n = list(words), len(words)
            if kind == 1 and n > 20:
                for _ in range(n // 25):
                    at = rng.randrange(len(body))
                    body[at : at + rng.randrange(2)] = noise(1)
            elif kind == 2 and n > 20:
                body[n // 2 : n // 2] = noise(12)
            elif kind == 3 and n > 20:
                body = body[: int(0.7 * n)]
            before = noise(rng.randrange(9))
            docs.append((len(docs), " ".join([*before, *body, *noise(5)]).capitalize()))
            want.append((label, len(before), len(before) + len(body) - 1))
    got = {r["doc_id"]: r for r in L.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, (label, first, last) in enumerate(want):
        spans = [s for s in got[i]["spans"] or [] if s["label"] == label]
        assert label in got[i]["labels"] and any(abs(s["first_word"] - first) <= 4 and abs(s["last_word"] - last) <= 4 for s in spans), (docs[i], want[i], spans)


def test_words_alone_are_no_notice(spark):
    """Parts of notices, their words in another order, and prose with their words give no label."""
    rng = random.Random(6)
    texts = ["licensed under the stars", "under the mit tree", "copies of the software and to permit persons", "you may not use this file today"]
    texts += [" ".join(rng.sample(t.split(), len(t.split()))) for _, t in L.TEMPLATES if len(t.split()) > 8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r["labels"] == r["base_labels"] for r in L.scan_licenses(docs).collect())


def test_odd_rows(odd_docs, no_docs):
    assert L.scan_licenses(odd_docs).count() == odd_docs.count()
    assert L.scan_licenses(no_docs).count() == 0


def labels_of(spark, texts):
    rows = L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(set(r["base_labels"]), set(r["labels"])) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_every_notice_gives_its_own_label_only(spark):
    found = labels_of(spark, [f"Some words before it. {t} And more words after it." for _, t in L.TEMPLATES])
    for (label, text), (base, got) in zip(L.TEMPLATES, found, strict=True):
        assert got == base | {label}, text


def test_short_notices_with_a_changed_word_give_nothing(spark):
    short = [t.split(" ") for _, t in L.TEMPLATES if len(t.split(" ")) <= L.SHORT_WORDS]
    changed = [" ".join([*w[:i], "umbrella", *w[i + 1 :]]) for w in short for i in range(len(w))]
    assert len(changed) > 60
    for text, (base, got) in zip(changed, labels_of(spark, changed), strict=True):
        assert got == base, text


def test_families_are_told_apart(spark):
    free = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
    hope = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
    cc = "This work is licensed under a Creative Commons Attribution{0} 4.0 International License."
    texts = {
        free.format("program", "", "2"): {"gpl"}, (free + hope).format("program", "", "3"): {"gpl"}, (free + hope).format("library", "Lesser ", "2.1"): {"lgpl"}, (free + hope).format("program", "Affero ", "3"): {"agpl"}, hope.format("library", "Lesser "): {"lgpl"},
        cc.format(""): {"cc-by"}, cc.format("-NonCommercial"): {"cc-by-nc"}, cc.format("-ShareAlike"): {"cc-by-sa"}, cc.format("-NonCommercial-ShareAlike"): set(), cc.format("-NoDerivatives"): set(), "he was released under the MIT umbrella": set(),
    }
    for (text, want), (base, got) in zip(texts.items(), labels_of(spark, list(texts)), strict=True):
        assert got == base | want, text
