from __future__ import annotations

import math
import random

from momentlake.llm import language

SYLLABLES = {"aa": ["the", "ing", "ou", "th", "er"], "bb": ["sch", "ein", "ü", "ung", "keit"], "cc": ["eau", "é", "que", "tion", "oi"]}


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4)))
    langs = [rng.choice(list(SYLLABLES)) for _ in range(n)]
    return [(i, " ".join(word(x) for _ in range(rng.randrange(3, 80))), x) for i, x in enumerate(langs)]


def test_held_out_accuracy_and_rejection(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(corpus(400, 1), "doc_id long, text string, lang string")
    model = language.fit(docs, per_language=60)
    fresh = corpus(300, 2)
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model).collect()}
    assert sum(got[i]["lang_pred"] == x for i, _, x in fresh) >= 297
    assert all(0 <= r["score"] <= 1 for r in got.values()) and sum(r["rejected"] for r in got.values()) <= 9
    rows = language.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert language.identify(no_docs, model).count() == 0 and language.keep_accepted(no_docs, model).count() == 0
    kept = language.keep_accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(not r["rejected"] for r in rows)


def test_against_brute_force(spark):
    """The model's own tables, looked up subword by subword in plain Python; ties go to the language that sorts first."""
    docs = spark.createDataFrame(corpus(150, 5), "doc_id long, text string, lang string")
    model = language.fit(docs, per_language=40)
    fresh = [*corpus(40, 6), (90, "Über ALLES, 12 naïve ÉTÉ!", None), (91, "a", None)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model).collect()}
    for i, text, _ in fresh:
        data = bytearray()
        for c in text:
            c = c.lower() if c.isascii() or 0xC0 <= ord(c) <= 0xDE else c
            data += c.encode() if c.isalpha() or not c.isascii() else b" "
        total, n = [0.0] * len(model.languages), 0
        for size, factor in ((3, 2654435761), (4, 2246822519)):
            for at in range(len(data) - size + 1):
                if data[at : at + 3] == b"   ":
                    continue
                gram = int.from_bytes(data[at : at + size], "little")
                total = [t + float(v) for t, v in zip(total, model.table[(gram * factor % 2**32) >> (32 - language.BITS)], strict=True)]
                n += 1
        z = [(t / max(n, 1) + float(b)) / model.temperature for t, b in zip(total, model.bias, strict=True)]
        e = [math.exp(v - max(z)) for v in z]
        assert got[i]["lang_pred"] == model.languages[e.index(max(e))]
        assert abs(got[i]["score"] - max(e) / sum(e)) < 1e-5 and got[i]["rejected"] == (max(e) / sum(e) < model.threshold)


def test_prediction_sees_whole_text_only(spark):
    docs = spark.createDataFrame(corpus(200, 3), "doc_id long, text string, lang string")
    model = language.fit(docs, per_language=40)
    text = " ".join(["the"] * 30 + ["schein"] * 400)
    rows = language.identify(spark.createDataFrame([(1, text, "aa"), (2, text, None)], "doc_id long, text string, lang string"), model).collect()
    assert {r["lang_pred"] for r in rows} == {"bb"} and len({r["score"] for r in rows}) == 1


def test_without_labels(spark, no_docs, odd_docs):
    model = language.fit(no_docs)
    assert {r["lang_pred"] for r in language.identify(odd_docs, model).collect()} == {"und"}
    # Nothing was learned, so only texts without a letter go.
    assert language.keep_accepted(odd_docs, model).count() == odd_docs.where(r"text rlike '\\p{L}'").count() > 0
    assert language.keep_accepted(odd_docs.withColumnRenamed("id", "_has_letter"), model).columns[-1] == "_has_letter"
