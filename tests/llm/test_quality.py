from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from momentlake.llm import quality_classifier as Q
from momentlake.llm import quality_rules as R


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def texts():
    rng = random.Random(4)
    out = []
    for i in range(80):
        words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(0, 120))]
        if i % 4 == 0:
            words = words[:10] * rng.randrange(1, 4) + words
        if i % 5 == 0:
            words = [w + rng.choice("#*$%") * 3 for w in words]
        if i % 7 == 0:
            words = [w.upper() + "!!" for w in words]
        out.append(rng.choice([" ", "\n", " \t"]).join(words) + ("\nsame\nsame" if i % 6 == 0 else ""))
    return out


def test_base_counts(spark, odd_docs):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    for df in (docs, odd_docs):
        want = sorted(brute(r["text"]) for r in df.collect())
        got = sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in R.judge_quality(df).collect())
        assert got == want


def test_rules_find_junk(spark):
    rng = random.Random(1)
    prose = lambda: " ".join(("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) + rng.choice(["", "", ",", "."])) for _ in range(120))
    rows = [(i, prose() if i % 4 else prose().replace(" ", "### ") if i % 8 else prose().upper().replace(" ", "!! ")) for i in range(200)]
    kept = {r["doc_id"]: r["kept"] for r in R.judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(kept[i] == bool(i % 4) for i in kept)


def test_estimate_without_texts():
    assert R.estimate([])[0] == 0.0


def test_rules_on_no_rows(no_docs):
    assert R.judge_quality(no_docs).count() == 0


def test_discriminant_matches_densities():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (600, 3))
    model = Q.discriminant({0: (400, a.mean(0), np.cov(a.T, bias=True)), 1: (600, b.mean(0), np.cov(b.T, bias=True))}, 3)
    pooled = 0.4 * np.cov(a.T, bias=True) + 0.6 * np.cov(b.T, bias=True)

    def density(x, own, share):
        cov = (1 - Q.POOLED - Q.SPHERE) * np.cov(own.T, bias=True) + Q.POOLED * pooled + Q.SPHERE * np.diag(np.diag(pooled) + 1e-4) + 1e-6 * np.eye(3)
        d = x - own.mean(0)
        return np.log(share) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    x = rng.normal(0.5, 2, (50, 3))
    want = 1 / (1 + np.exp(-(density(x, b, 0.6) - density(x, a, 0.4)) / Q.TEMPERATURE))
    assert np.allclose(model.score(x), want)


def test_classifier_learns(spark, odd_docs, no_docs):
    rng = random.Random(1)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(30, 150)))
    rows = [(i, prose() if i % 3 else prose().replace(" ", "%%% ").upper()) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 240, 2)] + [(1, None), (None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in Q.classify_quality(docs, labels).collect()}
    assert len(got) == 240 and all(got[i]["predicted"] == int(i % 3 > 0) for i in range(1, 240, 2)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert Q.classify_quality(odd_docs, labels).count() == odd_docs.count()
    assert Q.classify_quality(no_docs, labels).count() == 0
    assert {r["score"] for r in Q.classify_quality(docs, labels.where("quality = 1")).collect()} == {1.0} and {r["score"] for r in Q.classify_quality(docs, labels.limit(0)).collect()} == {0.5}
