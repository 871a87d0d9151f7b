from __future__ import annotations

import random
import re

import numpy as np

from momentlake.llm import toxicity
from momentlake.llm.common import mix64, word_hashes


def corpus(n, seed):
    rng = random.Random(seed)
    bad = ["idiota", "stoopid", "grimble", "vexlo"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(20, 90))]
        if toxic := i % 5 == 0:
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "", "s"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (900, 4)).astype(np.float32)
    z = x @ np.array([2.0, 1.5, -1.0, 0.0]) + rng.logistic(size=900) * 0.5
    grades = (z > 0.5).astype(int) + (z > 1.5) + (z > 2.5)
    w, theta = toxicity.fit_ordinal(x, grades, 3)
    assert np.all(np.diff(theta) > 0) and w[0] > w[1] > abs(w[3]) and w[2] < 0


def test_held_out(spark, odd_docs, no_docs):
    rows, labels = corpus(600, 1)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    fresh, truth = corpus(300, 2)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    right = sum(got[i]["toxic"] == bool(t) for i, t in truth)
    assert right >= 294 and all(0 <= r["score"] <= 1 and 0 <= r["severity"] <= 3 for r in got.values())
    assert toxicity.score_toxicity(odd_docs, model).count() == odd_docs.count() and toxicity.score_toxicity(no_docs, model).count() == 0


def test_against_brute_force(spark):
    """The model's own weights over the distinct words of a text and their prefixes, text by text, in plain Python."""
    rows, labels = corpus(400, 3)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    fresh, _ = corpus(40, 4)
    fresh += [(90, "Grimble GRIMBLE idiotas! Élan vexlo, vexlo"), (91, "")]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    for i, text in fresh:
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", text)}
        ids = set()
        for w in words:
            raw = w.encode()
            hashes, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), letters=True)
            ids.add(int(hashes[0]) % 2**toxicity.BITS)
            for n in toxicity.PREFIXES:
                if len(raw) >= n:
                    ids.add(int(mix64(np.array([(int.from_bytes(raw[:n], "little") + n * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]) % 2**toxicity.BITS)
        z = sum(float(model.weights[f]) for f in ids)
        p = [1 / (1 + np.exp(-(z - t))) for t in model.thresholds]
        cells = np.array([1, *p]) - np.array([*p, 0])
        assert abs(got[i]["score"] - p[0]) < 1e-5 and abs(got[i]["severity"] - sum(p)) < 1e-5 and got[i]["grade"] == cells.argmax()


def test_repeated_and_contradicting_labels(spark):
    rows, labels = corpus(300, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    odd = [*labels, *labels[:50], *[(i, 1 - y) for i, y in labels[250:]]]
    a = toxicity.fit(docs, spark.createDataFrame(odd, "doc_id long, toxic int"))
    b = toxicity.fit(docs, spark.createDataFrame(labels[:250], "doc_id long, toxic int"))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)


def test_without_labels(spark, odd_docs):
    model = toxicity.fit(odd_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(r["toxic"] for r in toxicity.score_toxicity(odd_docs, model).collect())
