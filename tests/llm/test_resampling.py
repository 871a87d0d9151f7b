"""Prefix CRCs against zlib, and draws against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from momentlake.llm import resampling
from momentlake.llm.common import text_chunks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, n):
    w = words(text)
    return [zlib.crc32(" ".join(w[a : a + k]).encode()) for k in range(1, n + 1) for a in range(len(w) - k + 1)]


def plain(docs, target, n, buckets, least, percent):
    """doc_id, n_features, weight, score, rank of (doc_id, text) rows."""
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for c in grams(text, n):
                counts[c % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for doc_id, text in docs:
        found = grams(text, n)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % buckets] for c in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(order) // 100
    ranks = {id(r): i + 1 for i, r in enumerate(order) if i < drawn}
    return sorted((tuple([*r[:4], ranks.get(id(r))]) for r in rows), key=repr)


def test_crcs_of_all_runs():
    rng = random.Random(1)
    texts = ["", "Hello  world 1,2 Ä漢字x\x00y", "a" * 1000 + " b", " -- ", "Z", *["w%d" % i for i in range(200)], " ".join(rng.choice("abcdefg") * rng.randrange(1, 90) for _ in range(400))]
    for i, j, data, offsets in text_chunks(pa.array(texts)):
        crcs, owners, counts = resampling.gram_crcs(data, offsets, 4)
        for k in range(j - i):
            assert counts[k] == len(words(texts[i + k]))
            assert [c for a, o in zip(crcs, owners, strict=True) for c in a[o == k].tolist()] == grams(texts[i + k], 4)


def test_shift_by_far():
    x = np.array([0x12345678, 0xFFFFFFFF, 1, 0], np.uint32)
    for n in (0, 1, 63, 64, 65, 4097, 10**6):
        slow = [int(v) for v in x]
        if n <= 4097:
            for _ in range(n):
                slow = [int(resampling._STEP[v & 255]) ^ (v >> 8) for v in slow]
            assert resampling.shifted(x, np.full(4, n)).tolist() == slow
        half = resampling.shifted(resampling.shifted(x, np.full(4, n // 2)), np.full(4, n - n // 2))
        assert resampling.shifted(x, np.full(4, n)).tolist() == half.tolist()


def test_draws_equal_a_plain_version(spark, odd_docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(300)] + [(1000 + i, docs_text) for i, docs_text in enumerate(["same text here"] * 5)]
    docs += [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    target = [" ".join(rng.choices(vocabulary[:20], k=40)) for _ in range(30)] + [None, ""]
    df, goal = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for n, buckets, least, percent in ((1, 10_000, 20, 10), (3, 100_000, 5, 33)):
        got = resampling.resample(df, goal, percent=percent, least=least, ngram=n, buckets=buckets)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == plain(docs, target, n, buckets, least, percent)


def test_empty_tables(spark, no_docs, odd_docs):
    assert resampling.resample(no_docs, no_docs).count() == 0
    rows = resampling.resample(odd_docs, no_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["n_features"] == 0 and r["weight"] == 0 for r in rows if not (r["n_words"] or 0))
