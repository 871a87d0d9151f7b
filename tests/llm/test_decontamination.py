from __future__ import annotations

import random
from collections import Counter

import numpy as np

from momentlake.llm import decontamination as D


def grams(words):
    return Counter([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def test_finds_items_and_nothing_else(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    items = [fresh(n) for n in (3, 5, 12, 17, 28, 40, 59, 90)]
    docs, want = [], set()
    for i in range(60):
        words = fresh(rng.randrange(0, 300))
        which = i % 10
        if which < len(items):
            leak = list(items[which])
            if i >= 30 and len(leak) >= 59:
                leak[len(leak) // 2] = "changed"
            at = rng.randrange(len(words) + 1)
            words = words[:at] + leak + words[at:]
            want.add((i, which))
        docs.append((i, " ".join(words).upper() if i % 2 else " ".join(words)))
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    for r in got:
        words = docs[r["doc_id"]][1].lower().split()
        assert abs(jaccard(words[r["start_word"] : r["start_word"] + r["n_words"]], items[r["item_id"]]) - r["similarity"]) < 1e-9


def test_radius_is_covered():
    """Every fingerprint at most 15 bits from an item's is met by some block; one of 16 bits in equal parts may not be."""
    rng = random.Random(1)
    words = np.array([[rng.getrandbits(64) for _ in range(20)] for _ in range(30)], np.uint64)
    index = D.Index(list(enumerate(words)), D.SHINGLE, D.RADIUS)
    for i, one in enumerate(index.prints.tolist()):
        for _ in range(10):
            y = one
            for b in rng.sample(range(64), D.RADIUS):
                y ^= 1 << b
            assert i in index.within(np.array([y], np.uint64))[1]


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return sum((a & b).values()) / sum((a | b).values())


def edited(rng, words):
    """words with a few of them replaced, put in, or taken out, inside or at the ends."""
    words = list(words)
    for _ in range(rng.randrange(1, 3 + len(words) // 40)):
        at = rng.choice([0, len(words) - 1, rng.randrange(len(words))])
        kind = rng.randrange(3)
        words[at : at + (kind != 1)] = [f"z{rng.randrange(10**6)}"] * (kind != 2)
    return words


def test_edited_items_are_found_as_by_brute_force(spark):
    """Of all documents that hold an item at 0.8 (best window of the item's size, cut at the document's ends), 98 % at least; similarities agree."""
    rng = random.Random(8)
    sizes = (4, 5, 9, 13, 16, 19, 28, 42, 49, 59, 63, 100, 250, 1000)
    items = [[f"q{rng.randrange(10**6)}" for _ in range(n)] for n in sizes for _ in range(2)]
    docs, want = [], {}
    for which, item in enumerate(items):
        for _ in range(24):
            words = [f"p{rng.randrange(50)}" for _ in range(rng.choice([0, 7]))] + edited(rng, item) + [f"p{rng.randrange(50)}" for _ in range(rng.choice([0, 7]))]
            n = len(item)
            best = max(jaccard(words[max(0, s) : s + n], item) for s in range(-n // 4 - 1, len(words)) if n < 250 or abs(s) < 60)
            if best >= D.SIMILARITY:
                want[len(docs), which] = best
            docs.append((len(docs), " ".join(words)))
    found = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}
    assert set(got) <= set(want) and len(want) > 200
    missed = {k: v for k, v in want.items() if k not in got}
    assert len(missed) <= 0.02 * len(want), (len(missed), len(want))
    assert all(abs(want[k] - v) < 1e-9 for k, v in got.items())


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs, bench = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = lambda: sorted(map(tuple, D.find_leaks(docs, bench).collect()))
    whole = rows()
    monkeypatch.setattr(D, "WORDS_PER_BLOCK", 300)
    assert whole and rows() == whole


def test_rows_of_one_id_are_judged_apart(spark):
    leak = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, leak, 0), (7, leak, 0), (7, "quite another text that holds nothing of it", 1), (None, leak, 2), (None, "some other text", 3)], "doc_id long, text string, _leak_9 int")
    left = D.drop_contaminated(docs, spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert sorted(r["_leak_9"] for r in left.collect()) == [1, 3] and left.columns == docs.columns


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "one two three"), (3, "one two three"), (4, "One two three")], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in D.find_leaks(odd_docs, bench).collect())
    assert found == sorted([(d, i) for d in (5, 5, 6) for i in (3, 4)])
    assert D.find_leaks(no_docs, bench).count() == 0 and D.find_leaks(odd_docs, bench.limit(0)).count() == 0
    left = D.drop_contaminated(odd_docs, bench)
    assert left.count() == odd_docs.count() - 3 and left.columns == odd_docs.columns
