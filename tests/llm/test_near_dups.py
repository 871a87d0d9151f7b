from __future__ import annotations

import random

from momentlake.llm import near_dups
from momentlake.llm.components import connected_components


def shingles(text, k):
    words = (text or "").lower().split()
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows, k):
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    """Groups of copies with few or many edits, a passage that many texts share, chains at the threshold, and unrelated texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    fresh = lambda n: [rng.choice(vocab) + str(rng.randrange(50)) for _ in range(n)]
    rows, passage = [], fresh(60)
    for edits in (0, 1, 2, 3, 4):
        base = fresh(rng.randrange(60, 160))
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(edits + 1)):
                words[rng.randrange(len(words))] = fresh(1)[0]
            rows.append(words)
    rows += [passage + fresh(rng.randrange(0, 40)) for _ in range(40)]
    chain = fresh(100)
    for _ in range(12):
        chain = chain[6:] + fresh(6)
        rows.append(list(chain))
    rows += [fresh(rng.randrange(1, 30)) for _ in range(60)]
    rng.shuffle(rows)
    return [(i * 3 + 1, " ".join(w)) for i, w in enumerate(rows)]


def test_against_brute_force(spark):
    for seed, k in ((1, 4), (2, 5)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(docs, shingle=k).collect()}
        assert got == brute(rows, k)


def test_odd_rows(odd_docs, no_docs):
    rows = near_dups.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[6]["component_id"] == 5 and not by_id[6]["kept"] and by_id[5]["kept"]
    assert all(by_id[d]["n_shingles"] == 0 and by_id[d]["kept"] for d in (1, 2, 3))
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert near_dups.near_duplicates(no_docs).count() == 0
    assert near_dups.keep_one_each(odd_docs).count() == odd_docs.count() - 1


def test_repeated_ids_keep_all_links_and_rows(spark):
    """Texts of one id are documents of their own: each keeps its links, and only near copies go."""
    rng = random.Random(3)
    fresh = lambda: " ".join(f"r{rng.randrange(10**6)}" for _ in range(40))
    t, u, v = fresh(), fresh(), fresh()
    rows = [(1, t, 0), (7, t, 1), (7, u, 2), (9, u, 3), (7, v, 4), (8, v + " more", 5), (8, v + " more", 6), (7, v + " less", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th int")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(docs).collect())
    assert got == sorted([(1, 1, True), (7, 1, False), (7, 7, True), (9, 7, False), (7, 7, True), (8, 7, False), (8, 7, False), (7, 7, True)])
    left = near_dups.keep_one_each(docs)
    assert left.columns == docs.columns
    stay = {r["th"] for r in left.collect()}
    assert {0, 2} < stay and len(stay) == 3 and stay & {4, 7}


def test_bayesian_thresholds_lose_little():
    for n, least in near_dups.least_matches(160, 32, 0.8, 1e-6):
        assert 0.4 * n < least < 0.8 * n


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
