"""Spanning-tree search against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlake.llm import hard_negatives as hn


def all_pairs(rows, anchors, positives=5, negatives=3, low=50, high=95):
    """rows: {id: (label, vector)}."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a in anchors:
        label, vector = rows[a]
        scored = sorted(((-dot(vector, v), i, lab) for i, (lab, v) in rows.items() if i != a))
        for s, p in [(-s, i) for s, i, lab in scored if lab == label][:positives]:
            fits = [(i, -n) for n, i, lab in scored if lab != label and low * s <= -100 * n <= high * s]
            out += [(a, p, k + 1, i, s, n) for k, (i, n) in enumerate(fits[:negatives])]
    return sorted(out)


def vectors(seed, n, dim, labels):
    """Clusters by label, with equal rows, zeros, and few distinct values so that ties are frequent."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(labels)]
    rows = []
    for i in range(n):
        # A third of all rows have one label.
        lab = 0 if i % 3 == 0 else rng.randrange(labels)
        v = [0.0] * dim if i % 29 == 0 else [round(c + rng.gauss(0, 0.1), 1) for c in centres[lab]]
        rows.append((i, v, lab))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(df):
    return hn.usable_rows(df, F.col("label"), 256)


def as_dict(df):
    return {r["vec_id"]: (r["label"], r["q"]) for r in df.collect()}


@pytest.mark.parametrize("chunk,block,group", [(8_192, 512, 1 << 20), (37, 7, 100), (64, 1, 50)])
def test_equals_all_pairs(spark, chunk, block, group):
    rows = usable(spark.createDataFrame(vectors(1, 400, 8, 5), SCHEMA).repartition(6))
    anchors = rows.where("vec_id % 10 = 0")
    got = sorted(map(tuple, hn.mine(rows, anchors, chunk=chunk, block=block, group=group).collect()))
    assert got == all_pairs(as_dict(rows), [r[0] for r in anchors.select("vec_id").collect()]) and len(got) > 100


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 90, (6, 16))
    q = np.rint(np.concatenate([c + rng.normal(0, 8, (60, 16)) for c in centres])).astype(np.int32)
    order, parent, edge = hn.spanning_tree(q[::10])
    anchors = q[::10][order]
    assert sorted(order.tolist()) == list(range(36)) and (parent[1:] < np.arange(1, 36)).all()
    row = {"n": 36, "dim": 16, "ids": (np.arange(0, 360, 10)[order]).tobytes(), "labels": np.zeros(36, np.int64).tobytes(), "vectors": anchors.tobytes(), "parent": parent.tobytes(), "edge": edge.tobytes()}
    block = hn._Positives(row, 5)
    ids, labels = np.arange(360), np.zeros(360, np.int64)
    for k, low, high, score in block.score_ranges(ids, labels, q):
        true = q.astype(np.int64) @ anchors[k].astype(np.int64)
        assert (low <= true).all() and (true <= high).all()
        wanted = np.flatnonzero(high >= np.sort(high)[-20])  # scoring narrows the ranges
        assert score(wanted).tolist() == true[wanted].tolist()
    block = hn._Positives(row, 5)
    block.meet(ids, labels, q)
    assert block.rescored < 0.8 * block.pairs  # far clusters are never scored anew


def test_tree_is_minimal():
    q = np.array([[0, 0], [10, 0], [10, 1], [0, 2], [50, 50]], np.int32)
    _, parent, edge = hn.spanning_tree(q)
    assert math.isclose(edge.sum(), 10 + 1 + 2 + math.hypot(40, 49)) and (parent < 0).sum() == 1


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (50, [1.0], 1), (50, [2.0, 2.0], 1), (1, [0.9, 0.5], 1), (2, [0.8, 0.1, 3.0], 2), (3, [0.8, 0.1], 2), (4, None, 1), (5, [1.0, 1.0], None), (6, [nan, 1.0], 1), (8, [inf, 1.0], 2), (9, [None, 1.0], 2),
        (None, [1.0, 1.0], 1), (10, [], 2), (11, [3e38, 1.0], 2), (12, [1.0, 0.5], 1), (13, [-1.0, -1.0], 2), (100, [-1.0, -2.0], 3),
    ]
    df = usable(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", score int, rank string"))
    found = as_dict(df)
    assert sorted(found) == [0, 1, 2, 3, 10, 12, 13, 50, 100] and found[50][1] == [256]
    got = sorted(map(tuple, hn.mine(df, df.where("vec_id % 50 = 0")).collect()))
    assert got == all_pairs(found, [0, 50, 100]) and got
    none = spark.createDataFrame([], SCHEMA)
    assert hn.mine(usable(none), usable(none)).count() == 0
    one = usable(spark.createDataFrame([(0, [1.0], 1)], SCHEMA))
    assert hn.mine(one, one).count() == 0 and hn.mine(df, df.where("false")).count() == 0
