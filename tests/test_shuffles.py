"""Steps that need no row per pair, and no shuffle where a row says it all."""

from __future__ import annotations

from momentlake.operators import intervals, scout


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_are_judged_where_they_lie(spark):
    response = lambda *rows: "[" + ", ".join(f'{{"index": "{i}", "score": "{s}"}}' for i, s in rows) + "]"
    rows = [(1, response((0, 5), (1, 6)), 2), (2, response((0, 5), (1, 101)), 2), (3, response((1, 5), ("01", 6)), 2), (4, response((0, 5)), 2), (5, "no", 1), (6, response((0, 5), (2, 6)), 2), (7, None, 1), (8, "[null]", 1)]
    got = scout.strict_scores(spark.createDataFrame(rows, "batch_id long, response string, n long"))
    assert "Exchange" not in _plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 5.0), (1, 1, 6.0)]  # 1 and 01 are one index


def test_texts_are_shuffled_not_pairs(spark):
    said = [("a", i, f"w{i % 7}" if i % 5 else None, i * 7.0) for i in range(60)] + [("b", 0, "", 3.0), ("b", 1, "x", 3.0), ("b", 2, "late", None)]
    asked = [("a", 1, 0.0, 200.0), ("a", 2, 63.0, 64.0), ("a", 3, 64.0, 128.0), ("a", 4, 70.0, 70.0), ("b", 1, 0.0, 9.0), ("c", 1, 0.0, 9.0)]
    w = spark.createDataFrame(said, "source_id string, word_idx long, text string, start double")
    i = spark.createDataFrame(asked, "source_id string, clip_id long, start double, end double")
    for closed in (False, True):
        got = intervals.words_text(i, w, ["clip_id"], closed=closed)
        inside = lambda t, a, b: t is not None and a <= t and (t <= b if closed else t < b)
        assert sorted((r["source_id"], r["clip_id"], r["text"]) for r in got.collect()) == [(s, k, " ".join(x[2] for x in said if x[0] == s and x[2] is not None and inside(x[3], a, b))) for s, k, a, b in asked]
        assert "collect_list(_word" in _plan(got)
