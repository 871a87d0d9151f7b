"""Groups at ties and thresholds: the query and its SQL state one rule."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from momentlake.operators import moments
from momentlake.plans.queries import ORACLES, QUERIES


def test_means_don_t_depend_on_the_order_of_rows(spark):
    rows = [("a", 1, i, i * 10.0, i * 10.0 + 5, s, "t", "QUOTE") for i, s in enumerate([0.1, 0.2, 0.3])]
    made = lambda r: spark.createDataFrame(r, "source_id string, group_id long, candidate_id long, start double, end double, score double, topic string, moment_type string").coalesce(1)
    assert [moments.group_stats(made(r)).first()["mean_score"] for r in (rows, rows[::-1])] == [(0.1 + 0.2 + 0.3) / 3] * 2


def test_the_first_of_equal_peaks_decides(spark, tmp_path):
    """Of two peaks one is an action; only as an action does it dilute its group."""
    events = [(i, datetime(2024, 1, 1) + timedelta(seconds=2048 * 17 * k), user, "click", v) for user, ids in ((1, (5, 6, 7, 8, 9)), (2, (16, 20, 21, 22, 23))) for k, (i, v) in enumerate(zip(ids, (75.0, 75.0, 55.0, 55.0, 55.0), strict=True))]
    spark.createDataFrame(events[::-1], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, QUERIES["q4_decide_merges"](spark, str(tmp_path)).select("source_id", "group_id", "decision").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLES["q4_decide_merges"]).fetchall()) == [(1, 5, "peak"), (2, 16, "merged")]
    top = sorted(map(tuple, QUERIES["top_moments"](spark, str(tmp_path)).collect()))
    assert top == sorted(con.execute(ORACLES["top_moments"]).fetchall()) and len(top) == 2
