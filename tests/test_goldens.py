"""Worked examples of the operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from momentlake.functions import links, scores, text
from momentlake.operators import evaluation, jobs, ledger, media, moments, ranking, scout, transcript, windows

WORD = "source_id string, word_idx long, text string, start double, end double, confidence double, speaker string, language string, uncertain boolean"


def words(spark, rows):
    return spark.createDataFrame([("v", i, t, float(a), float(b), c, None, None, False) for i, (t, a, b, c) in enumerate(rows)], WORD)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(
    ("start", "end", "window", "limit", "want"),
    [
        (7452.62, 7488.31, (7452.5, 7569.6), 15000, (7452.62, 7488.31, "keep")), (10, 40, (1000, 1120), 2000, (1010, 1040, "keep")), (1_000_000, 1_040_000, (1000, 1120), 2000, (1000, 1040, "keep")),
        (11980, 12020, (11900, 12030), 12000, (11980, 12000, "keep")), (None, 5, (0, 10), 100, (None, None, "missing_timestamp")), (40, 10, (0, 100), 100, (10, 40, "keep")), (5, 9, (100, 200), 300, (103.0, 111.0, "expand_short")), (5, 5, (100, 200), 300, (None, None, "end_le_start")),
    ],
)
def test_accept_span(spark, start, end, window, limit, want):
    lit = lambda v: F.lit(v).cast("double")
    s = one(spark, s=scout.accept_span(lit(start), lit(end), lit(window[0]), lit(window[1]), lit(limit)))["s"]
    assert s["action"] == want[2]
    if want[0] is not None:
        assert (round(s["start"], 3), round(s["end"], 3)) == want[:2]


def test_accept_span_lengths(spark):
    lit = lambda v: F.lit(float(v))
    short = one(spark, s=scout.accept_span(lit(5794.13), lit(5798.05), lit(5740), lit(5900), lit(12000)))["s"]
    assert short["action"] == "expand_short" and abs((short["start"] + short["end"]) / 2 - 5796.09) < 1
    long = one(spark, s=scout.accept_span(lit(100), lit(250), lit(90), lit(260), lit(1000)))["s"]
    assert long["action"] == "clamp_long" and long["end"] - long["start"] <= 90.001


def test_component_scores(spark):
    score = lambda v, **k: one(spark, s=scores.component_score(F.create_map(*[x for n in scores.WEIGHTS for x in (F.lit(n), F.lit(float(k.get(n, v))))])))["s"]["final"]
    assert score(8) == 76.5 and score(9) == 83.0 and score(9, payoff=1) == 49.0
    nan = one(spark, x=scores.clamp(F.lit(float("nan")), 0, 100), y=scores.clamp(F.lit(None).cast("double"), 0, 100))
    assert nan["x"] == 100.0 and nan["y"] is None


def test_chunk_plans(spark):
    for d, n in ((600, 3), (7200, 30), (21600, 90)):
        rows = transcript.chunk_plan(spark.createDataFrame([("v", float(d)), ("bad", float("nan")), ("zero", 0.0)], "source_id string, duration double"), 4, 5).orderBy("index").collect()
        assert len(rows) == n and rows[-1]["core_end"] == d and all(r["audio_end"] - r["audio_start"] <= 250 for r in rows)
    with pytest.raises(ValueError):
        transcript.chunk_plan(spark.range(1), 0.5, 5)


HEARD = "source_id string, index int, audio_start double, audio_end double, text string, start double, end double, confidence double, speaker string, uncertain boolean"


def heard(spark, *rows):
    plan = {0: (0.0, 255.0), 1: (225.0, 495.0)}
    return spark.createDataFrame([("v", i, *plan[i], t, float(a), float(b), c, None, False) for i, t, a, b, c in rows], HEARD)


@pytest.mark.parametrize("chunk", [240, 20])
def test_overlap_merge(spark, chunk):
    overlap = 15
    merged = lambda *rows: sorted((r["start"], r["text"], r["confidence"], r["uncertain"]) for r in transcript.merge_overlaps(heard(spark, *rows), chunk, overlap).collect())
    got = merged((0, "hello", 239, 239.3, 0.5), (1, "HELLO!", 239.1, 239.4, 0.95), (1, "unique", 241, 241.2, 0.9))
    assert [(t, c) for _, t, c, _ in got] == [("HELLO!", 0.95), ("unique", 0.9)]
    assert len(merged((0, "no", 1, 1.1, None), (0, "no", 1.2, 1.3, None))) == 2
    got = merged((0, "hello", 239, 239.3, 0.5), (1, "yellow", 239.05, 239.35, 0.5))
    assert len(got) == 2 and all(u for *_, u in got)


def test_seams_agree_with_whole_sources(spark):
    import random

    rng = random.Random(8)
    rows = []
    for i, (lo, hi) in enumerate([(0, 255), (225, 495)]):
        for _ in range(300):
            a = round(rng.uniform(lo, hi - 0.4), 2)
            rows.append((i, rng.choice(["a", "b", "Hello,", "hello"]), a, round(a + 0.3, 2), rng.choice([None, 0.2, 0.9])))
    key = lambda r: (r["start"], r["end"], r["text"], str(r["confidence"]), r["uncertain"])
    near, whole = (sorted(map(key, transcript.merge_overlaps(heard(spark, *rows), c, 15).collect())) for c in (240, 30))
    assert near == whole


def test_semantic_windows(spark):
    rows = [("setup." if i == 238 else "payoff." if i == 242 else "w", i, i + 0.9, None) for i in range(600)]
    got = windows.semantic_windows(words(spark, rows), target=180.0, hop=120.0).orderBy("window_id").collect()
    assert got[0]["start"] == 0 and any("setup." in r["text"] and "payoff." in r["text"] for r in got)


def test_repair(spark):
    w = words(spark, [("ok", 1, 2, 0.9), ("unclear", 10, 11, 0.1), ("late", 90, 91, 0.9)])
    c = spark.createDataFrame([("v", 1, 0.0, 40.0, 70.0)], "source_id string, candidate_id long, start double, end double, score double")
    ranges = transcript.repair_ranges(c, w, 3)
    assert [tuple(r)[2:] for r in ranges.collect()] == [(5.0, 16.0)]
    new = spark.createDataFrame([("v", 0, -1, "clear", 10.0, 10.5, 0.95)], "source_id string, range_id int, word_idx long, text string, start double, end double, confidence double")
    done = transcript.apply_repair(w, transcript.repair_decisions(ranges, w, new), new)
    assert sorted(r["text"] for r in done.collect()) == ["clear", "late", "ok"]


CAND = "source_id string, candidate_id long, start double, end double, score double, topic string, moment_type string"


def candidates(spark, rows):
    return spark.createDataFrame([("v", i, float(a), float(b), float(s), t, k) for i, (a, b, s, t, k) in enumerate(rows)], CAND)


def test_dedupe_and_grouping(spark):
    kept = moments.suppress_repeats(candidates(spark, [(10, 40, 80, "", ""), (11, 41, 70, "", "")])).collect()
    assert [r["candidate_id"] for r in kept] == [0]
    apart = moments.group_candidates(candidates(spark, [(i * 300, i * 300 + 20, 70, "x", "") for i in range(17)]))
    assert apart.select("group_id").distinct().count() == 17


def greedy_groups(rows):
    groups = []
    for c in rows:
        p = groups[-1][-1] if groups else None
        joins = False
        if p is not None:
            act = any(x[4].startswith("IRL_") or x[4] in ("CHAOS", "STATUS") for x in (c, p))
            same, gap = c[3] == p[3] != "", c[0] - p[1]
            if c[1] - groups[-1][0][0] <= (65 if act else 120):
                if max(c[2], p[2]) >= 65:
                    joins = same and min(c[2], p[2]) >= (55 if act else 50) and gap <= (8 if act else 15)
                else:
                    base = 7 if act else 12
                    near = gap <= base or (gap <= base * 1.8 and same)
                    clash = (c[2] >= 60 and p[2] < 45) or (p[2] >= 60 and c[2] < 45)
                    joins = near and not clash and (abs(c[2] - p[2]) <= 15 or (same and min(c[2], p[2]) >= 50))
        if joins:
            groups[-1].append(c)
        else:
            groups.append([c])
    return [len(g) for g in groups]


def greedy_kept(rows):
    kept = []
    for c in sorted(rows, key=lambda c: -c[2]):
        for k in kept:
            shorter = min(c[1] - c[0], k[1] - k[0])
            if abs((c[0] + c[1]) / 2 - (k[0] + k[1]) / 2) <= 18 or (shorter > 0 and max(0, min(c[1], k[1]) - max(c[0], k[0])) / shorter >= 0.45):
                break
        else:
            kept.append(c)
    return sorted(c[0] for c in kept)


def test_random_islands(spark):
    import random

    rng = random.Random(6)
    for spread in (300, 3000, 60_000):
        starts = sorted(rng.sample(range(spread * 4), 150))
        rows = [(s / 4, s / 4 + rng.choice([0, 4, 16, 40]), rng.randrange(32, 100) + rng.random(), rng.choice(["x", "y", ""]), rng.choice(["QUOTE", "IRL_ACTION"])) for s in starts]
        df = candidates(spark, rows).repartition(7)
        grouped = moments.group_candidates(df).groupBy("group_id").count().orderBy("group_id").collect()
        assert [r["count"] for r in grouped] == greedy_groups(rows)
        assert sorted(r["start"] for r in moments.suppress_repeats(df).collect()) == greedy_kept(rows)


def test_evaluation(spark):
    gold = spark.createDataFrame([("v", 0, 10.0, 20.0), ("v", 1, 40.0, 55.0)], "source_id string, item_id long, start double, end double")
    pred = spark.createDataFrame([("v", 0, 9.0, 21.0, 90.0), ("v", 1, 39.0, 56.0, 80.0), ("v", 2, 100.0, 110.0, 70.0)], "source_id string, item_id long, start double, end double, score double")
    r = evaluation.evaluation_report(gold, pred).first()
    assert r["recall_at_10"] == 1.0 and math.isclose(r["precision_at_10"], 2 / 3) and math.isclose(r["useful_rate"], 2 / 3) and r["start_error"] == r["end_error"] == 1.0
    assert evaluation.pooled_report(evaluation.evaluation_report(gold, pred)).first()["matched_predictions"] == 2


def test_profiles(spark):
    p = spark.createDataFrame([(0.3, 0.6, 2, 10.0), (0.08, 0.96, 0, 30.0)], "wer double, candidate_recall double, boundary_errors int, total_seconds double")
    assert ranking.best_profile(p, 0.1, 0.9, 0).first()["total_seconds"] == 30.0
    with pytest.raises(Exception, match="no measured profile"):
        ranking.best_profile(p.limit(1), 0.1, 0.9, 0, require=True).collect()


def test_audio_and_faces(spark):
    level = one(spark, x=media.audio_level(F.array_repeat(F.lit(0.5), 10)), y=media.audio_level(F.array().cast("array<float>")))
    assert level["x"]["rms_dbfs"] == -6.02 and not level["y"]["available"]


def test_logs(spark):
    line = "ERROR request failed api_key=secret https://example.com/file?token=secret"
    lines = spark.createDataFrame([("j", 1, line), ("j", 2, line), ("j", 3, "403 used all available credits or reached spending limit"), ("j", 4, "[scout] invalid_candidate ValueError quota"), ("j", 5, "fine")], "job_id string, event_id long, line string")
    found = jobs.collapsed_incidents(jobs.incidents(lines)).orderBy("event_id").collect()
    assert [(r["category"], r["count"]) for r in found] == [("processing", 2), ("quota", 1), ("warning", 1)] and "secret" not in found[0]["message"]


def test_progress_never_falls(spark):
    rows = [("j", 0.0, 0, "scan", 0), ("j", 10.0, 1, "scan", 10), ("j", 20.0, 2, "scan", 20), ("j", 20.0, 3, "cut", 0), ("j", 21.0, 4, "odd", 99)]
    out = jobs.job_eta(jobs.overall_progress(spark.createDataFrame(rows, "job_id string, t double, seq int, stage string, pct int"))).orderBy("seq").collect()
    overall = [r["overall"] for r in out]
    assert overall == sorted(overall) and overall[-1] == 60 and out[2]["eta"] > 0


def test_ledger(spark):
    assert one(spark, x=ledger.hold_amount(F.lit(10.03), F.lit(1.0)))["x"] == 10.1
    rows = [("live", "running", False, 90.0, 1, 7.5), ("crash", "running", True, 20.0, 1, None), ("done", "completed", False, 20.0, 1, None), ("none", "running", True, None, 0, None), ("empty", "running", False, 20.0, 0, None)]
    out = {r["job_id"]: r for r in ledger.settle(spark.createDataFrame(rows, "job_id string, status string, crashed boolean, hold double, kept int, capture_amount double")).collect()}
    assert (out["live"]["new_status"], out["live"]["captured"], out["live"]["released"]) == ("completed", 7.5, 82.5)
    assert out["crash"]["new_status"] == "partial" and out["done"]["captured"] == 0 and out["none"]["new_status"] == "failed" and out["empty"]["refunded"] == 20
    holds = spark.createDataFrame([("a", 1, 20.0), ("a", 2, 200.0), ("a", 3, 80.0), ("b", 4, 1.0)], "account_id string, hold_id int, amount double")
    got = ledger.accept_holds(holds, spark.createDataFrame([("a", 100.0)], "account_id string, balance double")).orderBy("hold_id").collect()
    assert [r["accepted"] for r in got] == [True, False, True, False] and got[2]["balance"] == 0


def test_recipes(spark):
    row = {"start": 0.0, "end": 5.0, "overlay_seconds": 3.0, "aspect": "9:16", "track": "auto", "layout": "follow", "captions_enabled": True, "overlay_text": ""}
    bad = [row | {"end": 0.0}, row | {"end": float("inf")}, row | {"track": "oops"}, row | {"overlay_seconds": -1.0}]
    out = spark.createDataFrame([Row(**r) for r in [row, *bad]]).select(F.size(jobs.export_recipe_errors()).alias("n")).collect()
    assert [r["n"] > 0 for r in out] == [False, True, True, True, True]


def test_links_and_text(spark):
    r = one(
        spark, a=links.live_source(F.lit("some_channel")), b=links.live_source(F.lit("https://evil.com/x")), c=text.fallback_title(F.lit("  Hello there.  More. ")), d=text.verify_quotes(F.lit('He said "never this" and "hello"'), F.lit("well hello there")),
        e=text.caption_time(F.lit(3725.5)), f=text.topic_overlap(F.lit("car stuck"), F.lit("the stuck car keys")), g=text.stem_hit(F.lit("he was SCREAMING"), ["scream"]), h=text.redact_terms(F.lit("a  bad Word"), ["bad"]),
    )
    assert r["a"]["platform"] == "kick" and r["b"] is None and r["c"] == "Hello there" and r["d"] == 'He said and "hello"' and r["e"] == "1:02:05.50" and r["f"] == 1.0 and r["g"] and r["h"] == "a [redacted] Word"
