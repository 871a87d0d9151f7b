"""Keyed state over several micro-batches and restarts against batches and plain replays."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from momentlake.config import DEFAULTS
from momentlake.operators import jobs
from momentlake.streaming import live, stateful

SCORED = "source_id string, start double, end double, score double"


def timed(spark, rows, schema=SCORED, time="end"):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(time))


def replayed(batches, lateness=150.0):
    """Flushed groups by a plain replay: the watermark moves a channel's time after each micro-batch."""
    channels, latest, out = {}, 0.0, []
    for rows in batches:
        for source in sorted({r[0] for r in rows} | set(channels)):
            pending, n = channels.setdefault(source, [live.Pending(DEFAULTS), 0])
            for r in sorted((r for r in rows if r[0] == source), key=lambda r: (r[2], r[1], r[3] is not None, r[3] or 0)):
                done = pending.take(*r[1:])
                out += [(source, channels[source][1], *d) for d in done]
                channels[source][1] += bool(done)
        latest = max([latest, *[r[2] for r in rows]])
        for source, state in channels.items():
            done = state[0].advance(latest - lateness)
            out += [(source, state[1], *d) for d in done]
            state[1] += bool(done)
    return sorted(out)


def test_silent_channel_is_flushed_and_goes_on_counting(spark, tmp_path):
    """A channel of two windows, silent between: the watermark closes the first after 18 s; the second is another flush."""
    batches = [
        [("c", 90_060.0, 90_075.0, 50.0), ("clock", 90_000.0, 90_075.0, None)],
        [("clock", 90_000.0, 90_243.0, None)],  # watermark 90,093: not over 18 s yet
        [("clock", 90_000.0, 90_244.0, None)],  # 90,094: over
        [("c", 96_060.0, 96_075.0, 60.0), ("clock", 96_000.0, 96_075.0, None)],
        [("clock", 99_000.0, 99_075.0, None)],
    ]
    upto = lambda n: stateful.ordered_runs([timed(spark, b) for b in batches[:n]], stateful.pending_moments, f"{tmp_path}/{n}").collect()
    assert upto(2) == []
    assert [tuple(r) for r in upto(3)] == [("c", 0, 90_060.0, 90_075.0, 50.0)]
    assert sorted(map(tuple, upto(5))) == replayed(batches) == [("c", 0, 90_060.0, 90_075.0, 50.0), ("c", 1, 96_060.0, 96_075.0, 60.0)]


def test_long_wait_is_flushed_by_the_watermark(spark, tmp_path):
    """The last candidate ends late, so the first's 90 s run out before 18 s of quiet."""
    rows = [("c", 90_000.0, 90_075.0, 50.0), ("c", 90_010.0, 90_085.0, 50.0)]
    # 90,090.5 is past the first start + 90 s, but only 5.5 s after the last end.
    batches = [rows, [("clock", 90_000.0, 90_240.0, None)], [("clock", 90_000.0, 90_240.5, None)]]
    out = stateful.ordered_runs([timed(spark, b) for b in batches[:2]], stateful.pending_moments, f"{tmp_path}/a")
    assert out.count() == 0
    out = stateful.ordered_runs([timed(spark, b) for b in batches], stateful.pending_moments, f"{tmp_path}/b")
    assert sorted(map(tuple, out.collect())) == [("c", 0, *r[1:]) for r in rows]


def test_many_channels_equal_a_replay(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"c{c}", 90_000.0 + t - 75, 90_000.0 + t, rng.choice([None, 10.0, 40.0, 70.0])) for c in range(12) for t in range(75, 3000, 30) if rng.random() < (0.3 if (t // 300 + c) % 4 == 0 else 0.9)]
    batches = [[r for r in rows if 90_000 + 600 * i < r[2] <= 90_600 + 600 * i] for i in range(5)] + [[("clock", 95_000.0, 95_075.0, None)]]
    out = stateful.ordered_runs([timed(spark, b) for b in batches], stateful.pending_moments, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == replayed(batches) and out.count() > 100


def test_clips_of_silent_channels(spark, tmp_path):
    rows = [("c", 90_000.0 + i * 400, 90_075.0 + i * 400, 70.0, "car", f"text {i}") for i in range(4)]
    schema = SCORED + ", topic string, text string"
    batches = [[r, ("clock", r[1] + 300, r[2] + 300, None, None, None)] for r in rows]
    out = stateful.ordered_runs([timed(spark, b, schema) for b in batches], lambda s: stateful.flushed_moments(s, lambda texts: [80.0] * len(texts), most=2), str(tmp_path))
    assert sorted((r["flush_id"], r["clip_id"], r["start"]) for r in out.collect()) == [(0, 0, 90_000.0), (1, 1, 90_400.0)]


def plain_pending(df):
    out = []
    rows = sorted(map(tuple, df.select("source_id", "start", "end", "score").collect()), key=lambda r: (r[0], r[2], r[1], r[3] is not None, r[3] or 0))
    for source in sorted({r[0] for r in rows}):
        pending, n = live.Pending(DEFAULTS), 0
        for r in (r for r in rows if r[0] == source):
            done = pending.take(*r[1:])
            out += [(source, n, *d) for d in done]
            n += bool(done)
        out += [(source, n, *d) for d in pending.rows]
    return sorted(out)


def test_islands_replay_as_whole_channels(spark):
    """One channel has a third of all windows; quiet stretches cut it."""
    rng = random.Random(6)
    rows = [("hot" if i % 3 == 0 else f"c{i % 20}", 90_000.0 + 9 * i - 75, 90_000.0 + 9 * i, rng.choice([None, 5.0, 31.9, 32.0, 60.0, float("nan")])) for i in range(3_000)]
    df = timed(spark, rows).repartition(6)
    got = sorted(map(tuple, live.pending_moments_batch(df).collect()))
    nan = [(*r[:3], None if r[3] is not None and r[3] != r[3] else r[3]) for r in rows]
    assert got == plain_pending(timed(spark, nan)) and len(got) > 500
    named = df.select("source_id", "start", "end", "score")
    assert live._islands(named, ["start", "score"], DEFAULTS).where("source_id = 'hot'").select("island").distinct().count() > 100
    assert live.pending_moments_batch(df.where("false")).count() == 0


def test_collapsed_incidents(spark, tmp_path):
    """Runs that go on over micro-batches, that fall out of the ring, and messages that are never collapsed."""
    rng = random.Random(3)
    texts = ["ERROR request failed", "warning: retry", "403 spending limit", "nothing to see", "[scout] ValueError: local fallback"]
    rows, at = [], 0
    for _ in range(300):
        line = rng.choice(texts)
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((rng.choice("ab") if rng.random() < 0.3 else "a", at, line))
            at += 1
    df = spark.createDataFrame(rows, "job_id string, event_id long, line string")
    parts = [df.where((F.col("event_id") >= len(rows) * i // 4) & (F.col("event_id") < len(rows) * (i + 1) // 4)) for i in range(4)]
    for last in (7, 100):
        out = stateful.ordered_runs(parts, lambda s, n=last: stateful.live_collapsed_incidents(s, n), f"{tmp_path}/{last}")
        key = ["job_id", "event_id", "count", "category", "severity", "message"]
        got = sorted(map(tuple, stateful.current_runs(out).select(*key).collect()))
        assert got == sorted(map(tuple, jobs.collapsed_incidents(jobs.incidents(df), last).select(*key).collect())) and len(got) == 2 * last or last == 100
        assert out.count() > len(got)  # runs were emitted again as they grew


def test_late_words(spark, tmp_path):
    schema = "source_id string, start double, word_idx long, text string"
    rng = random.Random(2)
    rows = [(s, 9_000.0 + i * 2.5, i, f"{s}{i}") for s in "ab" for i in range(600)]
    arrival = lambda r: r[1] + rng.choice([0, 0, 0, 0, 100, 400])
    came = sorted(((arrival(r), r) for r in rows), key=lambda x: x[0])
    parts = [[r for t, r in came if 9_000 + 300 * i <= t < 9_300 + 300 * i] for i in range(7)]
    out = stateful.ordered_runs([spark.createDataFrame(p, schema) for p in parts if p], stateful.buffered_windows, str(tmp_path))
    late, kept, marks = [], [], {}
    for p in parts:
        for r in p:
            (late if r[1] < marks.get(r[0], -1e9) - 150 else kept).append(r)
        for r in p:
            marks[r[0]] = max(marks.get(r[0], -1e9), r[1])
    assert sorted((r["source_id"], r["start"], r["text"]) for r in stateful.late_words(out).collect()) == sorted((r[0], r[1], r[3]) for r in late) and late
    want = live.rolling_windows(timed(spark, kept, schema, "start"))
    closed = sorted((r["source_id"], r["win_start"], r["text"], r["n_words"]) for r in want.collect() if r["win_end"] <= marks[r["source_id"]])
    assert sorted((r["source_id"], r["win_start"], r["text"], r["n_words"]) for r in stateful.latest_windows(out).collect()) == closed
    assert out.where("kind = 'window'").count() > len(closed)  # late words changed windows that had closed


def test_quiet_job_is_reported(spark, tmp_path):
    schema = "job_id string, t double, stage_value double"
    batches = [[("j", 100_000.0, 5.0), ("k", 100_000.0, 7.0)], [("k", 100_150.0, 9.0)], [("k", 100_400.0, 11.0)], [("k", 100_401.0, 11.0)]]
    out = stateful.ordered_runs([timed(spark, b, schema, "t").select("job_id", "ts", "stage_value") for b in batches], live.live_progress, str(tmp_path))
    quiet = out.where("quiet").collect()
    assert [(r["job_id"], r["overall"]) for r in quiet] == [("j", 5.0)]


def test_eta_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"j{j}", i, float(1000 + i * 3), min(99.0, float(i + rng.randrange(3)))) for j in range(3) for i in range(60)]
    df = timed(spark, rows, "job_id string, seq long, t double, stage_value double", "t")
    out = stateful.ordered_runs([df.where(F.floor(F.col("seq") / 20) == i) for i in range(3)], live.live_eta, str(tmp_path))
    so_far = df.withColumn("overall", F.max("stage_value").over(Window.partitionBy("job_id").orderBy("seq")))
    key = lambda d: sorted((r["job_id"], r["overall"], -1.0 if r["eta"] is None else r["eta"]) for r in d.collect())
    assert key(out) == key(jobs.job_eta(so_far))


def test_older_jobs_leave_an_account_s_value():
    """The oldest of many jobs lie in the map, and are still known."""

    class Map(dict):
        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

        def getValue(self, key):  # noqa: N802
            return self.get(key)

    there = Map()
    jobs = stateful._Jobs(there, [(i, None, "completed") for i in range(10)], 0)
    jobs[3] = (1.0, "running")  # the latest now
    older, rest = jobs.parted(6)
    assert older == 7 and [r[0] for r in rest] == [8, 9, 3]
    again = stateful._Jobs(there, rest, older)
    assert again.get(0) == (None, "completed") and again.get(3) == (1.0, "running") and again.get(99) is None
