"""Streams give what batches give on the same data."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from momentlake.operators import jobs, moments
from momentlake.sources import files
from momentlake.streaming import live, stateful


@pytest.fixture
def out():
    return f"q{uuid.uuid4().hex[:8]}"


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_rolling_windows(spark, tmp_path, out):
    rows = [("a", i, f"w{i}", 90_000.0 + i * 5) for i in range(60)] + [("b", i, f"x{i}", 90_000.0 + i * 40) for i in range(20)]
    words = spark.createDataFrame(rows, "source_id string, word_idx long, text string, start double").withColumn("ts", F.timestamp_seconds("start"))
    end = words.where("false").unionByName(spark.createDataFrame([("z", 0, "end", 200_000.0)], "source_id string, word_idx long, text string, start double").withColumn("ts", F.timestamp_seconds("start")))
    for i, part in enumerate((words.where("start < 90200"), words.where("start >= 90200"), end)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(words.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    drain(live.rolling_windows(stream), out)
    got = sorted((r["source_id"], r["win_start"], r["text"]) for r in spark.table(out).collect())
    assert got == sorted((r["source_id"], r["win_start"], r["text"]) for r in live.rolling_windows(words).collect())


def test_pending_moments(spark, tmp_path, out):
    scored = [("c", 90_000.0 + 30 * i, 90_075.0 + 30 * i, s) for i, s in enumerate([10.0, 50.0, 60.0, 5.0, None, 5.0, 70.0, 80.0, 90.0, 33.0, 40.0, 45.0, 2.0, 2.0, 2.0])]
    df = spark.createDataFrame(scored, "source_id string, start double, end double, score double").withColumn("ts", F.timestamp_seconds("end"))
    for i in range(3):
        df.where(F.floor((F.col("start") - 90_000) / 150) == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    drain(stateful.pending_moments(stream), out)
    key = lambda r: (r["flush_id"], r["start"], r["end"], r["score"])
    assert sorted(map(key, spark.table(out).collect())) == sorted(map(key, live.pending_moments_batch(df).collect()))


def scored_windows(spark):
    """Three channels, windows every 30 s, some without a score; topics and texts repeat so that groups, peaks and repeats occur."""
    rng = random.Random(9)
    rows = [(c, 90_000.0 + 30 * i + rng.randrange(3), 90_075.0 + 30 * i, rng.choice([None, 10.0, 35.0, 48.0, 55.0, 62.0, 70.0, 90.0]), rng.choice(["car stuck", "the car", "money", ""]), f"{c}{i} " * rng.randrange(1, 9)) for c in "xyz" for i in range(60)]
    df = spark.createDataFrame(rows, "source_id string, start double, end double, score double, topic string, text string")
    return df.withColumn("ts", F.timestamp_seconds("end"))


def by_length(texts):
    if any("z7 " in t for t in texts):
        raise TimeoutError
    return [float(len(t) * 7 % 101) for t in texts]


def test_flushed_moments(spark, tmp_path, out):
    df = scored_windows(spark)
    for i in range(4):
        df.where(F.floor((F.col("end") - 90_000) / 480) == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    drain(stateful.flushed_moments(stream, by_length, most=4), out)
    batch = sorted(map(tuple, live.flushed_moments_batch(df, by_length, most=4).collect()))
    got = sorted(map(tuple, spark.table(out).collect()))
    # What still waits at the end is flushed by the batch only.
    assert got and set(got) <= set(batch) and len(batch) <= 12
    assert all(r in got or r[1] == max(x[1] for x in batch if x[0] == r[0]) for r in batch)


def test_flushes_do_what_the_operators_do(spark):
    """Groups, new scores, decisions and suppression of each flush, by the operators on whole tables."""
    df = scored_windows(spark)
    flushes = live.pending_moments_batch(df).select(F.concat_ws("|", "source_id", "flush_id").alias("key"), "source_id", "start", "end", "score")
    c = flushes.join(df.select("source_id", "start", "end", "topic", "text"), ["source_id", "start", "end"]).select(F.col("key").alias("source_id"), F.col("start").cast("long").alias("candidate_id"), "start", "end", "score", "topic", "text", F.lit(None).cast("string").alias("moment_type"))
    d = moments.merge_candidates(c, by_length).where("decision != 'drop'").select("source_id", F.col("group_id").alias("candidate_id"), F.col("out_start").alias("start"), F.col("out_end").alias("end"), F.col("out_score").alias("score"))
    want = sorted((r["source_id"], r["start"], r["end"], r["score"]) for r in moments.suppress_repeats(d).collect())
    got = sorted((f"{r['source_id']}|{r['flush_id']}", r["start"], r["end"], r["score"]) for r in live.flushed_moments_batch(df, by_length).collect())
    assert got == want and len(got) > 5


def test_live_eta(spark, tmp_path, out):
    rng = random.Random(2)
    rows = [(f"j{j}", i, float(1000 + i * 3), min(99.0, float(i + rng.randrange(3)))) for j in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "job_id string, seq long, t double, stage_value double").withColumn("ts", F.timestamp_seconds("t"))
    for i in range(3):
        df.where(F.floor(F.col("seq") / 20) == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    drain(live.live_eta(stream), out)
    so_far = df.withColumn("overall", F.max("stage_value").over(Window.partitionBy("job_id").orderBy("seq")))
    want = sorted((r["job_id"], r["overall"], r["eta"] or -1.0) for r in jobs.job_eta(so_far).collect())
    assert sorted((r["job_id"], r["overall"], -1.0 if r["eta"] is None else r["eta"]) for r in spark.table(out).collect()) == want


def test_recent_chunks(spark):
    chunks = spark.createDataFrame([(s, i, f"chunk_{i}.ts") for s in "ab" for i in range(25)], "source_id string, ts long, path string")
    left = live.recent_chunks(chunks).collect()
    assert len(left) == 40 and min(r["ts"] for r in left) == 5


def test_progressive_windows_come_once(spark, tmp_path, out):
    plan = [(200.0, [(0.0, 180.0)]), (430.0, [(0.0, 180.0), (160.0, 340.0)]), (700.0, [(160.0, 340.0), (320.0, 500.0)])]
    for i, (safe, spans) in enumerate(plan):
        spark.createDataFrame([("v", safe, a, b) for a, b in spans], "source_id string, safe_end double, start double, end double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("source_id string, safe_end double, start double, end double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    drain(live.progressive_windows(stream), out)
    assert sorted((r["start"], r["end"]) for r in spark.table(out).collect()) == [(0.0, 180.0), (160.0, 340.0), (320.0, 500.0)]


def test_upsert_is_idempotent(spark, tmp_path):
    write = live.upsert_results(f"{tmp_path}/out", ["k"])
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    for epoch in (0, 0, 1):
        write(batch, epoch)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    write(spark.createDataFrame([(3, "c"), (2, "other")], "k int, v string"), 2)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_live_progress(spark, tmp_path, out):
    spark.createDataFrame([("j", 100_000.0, 5.0), ("j", 100_010.0, 30.0), ("j", 100_020.0, 12.0)], "job_id string, t double, stage_value double").select("job_id", F.timestamp_seconds("t").alias("ts"), "stage_value").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema("job_id string, ts timestamp, stage_value double").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    drain(live.live_progress(stream), out)
    assert spark.table(out).agg(F.max("overall")).first()[0] == 30.0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/vod1.json").write_text('{"text": "a b", "words": [{"text": "a", "start": 0.5, "end": 1}, {"text": "b", "start": 2, "end": 3, "confidence": 0.5}]}')
    (tmp_path / "t/vod2.json").write_text('{"text": "", "words": []}')
    t = files.read_transcripts(spark, f"{tmp_path}/t")
    w = files.transcript_words(t)
    assert [(r["source_id"], r["text"], r["uncertain"]) for r in w.orderBy("word_idx").collect()] == [("vod1", "a", False), ("vod1", "b", False)]
    assert [r["source_id"] for r in files.empty_transcripts(t).collect()] == ["vod2"]
    (tmp_path / "g").mkdir()
    item = '{"gold_start": 1, "gold_end": 2, "event_type": "e"}'
    (tmp_path / "g/x.json").write_text(f"[{item}]")
    (tmp_path / "g/y.json").write_text(f'{{"moments": [{item}, {item}]}}')
    assert files.read_gold(spark, f"{tmp_path}/g").groupBy("source_id").count().orderBy("source_id").collect() == [("x", 1), ("y", 2)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/vod1.json").write_text('{"moments": [{"start": 0, "end": 1, "score": 5}]}')
    assert files.read_moments(spark, f"{tmp_path}/m", w).first()["text"] == "a"
    audit = spark.createDataFrame([(1, 50.0), (2, 10.0)], "id int, preliminary_score double")
    files.write_scout_audit(audit, f"{tmp_path}/audit")
    assert spark.read.parquet(f"{tmp_path}/audit").where("selected = 'true'").count() == 1
    (tmp_path / "a/u1/vod").mkdir(parents=True)
    (tmp_path / "a/u1/vod/chunk_20260815_140203.ts").write_bytes(b"123")
    row = files.with_chunk_start(files.list_artifacts(spark, f"{tmp_path}/a")).first()
    assert row["length"] == 3 and str(row["chunk_start"]) == "2026-08-15 14:02:03"
    lines = spark.createDataFrame([("c", 1, "one"), ("c", 2, "two")], "clip_id string, line int, value string")
    files.write_lines(lines, f"{tmp_path}/lines")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/lines/clip_id=c").collect()] == ["one", "two"]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/job7.log").write_text("PROGRESS scan 5\nerror\n")
    assert [(r["job_id"], r["line"]) for r in files.read_job_logs(spark, f"{tmp_path}/logs").orderBy("event_id").collect()] == [("job7", "PROGRESS scan 5"), ("job7", "error")]
    bad = spark.createDataFrame([(1, "{}"), (2, '{"phrases": [{"text": "hi", "words": []}]}'), (3, '{"phrases": [], "combinedPhrases": [{"text": "x"}]}'), (4, '{"phrases": []}')], "id int, response string")
    assert [r["error"] for r in files.phrase_errors(bad).orderBy("id").collect()] == ["no phrase list", "speech without word times", "text without words", None]
