"""Work that grows with what is said, not with the time or the words around it."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from momentlake.functions import text
from momentlake.operators import intervals, scout, transcript, windows


def test_seam_keeps_only_what_can_be_heard_again():
    """A talk without a pause, heard twice: merged words leave chunk by chunk, and nothing is lost or doubled."""
    seam, out, most = transcript._Seam(), [], 0
    for k in range(100):
        a = max(0.0, k * 60 - 30.0)
        for i in range(int(a * 2), k * 120 + 180):
            out += seam.take(("v", 0.0, a, k, f"w{i % 7}", i / 2, i / 2 + 0.25, (k + i) % 5 / 8, None, False)) or []
            most = max(most, len(seam.rows))
    out += seam.finish()
    starts = [r[2] for r in out]
    assert most < 400 and starts == [i / 2 for i in range(99 * 120 + 180)] and not any(r[-1] for r in out)
    assert all(r[4] == max((k + i) % 5 / 8 for k in (i // 120 - 1, i // 120, i // 120 + 1) if 0 <= k < 100 and max(0, k * 120 - 60) <= i < k * 120 + 180) for i, r in enumerate(out))


def test_stretches_across_time_chunks(spark):
    """Pauses cut, and only pauses: a talk of 20,000 s without one stays whole, wherever time chunks end."""
    rng, rows = random.Random(3), []
    for source in ("a", "b", "c"):
        t = rng.uniform(0, 5000)
        for i in range(20_000):
            t += 0.5 if source == "a" or rng.random() < 0.9 else rng.choice([0.6, 0.7, 5.0, 5000.0 if i % 50 == 0 else 0.7])
            rows += [(source, k, 0.0, 0.0, "w", t, t + 0.2, 0.5, None, False) for k in range(2)]
    words = spark.createDataFrame(rows, "source_id string, index long, audio_start double, audio_end double, text string, start double, end double, confidence double, speaker string, uncertain boolean").repartition(7)
    want, last = {}, (None, 0.0, 0.0)
    for source, *_, t, _, _, _, _ in sorted(rows, key=lambda r: (r[0], r[5])):
        name = last[2] if last[0] == source and not t - last[1] > transcript.PAUSE else t
        want[source, t], last = name, (source, t, name)
    got = transcript._between_pauses(words).select("source_id", "start", "seam").collect()
    assert len(got) == len(rows) and all(want[r[0], r[1]] == r[2] for r in got)
    assert len({r[2] for r in got if r[0] == "a"}) == 1


def test_windows_of_silence_are_not_made(spark, monkeypatch):
    """A word a day: the grid follows the words, and windows, texts and ids are those of the whole grid."""
    rows = [("v", i, f"w{i}.", day * 86400.0 + 3.0 + i, day * 86400.0 + 3.9 + i) for day in range(5) for i in (0, 1, 4, 30)] + [("u", i, "x", -5.0 + i * 20, -4.5 + i * 20) for i in range(9)]
    words = spark.createDataFrame(rows, "source_id string, word_idx long, text string, start double, end double").withColumns({"confidence": F.lit(1.0), "speaker": F.lit("s"), "uncertain": F.lit(False)})
    asked = []
    monkeypatch.setattr(windows, "nearest", lambda times, *a: asked.append(times.count()) or intervals.nearest(times, *a))
    got = {tuple(r) for r in windows.semantic_windows(words, target=20.0, hop=10.0).collect()}
    marks, want = transcript.boundaries(words).collect(), set()
    for v in ("u", "v"):
        mine = sorted((r[3], r[4], r[2]) for r in rows if r[0] == v)
        t0, last = mine[0][0], mine[-1][1]
        near = lambda t: min((m["mark"] for m in marks if m["source_id"] == v and abs(m["mark"] - t) <= 8), key=lambda m: (abs(m - t), m), default=t)  # noqa: B023, E731
        for k in range(math.ceil((last - t0) / 10)):
            t, e = t0 + k * 10, min(t0 + k * 10 + 20, last)
            a, b = t if k == 0 else near(t), near(e)
            if text := " ".join(w for s, _, w in mine if a <= s < b):
                want.add((v, k, a, b, text))
    assert got == want and asked[0] < 400


def test_lexicon_in_one_look(spark):
    """Inflected words in place of stemming each word, phrases as one pattern: the same texts are met, through one search and no lambda per word."""
    lexicon, phrases = ["screaming", "fight", "hit", "seeding", "ed", "Off", "king"], (r"\b(on the (bonnet|hood))\b", r"\b(we'?re cooked)\b", r"\bof the\b")
    said = ["screaming", "screamed", "scream", "fighting", "fights", "hit", "hiting", "hitting", "seed", "seeded", "seeding", "ed", "bed", "king", "kinging", "kinging!", "off", "On\tthe  HOOD", "on the hoods", "WE'RE cooked", "were cookeds", "end of the", "x-of-the-y", "", None, " ' ", "İk fight"]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("t"), r"[^a-z0-9'\s]", " "), r"\s+", " "))
    words = F.filter(F.split(F.coalesce(plain, F.lit("")), r"\s+"), lambda w: w != "")
    slow = F.arrays_overlap(F.transform(words, text.stem), F.array(*[F.lit(w) for w in text.stem_words(lexicon)]))
    for p in phrases:
        slow = slow | plain.rlike(p)
    got = df.select("t", text.stem_hit(F.col("t"), lexicon, phrases).alias("a"), F.coalesce(slow, F.lit(False)).alias("b"), text.normalize_text(F.col("t")).alias("n"), plain.alias("m"))
    assert all(r["a"] == r["b"] and r["n"] == r["m"] for r in got.collect())
    assert "lambda" not in got.select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert text._one_pattern(phrases) == [r"\b(on the (bonnet|hood)|we'?re cooked)\b", r"\bof the\b"]


def test_spans_are_worked_out_once(spark):
    """A candidate's times are parsed once each in the plan, not once per use."""
    w = spark.createDataFrame([("v", 0, 1000.0, 1200.0, '{"candidates": [{"start": "1010000", "end": "20"}, {"start": "x"}, null, {"start": 1100, "end": 1050.5, "reason": ""}, {"start": 1100, "end": 1100}]}')], "source_id string, window_id int, start double, end double, response string")
    got = scout.scout_candidates(w)
    assert [tuple(r)[2:5] + (r["action"],) for r in got.orderBy("candidate_no").collect()] == [(0, 998.0, 1010.0, "keep"), (3, 1050.5, 1100.0, "keep")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("try_cast(c#") <= 2 + 6 + 2


def test_score_rows_sorted_once(spark):
    """Of rows with one index the first valid one counts; no aggregate sorts them apart from the join."""
    row = lambda i, hook, reason: f'{{"index": {i}, "hook": {hook}, "payoff": 1, "emotion": 1, "standalone": 1, "subject": 1, "technical": 1, "reason": "{reason}"}}'
    responses = spark.createDataFrame([(1, f'[{row(0, 11, "out")}, {row(0, 2, "first")}, {row(0, 3, "second")}, {row(1, chr(34) + "NaN" + chr(34), "nan")}, {row(2, 5, "blank")}]')], "batch_id int, response string")
    asked = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b", " ", "d"])], "batch_id int, index int, text string")
    done = scout.score_results(asked, responses)
    got = {r["index"]: (r["breakdown"] and r["breakdown"]["hook"], r["reason"]) for r in done.collect()}
    assert got == {0: (2.0, "first"), 1: (None, None), 2: (0.0, "skipped"), 3: (None, None)}
    assert "Aggregate" not in done._jdf.queryExecution().executedPlan().toString()
