"""Queries read every row of their tables, not only rows on which SQL is sure to agree."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from momentlake.functions import text as T
from momentlake.plans.bindings import words
from momentlake.plans.queries import QUERIES
from tests.test_queries import SF

ROWS = {
    "documents": ("f1_normalize_text", "f3_has_action", "f4_name_only_spam", "f5_keep_local_window", "f15_redact_terms", "f18_strip_names", "u5_keyword_intersection"),
    "conversations": ("f19_verify_quotes", "p18_quote_or_blank"), "orders": ("f26_hold_amount",),
    "lineitem": ("p17_score_results", "p19_review_errors"),
}


@pytest.mark.parametrize(("table", "name"), [(t, n) for t, names in ROWS.items() for n in names])
def test_every_row_is_there(spark, table, name):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_every_document_with_a_word_has_stems(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("text").rlike("[A-Za-z0-9']"))
    assert QUERIES["f2_stems"](spark, SF).count() == docs.count()


def test_repeated_lines_are_there(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    good = rows.where("l_orderkey % 3 <> 0").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("most")).where("most <= 49")
    assert QUERIES["p9_strict_scores"](spark, SF).count() == good.agg(F.sum("n")).first()[0]
    kept = QUERIES["p8_scout_candidates"](spark, SF).where("n > 7").count()
    assert kept > 0  # more candidates than line numbers
    high = QUERIES["p13_scout_threshold"](spark, SF).where("n > 7").count()
    assert 0 < high <= kept


def test_every_likely_word_is_a_candidate(spark):
    likely = words(spark, SF).where("confidence * 100 >= 36").count()
    turns = words(spark, SF).where("word_idx % 100000 = 4").count()
    assert turns < QUERIES["p14_expand_context"](spark, SF).count() <= likely  # equal spans count once


def test_whole_turns_are_parsed(spark):
    spoken = words(spark, SF)
    assert QUERIES["s4_phrase_words"](spark, SF).count() == QUERIES["s5_flat_words"](spark, SF).count() == spoken.count()
    lines = QUERIES["s12_dialogue_lines"](spark, SF)
    of_four = spoken.groupBy("source_id", F.floor(F.col("word_idx") / 100_000)).agg(F.ceil(F.count("*") / 4).alias("n")).agg(F.sum("n")).first()[0]
    assert lines.count() == of_four and lines.where(F.col("value").rlike(r"^Dialogue: 0,0:0[1-9]:")).count() > 0


def test_repair_ranges_by_islands(spark):
    """Against one pass over each source's candidates, best first; one source has most of them."""
    import random

    from momentlake.operators import transcript

    rng = random.Random(3)
    sources = ["hot"] * 400 + ["a", "b", "c"] * 15
    cands = [(s, i, float(t := rng.randrange(0, 20_000)), t + rng.choice([8.0, 20.0, 70.0]), float(rng.randrange(1, 40))) for i, s in enumerate(sources)]
    words = [(s, i * 2.0, i * 2.0 + 1, rng.choice([0.9, 0.9, 0.3, None]), False) for s in ("hot", "a", "b", "c") for i in range(10_000)]
    c = spark.createDataFrame(cands, "source_id string, candidate_id long, start double, end double, score double")
    w = spark.createDataFrame(words, "source_id string, start double, end double, confidence double, uncertain boolean")
    for limit in (0, 3, 50):
        want = []
        for source in sorted(set(sources)):
            mine = [x for x in words if x[0] == source]
            kept = []
            for _, cid, a, b, score in sorted((x for x in cands if x[0] == source), key=lambda x: (-x[4], x[1])):
                bad = [x for x in mine if a <= x[1] < b and (x[4] or (x[3] is not None and x[3] < 0.5))]
                if not bad or len(kept) >= limit:
                    continue
                start = max(0.0, bad[0][1] - 5)
                end = min(min(mine[-1][2], bad[-1][2] + 5), start + 60)
                if not any(p <= start <= q for p, q in kept):
                    kept.append((start, end))
            want += [(source, i, *k) for i, k in enumerate(kept)]
        assert sorted(map(tuple, transcript.repair_ranges(c, w, limit).collect())) == want and (limit == 0 or len(want) > 3)


def test_half_overlapping_chunks_are_merged_between_pauses(spark):
    """A source of six hours in one-minute chunks that overlap by half, against one fold over the whole source."""
    import random

    from pyspark.sql import functions as F

    from momentlake.operators import transcript

    rng = random.Random(5)
    spoken, t = [], 0.0
    while t < 6 * 3600:
        t += rng.choice([0.25, 0.4, 0.5, 0.6, 0.7, 3.0])
        spoken.append((t, rng.choice(["yes", "no", "go", "well", f"w{rng.randrange(50)}"])))
    rows = []
    for k in range(6 * 60):
        a, b = max(0.0, k * 60 - 30.0), k * 60 + 90.0
        for s, text in spoken:
            if a <= s < b and rng.random() < 0.95:
                at = max(a, s + rng.choice([0.0, 0.0, 0.1, 0.3]))
                rows.append(("v", k, a, b, text if rng.random() < 0.9 else "other", at, at + 0.2, rng.choice([None, 0.25, 0.5, 0.75]), None, False))
    words = spark.createDataFrame(rows, "source_id string, index long, audio_start double, audio_end double, text string, start double, end double, confidence double, speaker string, uncertain boolean").repartition(5)
    got = transcript.merge_overlaps(words, 60, 30)
    want = transcript._merged(words.withColumn("seam", F.lit(0)))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.where("uncertain").count() > 10
    assert transcript._between_pauses(words).select("seam").distinct().count() > 1_000


def test_replaced_tables(spark, tmp_path):
    """A reader from before goes on, a write that fails changes nothing, old versions go."""
    import pytest
    from pyspark.sql import functions as F

    from momentlake.sources import files

    path = str(tmp_path / "t")
    files.replace_table(spark.range(3), path)
    first = files.read_replaced(spark, path)
    files.replace_table(spark.range(5), path, keep=2)
    assert first.count() == 3 and files.read_replaced(spark, path).count() == 5
    with pytest.raises(Exception, match="no more"):
        files.replace_table(spark.range(9).select(F.raise_error(F.lit("no more")).alias("id")), path)
    assert files.read_replaced(spark, path, "id long").count() == 5
    files.replace_table(spark.range(7), path, format="json")
    assert files.read_replaced(spark, path).count() == 7
    assert sum(p.name.startswith("v-") for p in (tmp_path / "t").iterdir()) == 2


def test_growing_chunks_are_held_back(spark, tmp_path):
    from momentlake.streaming import live

    folder = tmp_path / "in"
    folder.mkdir()
    poll, seen = live.poll_chunks(str(folder), str(tmp_path / "out")), lambda: sorted((r["path"][-9:-3], r["length"], r["epoch"]) for r in spark.read.parquet(str(tmp_path / "out/chunks")).collect())
    name = lambda i: folder / f"chunk_20260815_14000{i}.ts"
    name(0).write_bytes(b"abc")
    name(1).write_bytes(b"d")
    poll(spark.range(1), 0)
    assert seen() == [("140000", 3, 0)]
    name(1).write_bytes(b"defg")  # still growing
    poll(spark.range(1), 1)
    assert seen() == [("140000", 3, 0)]
    poll(spark.range(1), 2)  # it stood still
    poll(spark.range(1), 2)  # repeated
    assert seen() == [("140000", 3, 0), ("140001", 4, 2)]
    name(2).write_bytes(b"h")
    name(3).write_bytes(b"i")
    poll(spark.range(1), 3)
    assert seen() == [("140000", 3, 0), ("140001", 4, 2), ("140002", 1, 3)]
