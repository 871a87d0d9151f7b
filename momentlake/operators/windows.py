"""Rolling transcript windows snapped to sentences, and the gates before scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import warm_window
from ..scratch import once
from .intervals import nearest, words_text
from .transcript import boundaries


def semantic_windows(words: DataFrame, settings: Settings = DEFAULTS, target: float | None = None, hop: float | None = None) -> DataFrame:
    """source_id, window_id, start, end, text: windows of about `target` seconds every `hop`, snapped to boundaries within 8 s; empty ones are left out."""
    target, hop = target or settings.window_seconds, max(1.0, hop or settings.window_hop)
    words = once(words)
    place, snap = F.struct("start", "word_idx"), settings.snap_seconds
    # Only windows near a word can have text, so silence costs nothing; what follows is made of one row per source and hop that has words.
    cells = once(words.groupBy("source_id", F.floor(F.col("start") / hop).alias("_cell")).agg(F.min("start").alias("_first"), F.max_by("end", place).alias("_end"), F.max(place).alias("_place")))
    spans = cells.groupBy("source_id").agg(F.min("_first").alias("t0"), F.max_by("_end", "_place").alias("last")).where("last > t0")
    steps = F.ceil((F.col("last") - F.col("t0")) / hop) - 1
    low, high = F.floor(F.col("_cell") - (F.col("t0") + target + snap) / hop) - 1, F.ceil(F.col("_cell") + 1 + (snap - F.col("t0")) / hop) + 1
    near = cells.select("source_id", "_cell").join(spans.hint("shuffle_merge"), "source_id").withColumns({"_low": F.greatest(F.lit(0), low).cast("int"), "_high": F.least(steps, high).cast("int")})
    grid = near.where("_low <= _high").select("source_id", "t0", "last", F.explode(F.sequence("_low", "_high")).alias("window_id")).distinct()
    grid = grid.select("source_id", "window_id", (F.col("t0") + F.col("window_id") * hop).alias("t"), "last").withColumn("e", F.least(F.col("t") + target, F.col("last")))
    marks = boundaries(words, settings.pause_seconds)
    sides = F.array(F.struct(F.lit("s").alias("side"), F.col("t").alias("at")), F.struct(F.lit("e").alias("side"), F.col("e").alias("at")))
    snapped = nearest(grid.select("source_id", "window_id", F.explode(sides).alias("x")).select("source_id", "window_id", "x.*"), marks, settings.snap_seconds)
    at = F.coalesce("nearest", "at")
    both = snapped.groupBy("source_id", "window_id").agg(F.max(F.when(F.col("side") == "s", F.when(F.col("window_id") == 0, F.col("at")).otherwise(at))).alias("start"), F.max(F.when(F.col("side") == "e", at)).alias("end"))
    spoken = words_text(both.where(F.col("end") > F.col("start")), words, ["window_id"], trim=True)
    return spoken.where("text != ''").select("source_id", "window_id", "start", "end", "text")


def distinct_windows(windows: DataFrame) -> DataFrame:
    """Exact repeats of (start, end, text) within a source go; the smallest window_id stays."""
    order = Window.partitionBy("source_id", "start", "end", F.xxhash64("text")).orderBy("window_id")
    return windows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def warm_windows(windows: DataFrame, min_words: int = DEFAULTS.min_scout_words, **lexicons) -> DataFrame:
    return windows.where(warm_window(F.col("text"), min_words, **lexicons))
