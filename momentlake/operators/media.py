"""Measures of sound, faces and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import fold_sorted


def audio_level(samples: Column) -> Column:
    """STRUCT<available, rms_dbfs, peak_dbfs> of an array of samples; floor 1e-9, two digits."""
    x = samples
    n = F.size(x)
    rms = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / n)
    peak = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    db = lambda c: F.bround(20 * F.log10(F.greatest(c, F.lit(1e-9))), 2)
    there = F.coalesce(n > 0, F.lit(False))
    return F.struct(there.alias("available"), F.when(there, db(rms)).alias("rms_dbfs"), F.when(there, db(peak)).alias("peak_dbfs"))


def locked_speaker(faces: DataFrame) -> DataFrame:
    """Per clip the track of most activity in all (the smallest id on ties)."""
    totals = faces.groupBy("clip_id", "track_id").agg(F.sum("activity").alias("total"))
    return totals.groupBy("clip_id").agg(F.max_by("track_id", F.struct(F.col("total"), -F.col("track_id"))).alias("track_id"))


def active_speaker(faces: DataFrame, recent: int = 3) -> DataFrame:
    """Per clip and frame the track of the highest mean over its last 3 activities (the smallest id on ties). A clip's frames are bounded."""
    past = Window.partitionBy("clip_id", "track_id").orderBy("frame_idx").rowsBetween(-(recent - 1), 0)
    means = faces.withColumn("mean", F.avg("activity").over(past))
    return means.groupBy("clip_id", "frame_idx").agg(F.max_by("track_id", F.struct(F.col("mean"), -F.col("track_id"))).alias("track_id"))


def frame_picks(samples: DataFrame, clips: DataFrame, most: int = 6, slots: int = 24) -> DataFrame:
    """(clip_id, second): the first, middle and last sample and those of most change, none closer than a 24th of the clip, at most 6."""
    joined = samples.join(clips.select("clip_id", "start", "end").hint("shuffle_merge"), "clip_id")

    def pick(seen: list[tuple]) -> list[tuple]:
        clip, seconds, apart = seen[0][0], [r[1] for r in seen], (seen[0][4] - seen[0][3]) / slots
        chosen = {0, len(seen) // 2, len(seen) - 1}
        for i in sorted(range(len(seen)), key=lambda i: -seen[i][2]):
            if len(chosen) < most and all(abs(seconds[i] - seconds[j]) >= apart for j in chosen):
                chosen.add(i)
        return [(clip, seconds[i]) for i in sorted(chosen)]

    return fold_sorted(joined, ["clip_id"], ["second"], ["second", "change", "start", "end"], list, list.append, f"clip_id {dict(samples.dtypes)['clip_id']}, second double", pick)


def snap_clips(clips: DataFrame, words: DataFrame, pad_before: float = 0.8, pad_after: float = 1.2, least: float = 12.0, most: float | None = 45.0) -> DataFrame:
    """clips (source_id, clip_id, start, end) with cut_start, cut_end on word edges; most None: 45 s, or the clip's length plus 3 if that's more.

    The first word that starts at or after the padded start (0.4 s earlier counts) and the last word that ends by the padded end decide.
    """
    from .intervals import nearest_edges

    return nearest_edges(clips, words, pad_before, pad_after, least, most)
