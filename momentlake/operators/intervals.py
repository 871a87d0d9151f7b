"""Interval joins: equi-joins on (source, time bucket) with the exact predicate on top. Buckets split hot sources by time.

An interval stands in every bucket it touches, a point in one, so point joins have no duplicates; interval pairs are kept in the first
bucket they share. Sizes after explode can't be estimated, so each join names its strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import once
from .islands import CHUNK_SECONDS, running_before

BUCKET = 64.0


def bucket_of(t: Column, width: float = BUCKET) -> Column:
    return F.floor(t / width)


def exploded(df: DataFrame, start: Column, end: Column, width: float = BUCKET, name: str = "_bucket") -> DataFrame:
    """A row per bucket that [start, end] touches; reversed or null intervals have none."""
    last = F.greatest(bucket_of(end, width), bucket_of(start, width))
    return df.where(start.isNotNull() & end.isNotNull() & (start <= end)).withColumn(name, F.explode(F.sequence(bucket_of(start, width), last)))


def points_in_intervals(intervals: DataFrame, points: DataFrame, start: str = "start", end: str = "end", at: str = "at", source: str = "source_id", closed: bool = False, width: float = BUCKET) -> DataFrame:
    """Inner join of each interval with the points of its source in [start, end), or [start, end] if closed.

    points must not share column names with intervals other than the source.
    """
    left = exploded(intervals, F.col(start), F.col(end), width)
    right = points.withColumn("_bucket", bucket_of(F.col(at), width))
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end)))
    return left.join(right.hint("shuffle_merge"), [source, "_bucket"]).where(inside).drop("_bucket")


def words_text(intervals: DataFrame, words: DataFrame, key: list[str], start: str = "start", end: str = "end", closed: bool = False, name: str = "text", separator: str = " ", trim: bool = False) -> DataFrame:
    """intervals with the text of the words that start in them, in word order; empty where there are none. key identifies an interval within its source.

    Words meet intervals as one array per source and time bucket, and what an interval takes of a bucket is joined at once, so that
    texts are shuffled instead of a row per interval and word.
    """
    one = F.trim("text") if trim else F.col("text")
    spoken = words.select("source_id", bucket_of(F.col("start")).alias("_bucket"), F.struct(F.col("start").alias("at"), F.col("word_idx").alias("idx"), one.alias("w")).alias("_word")).where(F.col("_bucket").isNotNull())
    held = spoken.groupBy("source_id", "_bucket").agg(F.array_sort(F.collect_list("_word")).alias("_words"))
    asked = exploded(intervals.select("source_id", *key, F.col(start).alias("_s"), F.col(end).alias("_e")), F.col("_s"), F.col("_e"))
    inside = lambda x: (x["at"] >= F.col("_s")) & ((x["at"] <= F.col("_e")) if closed else (x["at"] < F.col("_e"))) & x["w"].isNotNull()
    taken = asked.join(held.hint("shuffle_merge"), ["source_id", "_bucket"]).select("source_id", *key, "_bucket", F.transform(F.filter("_words", inside), lambda x: x["w"]).alias("_taken"))
    parts = taken.where(F.size("_taken") > 0).select("source_id", *key, F.struct("_bucket", F.array_join("_taken", separator).alias("part")).alias("_part"))
    texts = parts.groupBy("source_id", *key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda x: x["part"]), separator).alias(name))
    return intervals.drop(name).join(texts.hint("shuffle_merge"), ["source_id", *key], "left").withColumn(name, F.coalesce(name, F.lit("")))


def context_text(candidates: DataFrame, words: DataFrame, key: list[str], before: float = 45.0, after: float = 20.0) -> DataFrame:
    """candidates with before_text, lines (`start [speaker] text`) and after_text from one join over the widened span."""
    wide = candidates.select("source_id", *key, F.col("start").alias("_s"), F.col("end").alias("_e"), F.greatest(F.lit(0.0), F.col("start") - before).alias("_from"), (F.col("end") + after).alias("_to"))
    spoken = words.select("source_id", F.col("word_idx").alias("_idx"), F.col("start").alias("_at"), F.col("text").alias("_text"), F.coalesce("speaker", F.lit("unknown speaker")).alias("_speaker"))
    found = points_in_intervals(wide, spoken, "_from", "_to", "_at")
    line = F.format_string("%.2f [%s] %s", "_at", "_speaker", "_text")

    def side(condition: Column, value: Column, separator: str) -> Column:
        picked = F.array_sort(F.collect_list(F.when(condition, F.struct(F.col("_at"), F.col("_idx"), value.alias("w")))))
        return F.array_join(F.transform(picked, lambda x: x["w"]), separator)

    texts = found.groupBy("source_id", *key).agg(side(F.col("_at") < F.col("_s"), F.col("_text"), " ").alias("before_text"), side((F.col("_at") >= F.col("_s")) & (F.col("_at") < F.col("_e")), line, "\n").alias("lines"), side(F.col("_at") >= F.col("_e"), F.col("_text"), " ").alias("after_text"))
    out = candidates.join(texts.hint("shuffle_merge"), ["source_id", *key], "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("before_text", "lines", "after_text")})


def overlapping_pairs(left: DataFrame, right: DataFrame, width: float = BUCKET) -> DataFrame:
    """Pairs of intervals (l_start, l_end), (r_start, r_end) of a source that overlap or touch, each pair once. Other columns must differ."""
    a = exploded(left, F.col("l_start"), F.col("l_end"), width)
    b = exploded(right, F.col("r_start"), F.col("r_end"), width)
    first = F.greatest(bucket_of(F.col("l_start"), width), bucket_of(F.col("r_start"), width))
    met = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end")) & (F.col("_bucket") == first)
    return a.join(b.hint("shuffle_merge"), ["source_id", "_bucket"]).where(met).drop("_bucket")


def temporal_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over the hull, 0 if the hull is empty."""
    overlap = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull > 0, overlap / hull).otherwise(0.0)


def best_match(items: DataFrame, choices: DataFrame, least: float = 0.20, width: float = BUCKET) -> DataFrame:
    """items (source_id, item_id, start, end) with choice_id and iou of the choice of most overlap (smallest choice_id on ties), null below `least`."""
    left = items.select("source_id", "item_id", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = choices.select("source_id", F.col("item_id").alias("choice_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    iou = temporal_iou(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    met = overlapping_pairs(left, right, width).withColumn("iou", iou).where(F.col("iou") >= least)
    best = met.groupBy("source_id", "item_id").agg(F.max_by(F.struct("choice_id", "iou"), F.struct(F.col("iou"), -F.col("choice_id"))).alias("best"))
    return items.join(best.hint("shuffle_merge"), ["source_id", "item_id"], "left").select(items["*"], F.col("best.choice_id").alias("choice_id"), F.col("best.iou").alias("iou"))


def chunks_in_range(ranges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_id, c_start, c_end) that touch each range (range_id, start, end), ends included."""
    left = ranges.select("source_id", "range_id", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    return overlapping_pairs(left, chunks.select("source_id", "chunk_id", F.col("c_start").alias("r_start"), F.col("c_end").alias("r_end"))).select("source_id", "range_id", "chunk_id")


def missing_clusters(clusters: DataFrame, candidates: DataFrame, tolerance: float = 15.0, width: float = BUCKET) -> DataFrame:
    """Clusters (source_id, center) of whose source no candidate, widened by the tolerance, holds the center."""
    wide = exploded(candidates.select("source_id", (F.col("start") - tolerance).alias("_s"), (F.col("end") + tolerance).alias("_e")), F.col("_s"), F.col("_e"), width)
    marked = clusters.withColumn("_bucket", bucket_of(F.col("center"), width))
    same = (marked["source_id"] == wide["source_id"]) & (marked["_bucket"] == wide["_bucket"]) & marked["center"].between(wide["_s"], wide["_e"])
    return marked.join(wide.hint("shuffle_merge"), same, "left_anti").drop("_bucket")


def nearest(times: DataFrame, marks: DataFrame, within: float, at: str = "at", mark: str = "mark", chunk: float = CHUNK_SECONDS) -> DataFrame:
    """times with `nearest`: the mark of its source closest to `at`, the earlier one on ties, null if none lies within `within` seconds.

    One pass over the union of both by time chunks: within a chunk the last mark before and the first after, across chunks those of the
    nearest chunks that have marks. Both are read twice, so costly ones are written first. Rows without a time have no nearest mark.
    """
    times, m = once(times), once(marks.select("source_id", F.col(mark).alias("_t")).where("_t is not null"))
    rows = times.withColumns({"_t": F.col(at), "_kind": F.lit(1)}).unionByName(m.distinct().withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    rows = rows.withColumns({"_chunk": F.floor(F.col("_t") / chunk), "_mark": F.when(F.col("_kind") == 0, F.col("_t"))})
    by = Window.partitionBy("source_id", "_chunk").orderBy("_t", "_kind")
    # A mark at the very time comes first, and so counts as one before.
    rows = rows.withColumns({"_prev": F.last("_mark", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), "_next": F.expr("lead(_mark) IGNORE NULLS OVER (PARTITION BY source_id, _chunk ORDER BY _t, _kind)")})
    held = rows.where("_kind = 1").groupBy("source_id", "_chunk").agg(F.lit(None).cast("double").alias("_low"), F.lit(None).cast("double").alias("_high"))
    held = held.unionByName(m.groupBy("source_id", F.floor(F.col("_t") / chunk).alias("_chunk")).agg(F.min("_t").cast("double").alias("_low"), F.max("_t").cast("double").alias("_high")))
    held = held.groupBy("source_id", "_chunk").agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"))
    chunks = Window.partitionBy("source_id").orderBy("_chunk")
    around = held.select("source_id", "_chunk", F.last("_high", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("_behind"), F.expr("lead(_low) IGNORE NULLS OVER (PARTITION BY source_id ORDER BY _chunk)").alias("_ahead"))
    near = rows.where("_kind = 1").alias("r").join(around.alias("c").hint("shuffle_merge"), (F.col("r.source_id") == F.col("c.source_id")) & F.col("r._chunk").eqNullSafe(F.col("c._chunk")), "left")
    prev, following = F.coalesce("_prev", "_behind"), F.coalesce("_next", "_ahead")
    pick = F.when(prev.isNotNull() & (following.isNull() | (F.col("_t") - prev <= following - F.col("_t"))), prev).otherwise(following)
    return near.select(*[F.col(f"r.{c}") for c in times.columns], F.when(F.abs(pick - F.col("_t")) <= within, pick).alias("nearest"))


def nearest_edges(clips: DataFrame, words: DataFrame, pad_before: float, pad_after: float, least: float, most: float | None) -> DataFrame:
    """Cut points on word edges: an as-of join forward to word starts and one backward to word ends (by the words' order)."""
    words = once(words)
    s, e = F.greatest(F.lit(0.0), F.col("start") - pad_before), F.col("end") + pad_after
    edges = clips.select("source_id", "clip_id", "start", "end").withColumns({"_s": s, "_e": e})
    t = edges.select("source_id", "clip_id", (F.col("_s") - 0.4).alias("_t"), F.lit(1).alias("_kind"))
    starts = t.unionByName(words.select("source_id", F.lit(None).cast(dict(clips.dtypes)["clip_id"]).alias("clip_id"), F.col("start").alias("_t"), F.lit(0).alias("_kind")))
    back = starts.withColumns({"_back": -F.col("_t"), "_order": F.col("_kind")})
    first = running_before(back, ["source_id"], "_back", ["_order", "clip_id"], "last", F.when(F.col("_kind") == 0, F.struct(F.col("_t").alias("v"))), "_first").where("_kind = 1").select("source_id", "clip_id", F.col("_first.v").alias("_first"))
    t = edges.select("source_id", "clip_id", (F.col("_e") + 0.4).alias("_t"), F.lit(1).alias("_kind"))
    ends = t.unionByName(words.select("source_id", F.lit(None).cast(dict(clips.dtypes)["clip_id"]).alias("clip_id"), F.col("end").alias("_t"), F.lit(0).alias("_kind")))
    last = running_before(ends, ["source_id"], "_t", ["_kind", "clip_id"], "last", F.when(F.col("_kind") == 0, F.struct(F.col("_t").alias("v"))), "_last").where("_kind = 1").select("source_id", "clip_id", F.col("_last.v").alias("_last"))
    joined = edges.join(first.hint("shuffle_merge"), ["source_id", "clip_id"]).join(last.hint("shuffle_merge"), ["source_id", "clip_id"])
    a = F.coalesce(F.greatest(F.lit(0.0), F.col("_first") - 0.15), F.col("_s"))
    b = F.coalesce(F.col("_last") + 0.25, F.col("_e"))
    limit = F.lit(most) if most is not None else F.greatest(F.lit(45.0), F.col("end") - F.col("start") + 3)
    long_enough = F.greatest(b, a + least)
    out = joined.withColumns({"cut_start": a, "cut_end": F.least(long_enough, a + limit)})
    return clips.join(out.select("source_id", "clip_id", "cut_start", "cut_end").hint("shuffle_merge"), ["source_id", "clip_id"])
