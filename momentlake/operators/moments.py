"""From scored candidates to moments: grouping neighbours, deciding merges, suppressing repeats, clustering offsets.

Only bounded islands of rows that can touch each other are folded in order; an island is found with two-level windows, so no source
lies in one task. Texts don't travel through the folds.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.scores import scores_compatible
from ..functions.text import topic_overlap
from ..scratch import once
from .islands import fold_sorted, running_before, with_island, with_previous
from .scorers import Scorer, apply_scorer


def is_action(kind: Column) -> Column:
    """Merging's own test of an action class."""
    k = F.upper(F.coalesce(kind, F.lit("")))
    return k.startswith("IRL_") | k.isin("CHAOS", "STATUS")


def joinable(candidates: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """candidates with prev, action, cap and joins: whether all tests but the span cap let a row join its predecessor."""
    s = settings
    rows = with_previous(candidates, ["source_id"], "start", ["candidate_id"], ["end", "score", "topic", "moment_type"])
    action = is_action(F.col("moment_type")) | is_action(F.col("prev.moment_type"))
    same = topic_overlap(F.coalesce("topic", F.lit("")), F.coalesce("prev.topic", F.lit(""))) >= s.same_topic
    gap, a, b = F.col("start") - F.col("prev.end"), F.col("score"), F.col("prev.score")
    base = F.when(action, s.irl_gap).otherwise(s.merge_gap)
    usual = ((gap <= base) | ((gap <= base * s.topic_gap_factor) & same)) & scores_compatible(a, b, same, s.clip_threshold, s.peak_floor, s.compatible_delta, s.compatible_floor)
    floor = F.when(action, s.irl_very_high_floor).otherwise(s.very_high_floor)
    peak = same & (a >= floor) & (b >= floor) & (gap <= F.when(action, s.irl_very_high_gap).otherwise(s.very_high_gap))
    joins = F.when((a >= s.very_high) | (b >= s.very_high), peak).otherwise(usual)
    return rows.withColumns({"action": action, "cap": F.when(action, s.irl_span).otherwise(s.merge_span), "joins": F.coalesce(joins, F.lit(False))})


class _Head:
    """The start and the id of the open group of an island."""

    start, id = None, None

    def take(self, row: tuple) -> tuple:
        source, _, candidate, start, end, cap = row
        if self.start is None or end - self.start > cap:  # a row that would stretch its group over its cap opens the next
            self.start, self.id = start, candidate
        return source, candidate, self.id


def group_candidates(candidates: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """candidates (source_id, candidate_id, start, end, score, topic, moment_type) with group_id, the candidate_id of the group's first row."""
    candidates = once(candidates)
    marked = joinable(candidates, settings)
    rows = with_island(marked, ["source_id"], "start", ["candidate_id"], ~F.col("joins"))
    types = dict(candidates.dtypes)
    small = rows.withColumn("island", F.xxhash64("island"))
    schema = f"source_id {types['source_id']}, candidate_id {types['candidate_id']}, group_id {types['candidate_id']}"
    heads = fold_sorted(small, ["source_id", "island"], ["start", "candidate_id"], ["candidate_id", "start", "end", "cap"], _Head, _Head.take, schema)
    return candidates.join(heads.hint("shuffle_merge"), ["source_id", "candidate_id"])


def group_stats(grouped: DataFrame) -> DataFrame:
    """Per group: size, start, end of the last member, topic of the first, mean and peak score, peak_id, text in order, whether the peak is an action.

    Of equal peaks the first counts. Scores are summed in order, so that a mean at a threshold doesn't depend on how rows were dealt.
    """
    place = F.struct("start", "candidate_id")
    peak = F.struct(F.col("score"), -F.struct("start").getField("start"), -F.col("candidate_id"))
    scores = F.transform(F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("start", "candidate_id", F.col("score").cast("double").alias("score"))))), lambda x: x["score"])
    mean = F.when(F.count("score") > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.count("score"))
    aggs = [
        F.count("*").alias("size"), F.min("start").alias("start"), F.max_by("end", place).alias("end"), F.min_by("topic", place).alias("topic"), mean.alias("mean_score"), F.max("score").alias("peak_score"),
        F.max_by("candidate_id", peak).alias("peak_id"), F.max_by(is_action(F.col("moment_type")), peak).alias("peak_action"), F.max_by("start", peak).alias("peak_start"), F.max_by("end", peak).alias("peak_end"),
    ]
    if "text" in grouped.columns:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "candidate_id", "text"))), lambda x: x["text"]), " ").alias("text"))
    return grouped.groupBy("source_id", "group_id").agg(*aggs)


def rescore_groups(groups: DataFrame, scorer: Scorer, batch: int = 8, partitions: int | None = None) -> DataFrame:
    """(source_id, group_id, score, error) of the joined texts of groups; a group whose call fails has no score."""
    return apply_scorer(groups, scorer, ["source_id", "group_id"], batch=batch, partitions=partitions)


def merge_candidates(candidates: DataFrame, scorer: Scorer, settings: Settings = DEFAULTS) -> DataFrame:
    """Candidates with text, grouped, scored anew as groups and decided: the columns of decide_merges."""
    groups = once(group_stats(group_candidates(candidates, settings)))
    return decide_merges(groups, once(rescore_groups(groups, scorer)), settings)


def decide_merges(groups: DataFrame, rescored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """groups with merged_score (from rescored: source_id, group_id, score), decision (merged, peak or drop) and the span and score that follow."""
    s = settings
    joined = groups.join(rescored.select("source_id", "group_id", F.col("score").alias("merged_score")).hint("shuffle_merge"), ["source_id", "group_id"], "left")
    diluted = (F.col("size") > 1) & (F.col("peak_score") - F.col("mean_score") >= F.when(F.col("peak_action"), s.irl_dilution).otherwise(s.dilution))
    m, p = F.col("merged_score"), F.col("peak_score")
    decision = (
        F.when(m.isNull(), F.when(p >= s.clip_threshold, "peak").otherwise("drop")).when((m < s.clip_threshold) & (p < s.peak_fallback), "drop")
        .when(diluted, "peak").when(m >= s.clip_threshold, "merged").otherwise("peak")
    )
    out = joined.withColumn("decision", decision)
    take = lambda merged, peak: F.when(F.col("decision") == "merged", F.col(merged)).otherwise(F.col(peak))
    return out.withColumns({"out_start": take("start", "peak_start"), "out_end": take("end", "peak_end"), "out_score": take("merged_score", "peak_score")})


class Kept:
    """What stays of an island: centers and spans in order."""

    def __init__(self, min_share: float, max_gap: float) -> None:
        self.min_share, self.max_gap = min_share, max_gap
        self.centers: list[float] = []
        #: By start, with the longest span so far, so that only spans that can reach a new one are looked at.
        self.spans: list[tuple[float, float]] = []
        self.longest = 0.0

    def meets(self, start: float, end: float) -> bool:
        center = (start + end) / 2
        at = bisect_left(self.centers, center)
        if any(abs(c - center) <= self.max_gap for c in self.centers[max(0, at - 1) : at + 1]):
            return True
        near = self.spans[bisect_left(self.spans, (start - self.longest,)) : bisect_left(self.spans, (end,))]
        shorter = [(min(end - start, b - a), min(end, b) - max(start, a)) for a, b in near]
        return any(n > 0 and max(0.0, both) / n >= self.min_share for n, both in shorter)

    def add(self, start: float, end: float) -> None:
        insort(self.centers, (start + end) / 2)
        insort(self.spans, (start, end))
        self.longest = max(self.longest, end - start)

    def take(self, row: tuple) -> tuple | None:
        source, _, candidate, start, end = row
        if self.meets(start, end):
            return None
        self.add(start, end)
        return source, candidate


def suppress_repeats(candidates: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The candidates that stay when the best go first and any that overlaps a kept one (share of the shorter) or lies too close to it goes.

    Rows can only meet if their spans, widened to half the closest allowed distance about their centers, touch; so islands of touching
    widened spans are folded on their own. Equal scores go in start order.
    """
    candidates = once(candidates)
    half, center = settings.center_gap / 2, (F.col("start") + F.col("end")) / 2
    wide = candidates.withColumns({"_a": F.least(F.col("start"), center - half), "_b": F.greatest(F.col("end"), center + half)})
    before = running_before(wide, ["source_id"], "_a", ["candidate_id"], "max", F.col("_b"), "_reach")
    islands = with_island(before, ["source_id"], "_a", ["candidate_id"], F.coalesce(F.col("_a") > F.col("_reach"), F.lit(True)))
    types = dict(candidates.dtypes)
    small = islands.withColumn("island", F.xxhash64("island"))
    schema = f"source_id {types['source_id']}, candidate_id {types['candidate_id']}"
    kept = fold_sorted(small, ["source_id", "island"], [F.desc("score"), "start", "candidate_id"], ["candidate_id", "start", "end"], lambda: Kept(settings.overlap_share, settings.center_gap), Kept.take, schema)
    return candidates.join(kept.hint("shuffle_merge"), ["source_id", "candidate_id"], "left_semi")


class _Reach:
    """The time that opened the group of an island's current row."""

    def __init__(self, reach: float) -> None:
        self.reach, self.head = reach, None

    def take(self, row: tuple) -> tuple:
        source, _, t, src = row
        if self.head is None or t - self.head > self.reach:
            self.head = t
        return source, self.head, t, src


def cluster_offsets(offsets: DataFrame, radius: float = 10.0, least: int = 4, margin: float = 8.0) -> DataFrame:
    """Clusters of times (source_id, t, src): groups from their first time on for twice the radius; those of `least` or more give center (median), start, end, count, sources."""
    known = offsets.where("t is not null")
    reach = 2 * radius
    rows = known.withColumn("src", F.coalesce("src", F.lit("")))
    prev = with_previous(rows, ["source_id"], "t", ["src"], ["t"])
    islands = with_island(prev, ["source_id"], "t", ["src"], F.coalesce(F.col("t") - F.col("prev.t") > reach, F.lit(True)))
    small = islands.select("source_id", F.xxhash64("island").alias("island"), F.col("t").cast("double").alias("t"), "src")
    schema = f"source_id {dict(offsets.dtypes)['source_id']}, g double, t double, src string"
    flat = fold_sorted(small, ["source_id", "island"], ["t", "src"], ["t", "src"], lambda: _Reach(reach), _Reach.take, schema)
    found = flat.groupBy("source_id", "g").agg(F.median("t").alias("center"), F.count("*").alias("count"), F.transform(F.array_sort(F.collect_list(F.struct("t", "src"))), lambda x: x["src"]).alias("sources")).where(F.col("count") >= least)
    return found.select("source_id", "center", F.greatest(F.lit(0.0), F.col("center") - margin).alias("start"), (F.col("center") + margin).alias("end"), "count", "sources")
