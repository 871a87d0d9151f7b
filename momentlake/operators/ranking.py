"""Top-k per source, guaranteed peaks, caps and choices. Ranks up to a fixed k use Spark's window group limit, so only k rows a task are kept; others are dealt by range."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import scan_priority
from .ranks import numbered


def top_n(df: DataFrame, n: int, keys: list[str] = ["source_id"], score: str = "score", ties: tuple[str, ...] = ("start", "candidate_id")) -> DataFrame:  # noqa: B006
    """The n best rows of each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def paying_off(df: DataFrame, least: float = DEFAULTS.min_payoff) -> DataFrame:
    """Rows whose breakdown's payoff, 3 where unknown, is at least 3."""
    return df.where(F.coalesce(F.element_at("breakdown", "payoff"), F.lit(3.0)) >= least)


def picked_indices(responses: DataFrame, counts: str = "n", response: str = "response", least: int = 3) -> DataFrame:
    """(source_id, index): indices a model picked, in range and distinct.

    Everything for short lists and for answers that can't be read as JSON or hold nothing to look through (a number, true, null). Of a
    list its whole numbers count, not digits in quotes; an empty list, and one without an index in range, picks nothing, and so do
    objects and strings. Code fences around the answer are taken off.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(response), "^```json", ""), "^```", ""), "```$", ""))
    parsed = F.try_parse_json(bare)
    kind = F.schema_of_variant(parsed)
    listed = F.filter(F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "BIGINT")
    chosen = F.array_distinct(F.filter(F.transform(listed, lambda x: F.try_variant_get(x, "$", "bigint")), lambda i: (i >= 0) & (i < F.col(counts))).cast("array<int>"))
    everything = F.sequence(F.lit(0), F.col(counts) - 1)
    readable = F.coalesce(kind.rlike("^(ARRAY|OBJECT|STRING)"), F.lit(False))
    rows = F.when((F.col(counts) <= least) | ~readable, everything).otherwise(chosen)
    return responses.where(F.col(counts) > 0).select("source_id", F.explode(rows).alias("index"))


#: From a shortlist's rows, in start order, the indices of those to keep.
Ranker = Callable[[list[dict]], list[int]]


def rank_shortlist(shortlist: DataFrame, ranker: Ranker, columns: list[str], least: int = 3, key: str = "candidate_id") -> DataFrame:
    """The rows of each source's shortlist that the ranker picks; all of a short list, and all if the ranker fails or answers otherwise.

    A shortlist is what suppression and caps have left of one source, a few hundred rows; sources are dealt to tasks by hash, and a
    task holds one shortlist at a time.
    """
    fields, types = ["source_id", key, "start", *columns], dict(shortlist.dtypes)

    def picked(rows: list[dict]) -> list[dict]:
        if len(rows) <= least:
            return rows
        try:
            chosen = ranker(rows)
            good = {i for i in chosen if isinstance(i, int) and not isinstance(i, bool) and 0 <= i < len(rows)}
        except Exception:  # noqa: BLE001  any failure of the user's ranker
            return rows
        return [rows[i] for i in sorted(good)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []

        def done(rows: list[dict]) -> pd.DataFrame:
            kept = picked(rows)
            return pd.DataFrame({"source_id": [r["source_id"] for r in kept], key: [r[key] for r in kept]})

        for pdf in parts:
            for row in pdf.to_dict("records"):
                if held and held[0]["source_id"] != row["source_id"]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    dealt = shortlist.select(*fields).repartition("source_id").sortWithinPartitions("source_id", "start", key)
    chosen = dealt.mapInPandas(run, f"source_id {types['source_id']}, `{key}` {types[key]}")
    return shortlist.join(chosen.hint("shuffle_merge"), ["source_id", key], "left_semi")


def keep_chosen(candidates: DataFrame, chosen: DataFrame, very_high: float = DEFAULTS.very_high) -> DataFrame:
    """Candidates that were chosen (source_id, candidate_id), and all peaks."""
    picked = chosen.select("source_id", "candidate_id").distinct().withColumn("_chosen", F.lit(True))
    joined = candidates.join(picked.hint("shuffle_merge"), ["source_id", "candidate_id"], "left")
    return joined.where(F.col("_chosen").isNotNull() | (F.col("score") >= very_high)).drop("_chosen")


def cap_exports(candidates: DataFrame, sources: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """At most 8 candidates per started hour (sources: source_id, duration), or as many as there are peaks; peaks always stay, the rest goes by score.

    The cap of a long source is no bound for a task, so ranks are dealt by range (ranks.numbered), which runs jobs when this is called.
    """
    hours = F.greatest(F.lit(1.0), F.col("duration") / 3600)
    locked = F.col("score") >= settings.very_high
    totals = candidates.groupBy("source_id").agg(F.count_if(locked).alias("_locked"))
    caps = totals.join(sources.select("source_id", "duration").hint("shuffle_merge"), "source_id").select("source_id", F.greatest("_locked", (settings.clips_per_hour * hours).cast("int")).alias("_cap"))
    ranked = numbered(candidates.join(caps.hint("shuffle_merge"), "source_id").withColumn("_locked", locked.cast("int")), ["source_id"], [F.desc("_locked"), F.desc("score"), "start", "candidate_id"], "_n")
    return ranked.where(F.col("_n") <= F.col("_cap")).drop("_n", "_cap", "_locked")


def best_profile(profiles: DataFrame, max_wer: float, min_recall: float, max_errors: int, require: bool = False) -> DataFrame:
    """The fastest measured profile within the limits: one row, or none (an error with `require`)."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    good = profiles.where(finite("wer") & finite("candidate_recall") & finite("boundary_errors") & finite("total_seconds")).where((F.col("wer") <= max_wer) & (F.col("candidate_recall") >= min_recall) & (F.col("boundary_errors") <= max_errors) & (F.col("total_seconds") > 0))
    best = good.agg(F.min_by(F.struct(*profiles.columns), F.struct("total_seconds", *[c for c in profiles.columns if c != "total_seconds"])).alias("p"))
    if require:
        return best.select(F.when(F.col("p").isNull(), F.raise_error(F.lit("no measured profile meets the targets"))).otherwise(F.col("p")).alias("p")).select("p.*")
    return best.where("p is not null").select("p.*")


def scan_order(windows: DataFrame, names: list[str], **keywords) -> DataFrame:
    """windows with priority and rank within their source: the more promising first. Ranks are dealt by range, which runs jobs when this is called."""
    ranked = windows.withColumn("priority", scan_priority(F.col("text"), names, **keywords))
    return numbered(ranked, ["source_id"], [F.desc("priority"), "window_id"]).withColumn("rank", F.col("rank").cast("int"))


def latest_prior(jobs: DataFrame, key: list[str], id: str = "job_id", columns: list[str] | None = None) -> DataFrame:  # noqa: A002
    """The row of the greatest id per key."""
    columns = columns or [c for c in jobs.columns if c not in key]
    return jobs.groupBy(*key).agg(F.max_by(F.struct(*columns), id).alias("j")).select(*key, "j.*")


def newest_first(df: DataFrame, id: str) -> DataFrame:  # noqa: A002
    return df.orderBy(F.desc(id))


def locked_or(chosen: Column, score: Column, very_high: float = DEFAULTS.very_high) -> Column:
    return F.coalesce(chosen, F.lit(False)) | (score >= very_high)
