"""Call telemetry and stage timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A price list of more rows than this is joined by shuffle.
BROADCAST_ROWS = 10_000


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (model, input_tokens, output_tokens, ...) with cost by prices (model, input_price, output_price per million tokens); unknown models cost null."""
    small = prices.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(prices) if small else prices.hint("shuffle_merge")
    return calls.join(side, "model", "left").withColumn("cost", (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1_000_000)


def call_summary(calls: DataFrame) -> DataFrame:
    """Per job and kind: requests, seconds, tokens, failures, retries, cache hits, cost, and the last provider and model."""
    return calls.groupBy("job_id", "kind").agg(
        F.count("*").alias("requests"), F.sum("elapsed").alias("seconds"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if(~F.col("ok")).alias("failures"), F.count_if(F.col("retry")).alias("retries"), F.count_if(F.col("cached")).alias("cache_hits"),
        F.sum("cost").alias("cost"), F.max_by("provider", F.struct("ts", "call_id")).alias("last_provider"), F.max_by("model", F.struct("ts", "call_id")).alias("last_model"),
    )


def stage_timings(timings: DataFrame, durations: DataFrame, stages: list[str]) -> DataFrame:
    """Per job a column of seconds per stage, total, real_time_factor and speed_multiple over the source's duration."""
    wide = timings.groupBy("job_id").pivot("stage", stages).agg(F.sum("seconds"))
    total = sum((F.coalesce(F.col(f"`{s}`"), F.lit(0.0)) for s in stages), F.lit(0.0))
    joined = wide.withColumn("total_seconds", total).join(durations.hint("shuffle_merge"), "job_id", "left")
    return joined.withColumns({"real_time_factor": F.when(F.col("duration") > 0, F.col("total_seconds") / F.col("duration")), "speed_multiple": F.when(F.col("total_seconds") > 0, F.col("duration") / F.col("total_seconds"))})
