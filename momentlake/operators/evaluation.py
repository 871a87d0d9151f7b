"""Evaluation of predicted moments against human-labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import best_match


def gold_errors(gold: DataFrame) -> DataFrame:
    """gold with start, end (aliases) and errors: missing keys, or an end not after the start."""
    required = ("gold_start", "gold_end", "event_type", "why_it_is_good", "required_context", "payoff_timestamp")
    rules = [F.when(F.col(c).isNull(), f"missing {c}") for c in required] + [F.when(F.col("gold_end") <= F.col("gold_start"), "invalid range")]
    return gold.withColumns({"start": F.col("gold_start"), "end": F.col("gold_end"), "errors": F.array_compact(F.array(*rules))})


def evaluation_report(gold: DataFrame, predictions: DataFrame, least: float = 0.20, cuts: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Per source: counts, recall and precision at the cuts, mean boundary errors, useful share. Both sides: source_id, item_id, start, end; predictions: score.

    Many predictions may match one gold moment, and many gold moments one prediction.
    """
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "item_id")
    ranked = predictions.withColumn("rank", F.row_number().over(order))
    named = gold.select("source_id", F.col("item_id").alias("choice_id"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    hits = best_match(ranked, gold, least).join(named.hint("shuffle_merge"), ["source_id", "choice_id"], "left")
    matched = F.col("choice_id").isNotNull()
    by_prediction = hits.groupBy("source_id").agg(
        F.count("*").alias("predicted"), F.count_if(matched).alias("matched"), F.avg(F.abs(F.col("start") - F.col("g_start"))).alias("start_error"), F.avg(F.abs(F.col("end") - F.col("g_end"))).alias("end_error"),
        *[x for k in cuts for x in (F.count_if(matched & (F.col("rank") <= k)).alias(f"useful_{k}"), F.count_if(F.col("rank") <= k).alias(f"shown_{k}"))],
    )
    totals = gold.groupBy("source_id").agg(F.count("*").alias("gold"))
    recalled = None
    for k in cuts:
        found = best_match(gold.select("source_id", "item_id", "start", "end"), ranked.where(F.col("rank") <= k).select("source_id", "item_id", "start", "end"), least)
        one = found.groupBy("source_id").agg(F.count_if(F.col("choice_id").isNotNull()).alias(f"recalled_{k}"))
        recalled = one if recalled is None else recalled.join(one.hint("shuffle_merge"), "source_id", "full")
    out = totals.join(by_prediction.hint("shuffle_merge"), "source_id", "full").join(recalled.hint("shuffle_merge"), "source_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda a, b: F.when(n(b) > 0, n(a) / n(b)).otherwise(0.0)
    return out.select(
        "source_id", n("gold").alias("gold_moments"), n("predicted").alias("predicted_moments"), n("matched").alias("matched_predictions"), *[x for k in cuts for x in (share(f"recalled_{k}", "gold").alias(f"recall_at_{k}"), share(f"useful_{k}", f"shown_{k}").alias(f"precision_at_{k}"))],
        "start_error", "end_error", share("matched", "predicted").alias("useful_rate"),
    )


def pooled_report(report: DataFrame) -> DataFrame:
    """One row over all sources: sums, and the means over sources that count each source once."""
    return report.agg(F.sum("gold_moments").alias("gold_moments"), F.sum("predicted_moments").alias("predicted_moments"), F.sum("matched_predictions").alias("matched_predictions"), *[F.avg(c).alias(c) for c in report.columns if c.startswith(("recall", "precision", "useful"))])
