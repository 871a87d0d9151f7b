"""Editorial reviews: validity, evidence checks, and what an accepted review changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import WEIGHTS, component_score, payoff_ok, reviewed_score, suggested_trim, valid_components
from .intervals import points_in_intervals, words_text


def review_errors(before: float = 90.0, after: float = 30.0, longest: float = 180.0) -> Column:
    """What is wrong with a review joined with its candidate's c_start and c_end; empty for a good one."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    a, b = F.col("c_start") - before, F.col("c_end") + after
    texts = [F.when(F.col(c).isNull(), f"no {c}") for c in ("literal_event", "social_interpretation", "skeptic", "uncertainties")]
    held = F.lit(True)
    for k in WEIGHTS:
        held = held & F.element_at("scores", k).isNotNull()
    times = F.forall("evidence", lambda e: finite(e["time"]) & e["time"].between(a, b) & e["quote"].isNotNull())
    span = F.col("start").isNotNull() & F.col("end").isNotNull() & ~((F.col("end") > F.col("start")) & (F.col("end") - F.col("start") <= longest) & (F.col("start") >= a) & (F.col("end") <= b) & (F.col("start") < F.col("c_end")) & (F.col("end") > F.col("c_start")))
    return F.array_compact(F.array(
        *texts, F.when(F.col("scores").isNull() | ~F.coalesce(held & valid_components(F.col("scores")), F.lit(False)), "bad scores"),
        F.when(~(finite(F.col("confidence")) & F.col("confidence").between(0, 1)), "bad confidence"), F.when(F.col("confidence").isNull(), "no confidence"),
        F.when(F.col("evidence").isNull() | (F.size("evidence") == 0), "no evidence").when(~times, "evidence outside"), F.when(span, "bad span"),
    ))


def evidence_found(reviews: DataFrame, words: DataFrame, before: float = 2.0, after: float = 8.0) -> DataFrame:
    """(source_id, candidate_id, evidence_ok): whether every quote is said by the words that start from 2 s before its time to 8 s after."""
    quotes = reviews.select("source_id", "candidate_id", F.posexplode("evidence").alias("n", "e")).select("source_id", "candidate_id", "n", (F.col("e.time") - before).alias("start"), (F.col("e.time") + after).alias("end"), F.col("e.quote").alias("quote"))
    heard = words_text(quotes, words, ["candidate_id", "n"], closed=True, name="said")
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    return heard.groupBy("source_id", "candidate_id").agg(F.bool_and(F.contains(plain(F.col("said")), F.trim(plain(F.col("quote"))))).alias("evidence_ok"))


def checked_reviews(reviews: DataFrame, candidates: DataFrame, words: DataFrame) -> DataFrame:
    """reviews with c_start, c_end and errors, evidence included."""
    known = candidates.select("source_id", "candidate_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    joined = reviews.join(known.hint("shuffle_merge"), ["source_id", "candidate_id"]).withColumn("errors", review_errors())
    said = evidence_found(joined.where(F.size("errors") == 0), words)
    out = joined.join(said.hint("shuffle_merge"), ["source_id", "candidate_id"], "left")
    unsaid = F.when(F.coalesce("evidence_ok", F.lit(True)), F.array().cast("array<string>")).otherwise(F.array(F.lit("quote not said")))
    return out.withColumn("errors", F.concat("errors", unsaid)).drop("evidence_ok")


def apply_reviews(candidates: DataFrame, reviews: DataFrame, visual: bool = False) -> DataFrame:
    """candidates with the score, span, breakdown, cut and moment scores and trim that an accepted review gives; others unchanged.

    reviews: source_id, candidate_id, confidence, scores, start, end, tightness, hook_at_seconds, payoff_at_seconds, payoff_type.
    """
    r = reviews.select("source_id", "candidate_id", *[F.col(c).alias(f"r_{c}") for c in ("confidence", "scores", "start", "end", "tightness", "hook_at_seconds", "payoff_at_seconds", "payoff_type")])
    j = candidates.join(r.hint("shuffle_merge"), ["source_id", "candidate_id"], "left")
    start, end = F.coalesce("r_start", "start"), F.coalesce("r_end", "end")
    payoff = F.coalesce(F.element_at("r_scores", "payoff"), F.lit(0.0))
    ok = payoff_ok(F.col("r_payoff_at_seconds"), start, end, F.lower("r_payoff_type"), payoff, visual)
    comps = component_score(F.col("r_scores"), F.col("moment_type"), F.coalesce("r_tightness", "tightness", F.lit(70.0)), ok, start, end, F.col("r_hook_at_seconds"), F.col("r_payoff_at_seconds"))
    seen, sure = F.col("r_confidence").isNotNull(), F.coalesce(F.col("r_confidence") >= 0.65, F.lit(False))
    staged = j.withColumns({"_c": comps, "_ok": ok})
    new = {
        "score": F.when(seen, reviewed_score(F.col("score"), F.col("_c.final"), F.col("r_confidence"), payoff, F.col("_ok"))).otherwise(F.col("score")), "start": F.when(sure, start).otherwise(F.col("start")), "end": F.when(sure, end).otherwise(F.col("end")),
        "breakdown": F.when(sure, F.col("r_scores")).otherwise(F.col("breakdown")), "moment_score": F.when(seen, F.col("_c.moment")), "cut_score": F.when(seen, F.col("_c.cut")),
        "suggested_trim": F.when(seen, suggested_trim(F.col("r_hook_at_seconds"), start, end)).otherwise(""),
    }
    return staged.withColumns(new).drop("_c", "_ok", *[f"r_{c}" for c in ("confidence", "scores", "start", "end", "tightness", "hook_at_seconds", "payoff_at_seconds", "payoff_type")])


def review_context(candidates: DataFrame, words: DataFrame, before: float = 90.0, after: float = 30.0) -> DataFrame:
    """candidates with `context`, the words from 90 s before to 30 s after them."""
    wide = candidates.select("source_id", "candidate_id", (F.col("start") - before).alias("start"), (F.col("end") + after).alias("end"))
    texts = words_text(wide, words, ["candidate_id"], name="context").select("source_id", "candidate_id", "context")
    return candidates.join(texts.hint("shuffle_merge"), ["source_id", "candidate_id"])


def evidence_words(evidence: DataFrame, words: DataFrame) -> DataFrame:
    """Words that start from 2 s before to 8 s after each evidence time (source_id, evidence_id, time), ends included."""
    spans = evidence.select("source_id", "evidence_id", (F.col("time") - 2).alias("start"), (F.col("time") + 8).alias("end"))
    return points_in_intervals(spans, words.select("source_id", "word_idx", F.col("start").alias("at"), "text"), closed=True)
