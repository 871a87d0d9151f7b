"""Score functions over columns: component scores, tiers, normalised editor fields. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the editorial score.
WEIGHTS = {"hook": 0.25, "payoff": 0.25, "emotion": 0.20, "standalone": 0.15, "subject": 0.10, "technical": 0.05}
# Event classes; those scored by the shorter limits.
EVENT_CLASSES = (
    "IRL_ACTION", "IRL_REACTION", "QUOTE", "CONFRONTATION", "REVEAL", "ACCUSATION", "REJECTION", "COMEDY", "AWKWARD", "REACTION", "FLEX_FAIL", "MONEY_STATUS", "HEART",
    "CONFESSION", "CONTROVERSY", "PUBLIC_INTERACTION", "GAMEPLAY_CLUTCH", "FAIL", "CHALLENGE", "SECURITY_AUTHORITY", "STATUS", "CHAOS",
)
ACTION_CLASSES = ("IRL_ACTION", "IRL_REACTION", "CHAOS", "STATUS", "FLEX_FAIL", "MONEY_STATUS", "PUBLIC_INTERACTION", "SECURITY_AUTHORITY", "FAIL", "CHALLENGE")
# Kinds of payoff, and those that are seen.
PAYOFF_TYPES = ("verbal", "physical", "reaction", "reveal", "silence", "consequence", "none")
VISUAL_PAYOFFS = ("physical", "reaction", "reveal", "silence", "consequence")


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Between lo and hi; NaN sorts above all numbers and becomes hi; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x.cast("double"))))


def component_score(scores: Column, event_class: Column | None = None, tightness: Column | None = None, payoff_valid: Column | None = None, start: Column | None = None, end: Column | None = None, hook_at: Column | None = None, payoff_at: Column | None = None) -> Column:
    """STRUCT<moment, cut, final, dead_lead, dead_tail> from a map of 0..10 scores; missing ones count 0, subject falls back to novelty."""
    none = F.lit(None).cast("double")
    start, end, hook_at, payoff_at = (c if c is not None else none for c in (start, end, hook_at, payoff_at))
    valid = payoff_valid if payoff_valid is not None else F.lit(True)
    action = F.upper(event_class).isin(*ACTION_CLASSES) if event_class is not None else F.lit(False)
    action = F.coalesce(action, F.lit(False))
    subject = F.coalesce(F.element_at(scores, "subject"), F.element_at(scores, "novelty"), F.element_at(scores, "judgment"))
    value = lambda k: F.coalesce(subject if k == "subject" else F.element_at(scores, k), F.lit(0.0))
    moment = sum((value(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)) * 10
    t = F.coalesce(clamp(tightness, 0, 100), F.lit(70.0)) if tightness is not None else F.lit(70.0)
    lead = F.coalesce(F.greatest(F.lit(0.0), hook_at - start), F.lit(0.0))
    tail = F.coalesce(F.greatest(F.lit(0.0), end - payoff_at), F.lit(0.0))
    late = F.coalesce(hook_at > start + 8, F.lit(False))
    too_long = F.coalesce((end - start) > F.when(action, 70.0).otherwise(110.0), F.lit(False))
    cut = clamp(t - 2.0 * F.greatest(F.lit(0.0), lead - 3.0) - 1.2 * F.greatest(F.lit(0.0), tail - 3.0), 0, 100)
    cut = clamp(cut - F.when(late, 15.0).otherwise(0.0) - F.when(valid, 0.0).otherwise(25.0) - F.when(too_long, 10.0).otherwise(0.0), 0, 100)
    final = 0.65 * moment + 0.35 * cut
    final = F.when(~valid | (value("payoff") < 3), F.least(final, F.lit(49.0))).otherwise(final)
    final = F.when((t < F.when(action, 60.0).otherwise(55.0)) | too_long | late, F.least(final, F.lit(79.0))).otherwise(final)
    return F.struct(F.bround(moment, 1).alias("moment"), F.bround(cut, 1).alias("cut"), F.bround(clamp(final, 0, 100), 1).alias("final"), F.bround(lead, 1).alias("dead_lead"), F.bround(tail, 1).alias("dead_tail"))


def legacy_score(scores: Column, tightness: Column, payoff_valid: Column) -> Column:
    """The older blend: 70 % editorial, 30 % tightness where known, 79 at most below tightness 60, 49 at most without a payoff."""
    editorial = sum((F.element_at(scores, k) * w for k, w in WEIGHTS.items()), F.lit(0.0)) * 10
    t = clamp(tightness, 0, 100)
    blended = F.when(t.isNull(), editorial).otherwise(0.7 * editorial + 0.3 * t)
    blended = F.when(t < 60, F.least(blended, F.lit(79.0))).otherwise(blended)
    failed = (F.coalesce(F.element_at(scores, "payoff"), F.lit(0.0)) < 3) | ~payoff_valid
    return F.bround(F.when(failed, F.least(blended, F.lit(49.0))).otherwise(blended), 1)


def tier(score: Column) -> Column:
    return F.when(score >= 90, "S").when(score >= 75, "A").when(score >= 60, "B").when(score >= 40, "C").otherwise("D")


def scores_compatible(a: Column, b: Column, same_topic: Column, threshold: float = 60.0, floor: float = 45.0, delta: float = 15.0, both: float = 50.0) -> Column:
    """A score over the threshold never goes with one below the floor; else close scores, or the same topic and both decent."""
    apart = ((a >= threshold) & (b < floor)) | ((b >= threshold) & (a < floor))
    return ~apart & ((F.abs(a - b) <= delta) | (same_topic & (a >= both) & (b >= both)))


def valid_components(scores: Column) -> Column:
    """Whether every component is finite and within 0 to 10."""
    return F.forall(F.map_values(scores), lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 10))


def editor_fields(event_class: Column, tightness: Column, payoff_at: Column, payoff_type: Column) -> Column:
    """STRUCT of normalised editor fields from raw strings: unknown class QUOTE, tightness 70 if unreadable, unknown payoff type none."""
    kind, payoff = F.upper(F.trim(event_class)), F.lower(F.trim(payoff_type))
    return F.struct(
        F.when(kind.isin(*EVENT_CLASSES), kind).otherwise("QUOTE").alias("event_class"), F.coalesce(clamp(tightness.try_cast("double"), 0, 100), F.lit(70.0)).alias("tightness"),
        payoff_at.try_cast("double").alias("payoff_at_seconds"), F.when(payoff.isin(*PAYOFF_TYPES), payoff).otherwise("none").alias("payoff_type"),
    )


def reviewed_score(old: Column, proposed: Column, confidence: Column, payoff: Column, payoff_valid: Column) -> Column:
    """A confident review moves a score by at most 12; a failed payoff caps it at 49."""
    applied = F.when(confidence >= 0.65, F.greatest(old - 12, F.least(old + 12, proposed))).otherwise(old)
    return F.when((payoff < 3) | ~payoff_valid, F.least(applied, F.lit(49.0))).otherwise(applied)


def payoff_ok(payoff_at: Column, start: Column, end: Column, payoff_type: Column, payoff: Column, visual: Column | bool = False) -> Column:
    """A payoff lies two seconds inside the span, or was seen, or is scored below 3 anyway."""
    visual = visual if isinstance(visual, Column) else F.lit(visual)
    inside = F.coalesce((payoff_at >= start + 2) & (payoff_at <= end - 2), F.lit(False))
    return inside | (visual & F.coalesce(payoff_type.isin(*VISUAL_PAYOFFS), F.lit(False))) | (payoff < 3)


def suggested_trim(hook_at: Column, start: Column, end: Column) -> Column:
    return F.when(hook_at > start + 8, F.format_string("%.2f-%.2f", F.greatest(start, hook_at - 5), end)).otherwise("")
