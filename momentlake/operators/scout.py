"""Reading model responses: spans, candidates, scores. Bad rows are dropped or counted, never guessed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.scores import WEIGHTS, editor_fields
from ..functions.text import FALLBACK_SIGNALS, KEEP_SIGNALS, keep_local_window, local_score, quote_or_blank
from .intervals import points_in_intervals, words_text


def _placed(x: Column, y: Column, ws: Column, we: Column, limit: Column, settings: Settings) -> Column:
    """STRUCT<a, b>: two numbers as times of their window, null if either is."""
    seconds = lambda c: F.when(c > 100_000, c / 1000).otherwise(c)
    x, y, ws, we = seconds(x), seconds(y), ws.cast("double"), we.cast("double")
    a, b = F.least(x, y), F.greatest(x, y)
    relative = (b <= F.greatest(F.lit(0.1), we - ws) + 5) & (a < ws - 5)
    a, b = F.when(relative, a + ws).otherwise(a), F.when(relative, b + ws).otherwise(b)
    bound, known = _bound(we, limit), x.isNotNull() & y.isNotNull()
    a = F.greatest(ws - settings.span_pad, F.greatest(F.lit(0.0), a))
    b = F.least(F.least(we + settings.span_pad, F.least(bound, b)), bound)
    return F.struct(F.when(known, a).alias("a"), F.when(known, b).alias("b"))


def _bound(we: Column, limit: Column) -> Column:
    return F.when(limit.isNull() | (limit == 0), we.cast("double")).otherwise(limit.cast("double"))


def _decided(a: Column, b: Column, ws: Column, we: Column, limit: Column, settings: Settings) -> Column:
    least, most, ws, bound = settings.min_span, settings.max_span, ws.cast("double"), _bound(we, limit)
    inner, middle = F.least(we.cast("double"), bound), (a + b) / 2
    grown_end = F.least(inner, F.greatest(ws, middle - least / 2) + least)
    cut_start = F.greatest(ws, middle - most / 2)
    out = lambda p, q, action: F.struct(F.round(p, 3).alias("start"), F.round(q, 3).alias("end"), F.lit(action).alias("action"))
    none = F.lit(None).cast("double")
    return (
        F.when(a.isNull() | b.isNull(), out(none, none, "missing_timestamp")).when(b <= a, out(none, none, "end_le_start"))
        .when(b - a < least, out(F.greatest(F.lit(0.0), grown_end - least), grown_end, "expand_short"))
        .when(b - a > most, out(cut_start, F.least(inner, cut_start + most), "clamp_long")).otherwise(out(a, b, "keep"))
    )


def accept_span(start: Column, end: Column, window_start: Column, window_end: Column, limit: Column, settings: Settings = DEFAULTS) -> Column:
    """STRUCT<start, end, action>: a proposed span in seconds, clamped to its window; null times where it's refused.

    Values over 100,000 are milliseconds, reversed ends are swapped, spans relative to their window are shifted; short spans grow
    about their middle, long ones shrink about it.
    """
    placed = F.array(_placed(start.try_cast("double"), end.try_cast("double"), window_start, window_end, limit, settings))
    return F.element_at(F.transform(placed, lambda s: _decided(s["a"], s["b"], window_start, window_end, limit, settings)), 1)


RESPONSE = "struct<candidates:array<struct<start:string,end:string,preliminary_score:string,needs_more_context_before:string,needs_more_context_after:string,reason:string,payoff_at_seconds:string,payoff_at:string>>>"


def scout_candidates(windows: DataFrame, response: str = "response", limit: Column | None = None) -> DataFrame:
    """Candidates in each window's JSON response: source_id, window_id, candidate_no, start, end, preliminary_score, before, after, reason, payoff_at_seconds, action.

    A response that isn't JSON gives none; rows without a usable span are dropped; other fields fall back and are clamped.
    """
    bound = limit if limit is not None else F.col("end")
    rows = windows.select("source_id", "window_id", F.col("start").alias("_ws"), F.col("end").alias("_we"), bound.alias("_limit"), F.posexplode(F.from_json(response, RESPONSE)["candidates"]).alias("candidate_no", "c")).where("c is not null")

    def number(name: str, default: float, hi: float) -> Column:
        raw = F.col(f"c.{name}").try_cast("double")
        return F.coalesce(F.when(raw.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(0.0), raw))), F.lit(default))

    # Inlined in two steps, so that times are parsed once and placed once: filters and projections don't move through a generator.
    sides = F.col("_ws"), F.col("_we"), F.col("_limit")
    times = rows.select("*", F.inline(F.array(F.struct(F.col("c.start").try_cast("double").alias("_x"), F.col("c.end").try_cast("double").alias("_y")))))
    placed = times.select("*", F.inline(F.array(_placed(F.col("_x"), F.col("_y"), *sides, DEFAULTS)))).where("b > a")
    spans = placed.withColumn("span", _decided(F.col("a"), F.col("b"), *sides, DEFAULTS))
    payoff = F.coalesce(F.col("c.payoff_at_seconds"), F.col("c.payoff_at")).try_cast("double")
    return spans.select(
        "source_id", "window_id", "candidate_no", "span.start", "span.end", number("preliminary_score", 40.0, 100.0).alias("preliminary_score"), number("needs_more_context_before", 0.0, 45.0).alias("before"), number("needs_more_context_after", 0.0, 30.0).alias("after"),
        F.coalesce(F.nullif(F.col("c.reason"), F.lit("")), F.lit("provider candidate")).alias("reason"), F.when(payoff.between(F.col("span.start"), F.col("span.end")), payoff).alias("payoff_at_seconds"), "span.action",
    )


def strict_scores(batches: DataFrame, response: str = "response", expected: str = "n") -> DataFrame:
    """(batch_id, index, score) of batches whose response is exactly `n` rows with unique integer indices below n and scores from 0 to 100; other batches give nothing. A batch is a row of batches."""
    index, n = lambda x: x["index"].try_cast("int"), F.col(expected)
    good = lambda x: F.coalesce(x["index"].rlike("^[0-9]+$") & (index(x) < n) & x["score"].rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$") & x["score"].try_cast("double").between(0, 100), F.lit(False))
    whole = lambda rows: F.when((F.size(rows) == n) & F.forall(rows, good) & (F.size(F.array_distinct(F.transform(rows, index))) == n), rows)
    # A batch is judged where its response lies; inside a transform, so that it is parsed once.
    judged = F.get(F.transform(F.array(F.from_json(response, "array<struct<index:string,score:string>>")), whole), F.lit(0))
    return batches.select("batch_id", F.explode(judged).alias("r")).select("batch_id", F.col("r.index").cast("int").alias("index"), F.col("r.score").cast("double").alias("score"))


def unfenced(raw: Column) -> Column:
    """A response without its code fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^```(json)?", ""), r"```$", ""))


def tolerant_json(df: DataFrame, key: list[str], raw: str = "response") -> DataFrame:
    """df with `json`: the response's JSON text, fences stripped, or the first object in its prose; null where there is none.

    Only rows that fail natively go through Python.
    """
    plain = df.withColumn("json", unfenced(F.col(raw)))
    good = F.try_parse_json("json").isNotNull() & (F.col("json") != "")
    types = dict(df.dtypes)

    def first_object(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        for pdf in parts:
            out = []
            for text in pdf["json"]:
                found, at = None, text.find("{")
                while at >= 0 and found is None:
                    try:
                        found = text[at : decoder.raw_decode(text, at)[1]]
                    except ValueError:
                        at = text.find("{", at + 1)
                out.append(found)
            pdf["json"] = out
            yield pdf

    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in plain.columns)
    return plain.where(good).unionByName(plain.where(~good).mapInPandas(first_object, schema))


SCORED = "array<struct<index:string,hook:string,payoff:string,emotion:string,standalone:string,subject:string,technical:string,novelty:string,reason:string,topic:string,quote:string,safety_flag:string,judgment_target:string,event_class:string,tightness:string,payoff_at_seconds:string,payoff_type:string,predicted_reactions:array<string>>>"


def score_results(windows: DataFrame, responses: DataFrame) -> DataFrame:
    """windows (batch_id, index, text) with breakdown, reason, topic, quote, safety_flag and editor fields of their batch's response row.

    A window whose row is missing or lacks a weight key has a null breakdown; blank texts get zeros and the reason "skipped"; a quote
    that isn't in the text is blanked.
    """
    rows = responses.select("batch_id", F.posexplode(F.from_json(unfenced(F.col("response")), SCORED)).alias("_place", "r")).select("batch_id", "_place", "r.*")
    rows = rows.withColumn("subject", F.coalesce("subject", "novelty")).withColumn("index", F.col("index").try_cast("int"))
    numbers = {k: F.col(k).try_cast("double") for k in WEIGHTS}
    good = F.lit(True)
    for v in numbers.values():
        good = good & F.coalesce(v.between(0, 10), F.lit(False))
    fields = editor_fields(F.coalesce("event_class", F.lit("")), F.col("tightness"), F.col("payoff_at_seconds"), F.coalesce("payoff_type", F.lit("")))
    # Rows travel and are sorted as plain values, and once: the order in which the first of equal indices is taken is that of the join.
    valid = rows.where(good).select("batch_id", "index", "_place", *[v.alias(f"_{k}") for k, v in numbers.items()], F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("quote", F.lit("")).alias("quote"), "safety_flag", "judgment_target", "predicted_reactions", fields.alias("fields"))
    again = F.lag(F.lit(True)).over(Window.partitionBy("batch_id", "index").orderBy("_place"))
    valid = valid.withColumn("_again", again).where("_again is null").drop("_again", "_place")
    joined = windows.join(valid.hint("shuffle_merge"), ["batch_id", "index"], "left")
    breakdown = F.when(F.col("reason").isNotNull(), F.create_map(*[x for k in WEIGHTS for x in (F.lit(k), F.col(f"_{k}"))]))
    blank = F.trim("text") == ""
    zeros = F.create_map(*[F.lit(x) for k in WEIGHTS for x in (k, 0.0)])
    return joined.select(*windows.columns, F.when(blank, zeros).otherwise(breakdown).alias("breakdown"), F.when(blank, "skipped").otherwise(F.col("reason")).alias("reason"), "topic", quote_or_blank(F.col("quote"), F.col("text")).alias("quote"), "safety_flag", "judgment_target", "predicted_reactions", "fields.*")


def expand_context(candidates: DataFrame, words: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Candidates over the scout threshold, widened by the context they ask for; exact repeats of a span and empty ones go; text from the words."""
    ends = words.groupBy("source_id").agg(F.min("start").alias("_first"), F.max_by("end", F.struct("start", "word_idx")).alias("_last"))
    picked = candidates.where(F.col("preliminary_score") >= settings.scout_threshold).join(ends.hint("shuffle_merge"), "source_id")
    a, b = F.greatest(F.lit(0.0), F.greatest(F.col("_first"), F.col("start") - F.col("before"))), F.least(F.col("_last"), F.col("end") + F.col("after"))
    spans = picked.withColumns({"_a": a, "_b": b}).withColumn("span", accept_span(F.col("_a"), F.col("_b"), F.col("_a"), F.col("_b"), F.col("_last"), settings)).where("span.start is not null")
    order = Window.partitionBy("source_id", "span.start", "span.end").orderBy("window_id", "candidate_no")
    first = spans.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    out = words_text(first.select("source_id", "window_id", "candidate_no", "preliminary_score", "reason", "span.start", "span.end"), words, ["window_id", "candidate_no"], trim=True)
    return out.where("text != ''")


def local_candidates(windows: DataFrame, words: DataFrame, signals: tuple[str, ...] = FALLBACK_SIGNALS, min_words: int = 8, keep: tuple[str, ...] = KEEP_SIGNALS) -> DataFrame:
    """The local scorer: one candidate per warm window about its first single word that holds a signal (12 s before, 45 s after), else its last 45 s; under 6 s goes."""
    warm = windows.where(keep_local_window(F.col("text"), min_words, keep))
    spoken = words.select("source_id", F.col("start").alias("_at"), F.lower("text").alias("_w"))
    has = F.exists(F.array(*[F.lit(s) for s in signals]), lambda s: F.contains(F.col("_w"), s))
    anchors = points_in_intervals(warm.select("source_id", "window_id", "start", "end"), spoken.where(has), at="_at").groupBy("source_id", "window_id").agg(F.min("_at").alias("anchor"))
    found = warm.join(anchors.hint("shuffle_merge"), ["source_id", "window_id"], "left")
    a = F.when(F.col("anchor").isNotNull(), F.greatest(F.col("start"), F.col("anchor") - 12)).otherwise(F.greatest(F.col("start"), F.col("end") - 45))
    b = F.when(F.col("anchor").isNotNull(), F.least(F.col("end"), F.col("anchor") + 45)).otherwise(F.col("end"))
    out = found.select("source_id", "window_id", a.alias("start"), b.alias("end"), local_score(F.col("text"), signals).alias("preliminary_score"))
    return out.where(F.col("end") - F.col("start") >= 6)
