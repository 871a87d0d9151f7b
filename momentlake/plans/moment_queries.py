"""Queries of the scoring, grouping, ranking and evaluation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import scores as S
from ..functions import text as T
from ..operators import evaluation, moments, ranking, review, scorers, scout
from ..scratch import once
from ..streaming import live
from .bindings import CANDIDATES, WORDS, candidates, table, words
from .registry import Registry

R = Registry()
query = R.query

_KEY = ("l_orderkey", "l_linenumber")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_partkey")


# --- spans ---------------------------------------------------------------------------------------------------

_SPAN_IN = "i AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN (1000 + l_quantity) * 1000 WHEN l_linenumber = 5 THEN l_quantity ELSE 900 + l_quantity * 5 END AS a, CASE WHEN l_linenumber = 6 THEN (1010 + l_quantity) * 1000 WHEN l_linenumber = 5 THEN l_quantity + 20 WHEN l_linenumber = 4 THEN 900 ELSE 900 + l_quantity * 5 + l_discount * 1000 + l_linenumber END AS b FROM lineitem)"
_SPANS = f"""{_SPAN_IN}, n AS (SELECT *, CASE WHEN a > 100000 THEN a / 1000 ELSE a END AS x, CASE WHEN b > 100000 THEN b / 1000 ELSE b END AS y FROM i),
o AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(x, y) END AS p, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) END AS q FROM n),
r AS (SELECT *, CASE WHEN q <= 205 AND p < 995 THEN p + 1000 ELSE p END AS p2, CASE WHEN q <= 205 AND p < 995 THEN q + 1000 ELSE q END AS q2 FROM o),
c AS (SELECT l_orderkey, l_linenumber, p, greatest(998, greatest(0, p2)) AS a, least(least(1202, least(1150, q2)), 1150) AS b FROM r),
m AS (SELECT *, (a + b) / 2 AS mid FROM c)"""
#: (order, line) isn't unique in lineitem: the place of a row among its order's, and rows alike in line and quantity give the same answer.
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS place FROM lineitem)"


@query(f"""WITH {_SPANS} SELECT l_orderkey, l_linenumber, CASE WHEN p IS NULL THEN 'missing_timestamp' WHEN b <= a THEN 'end_le_start' WHEN b - a < 8 THEN 'expand_short' WHEN b - a > 90 THEN 'clamp_long' ELSE 'keep' END AS action,
round(CASE WHEN p IS NULL OR b <= a THEN NULL WHEN b - a < 8 THEN greatest(0, least(1150, greatest(1000, mid - 4) + 8) - 8) WHEN b - a > 90 THEN greatest(1000, mid - 45) ELSE a END, 2) AS start_at,
round(CASE WHEN p IS NULL OR b <= a THEN NULL WHEN b - a < 8 THEN least(1150, greatest(1000, mid - 4) + 8) WHEN b - a > 90 THEN least(1150, greatest(1000, mid - 45) + 90) ELSE b END, 2) AS end_at FROM m""")
def p7_accept_span(spark: SparkSession, sf: str) -> DataFrame:
    span = scout.accept_span(F.col("a"), F.col("b"), F.lit(1000.0), F.lit(1200.0), F.lit(1150.0))
    return _span_inputs(lines(spark, sf)).withColumn("s", span).select(*_KEY, "s.action", F.round("s.start", 2).alias("start_at"), F.round("s.end", 2).alias("end_at"))


def ranked_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity")))


def _span_inputs(df: DataFrame) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    a = F.when(n == 7, F.lit(None).cast("double")).when(n == 6, (1000 + q) * 1000).when(n == 5, q).otherwise(900 + q * 5)
    b = F.when(n == 6, (1010 + q) * 1000).when(n == 5, q + 20).when(n == 4, F.lit(900.0)).otherwise(900 + q * 5 + F.col("l_discount") * 1000 + n)
    return df.withColumns({"a": a, "b": b})


def scout_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One window per order, with a JSON response of a candidate per line."""
    rows = _span_inputs(lines(spark, sf)).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("a").alias("start"), F.col("b").alias("end"), (F.col("l_quantity") * 3).alias("preliminary_score"), (F.col("l_discount") * 1000).alias("needs_more_context_before"), F.col("l_linenumber").alias("needs_more_context_after")))).alias("candidates"))
    return rows.select(F.col("l_orderkey").alias("source_id"), F.lit(0).alias("window_id"), F.lit(1000.0).alias("start"), F.lit(1200.0).alias("end"), F.to_json(F.struct("candidates")).alias("response"))


_ACCEPTED = f"WITH {_SPANS.replace('SELECT l_orderkey, l_linenumber,', 'SELECT l_orderkey, l_linenumber, l_quantity, l_discount,')}, ok AS (SELECT * FROM m WHERE p IS NOT NULL AND m.b > m.a)"


@query(f"{_ACCEPTED} SELECT l_orderkey AS source_id, count(*) AS n, CAST(sum(least(100, l_quantity * 3)) AS DOUBLE) AS total_score, round(sum(least(45, l_discount * 1000)), 4) AS total_before FROM ok GROUP BY 1")
def p8_scout_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = scout.scout_candidates(scout_responses(spark, sf), limit=F.lit(1150.0))
    return found.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("preliminary_score").alias("total_score"), F.round(F.sum("before"), 4).alias("total_before"))


@query(f"{_ACCEPTED} SELECT l_orderkey AS source_id, count(*) AS n FROM ok WHERE least(100, l_quantity * 3) >= 36 GROUP BY 1")
def p13_scout_threshold(spark: SparkSession, sf: str) -> DataFrame:
    found = scout.scout_candidates(scout_responses(spark, sf), limit=F.lit(1150.0))
    return found.where(F.col("preliminary_score") >= 36).groupBy("source_id").agg(F.count("*").alias("n"))


@query(f"""WITH {WORDS}, ends AS (SELECT source_id, min(s) AS f, max(e) AS l FROM words GROUP BY 1), c AS (SELECT w.source_id, w.word_idx AS window_id, greatest(0, f, s - 5) AS a, least(l, s + 13) AS b, l FROM words w JOIN ends USING (source_id) WHERE confidence * 100 >= 36),
x AS (SELECT source_id, window_id, CASE WHEN b - a < 8 THEN least(b, greatest(a, (a + b) / 2 - 4) + 8) ELSE b END AS e, CASE WHEN b - a < 8 THEN greatest(0, least(b, greatest(a, (a + b) / 2 - 4) + 8) - 8) ELSE a END AS s FROM c WHERE b > a QUALIFY row_number() OVER (PARTITION BY source_id, s, e ORDER BY window_id) = 1)
SELECT x.source_id, x.window_id, round(x.s, 3) AS start_at, round(x.e, 3) AS end_at, string_agg(trim(w.text), ' ' ORDER BY w.s, w.word_idx) AS text FROM x JOIN words w ON w.source_id = x.source_id AND w.s >= x.s AND w.s < x.e GROUP BY 1, 2, 3, 4""")
def p14_expand_context(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf)
    c = w.select("source_id", F.col("word_idx").alias("window_id"), F.lit(0).alias("candidate_no"), "start", (F.col("start") + 9).alias("end"), (F.col("confidence") * 100).alias("preliminary_score"), F.lit("r").alias("reason"), F.lit(5.0).alias("before"), F.lit(4.0).alias("after"))
    return scout.expand_context(c, w).select("source_id", "window_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "text")


@query(f"WITH {_RANKED} SELECT l_orderkey AS batch_id, place - 1 AS \"index\", CAST(l_quantity AS DOUBLE) AS score FROM ranked WHERE l_orderkey % 3 <> 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM ranked WHERE l_quantity > 49)")
def p9_strict_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Batches whose key is a multiple of 3 expect a row more than they have; scores over 49 are out of range."""
    bad = F.when(F.col("l_quantity") > 49, F.lit(101.0)).otherwise(F.col("l_quantity"))
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", bad.alias("score"))))
    rows = lines(spark, sf).groupBy("l_orderkey").agg(F.to_json(F.transform(ordered, lambda x, i: F.struct(i.alias("index"), x["score"].alias("score")))).alias("response"), F.count("*").alias("have"))
    batches = rows.select(F.col("l_orderkey").alias("batch_id"), "response", (F.col("have") + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)).alias("n"))
    return scout.strict_scores(batches).withColumn("index", F.col("index").cast("long"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS found FROM orders")
def p10_tolerant_json(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    obj = F.concat(F.lit('{"k": "'), k, F.lit('"}'))
    raw = F.when(k % 4 == 0, obj).when(k % 4 == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(k % 4 == 2, F.concat(F.lit("Sure {not json} here: "), obj, F.lit(" done"))).otherwise("nothing")
    parsed = scout.tolerant_json(table(spark, sf, "orders").select("o_orderkey", raw.alias("response")), ["o_orderkey"])
    return parsed.select("o_orderkey", F.get_json_object("json", "$.k").alias("found"))


# --- scores --------------------------------------------------------------------------------------------------

#: Six components from a line; the odd offset keeps scores away from ties in rounding.
_PARTS = {"hook": "(l_partkey % 41 + 0.01) / CAST(4.1037 AS DOUBLE)", "payoff": "(l_suppkey % 21) / 2.0", "emotion": "l_linenumber * 1.0", "standalone": "(l_orderkey % 11) * 1.0", "subject": "(l_partkey % 21) / 2.0", "technical": "(l_suppkey % 11) * 1.0"}


def parts() -> Column:
    return F.create_map(*[x for k, v in _PARTS.items() for x in (F.lit(k), F.expr(v).cast("double"))])


_MOMENT = "10 * (" + " + ".join(f"{w} * ({_PARTS[k]})" for k, w in S.WEIGHTS.items()) + ")"
_FINAL = f"""f AS (SELECT *, {_MOMENT} AS moment, CAST(l_quantity * 1.9 + 0.0123 AS DOUBLE) AS t, l_linenumber % 2 = 0 AS action FROM lineitem),
g AS (SELECT *, greatest(0, least(100, t - 2.0 * greatest(0, l_linenumber * 2.0 - 3) - 1.2 * greatest(0, 100 - 60.0 - 3))) AS c0 FROM f),
h AS (SELECT *, greatest(0, least(100, c0 - CASE WHEN l_linenumber * 2.0 > 8 THEN 15 ELSE 0 END - CASE WHEN action THEN 10 ELSE 0 END)) AS cut FROM g),
k AS (SELECT *, 0.65 * moment + 0.35 * cut AS f0 FROM h), l AS (SELECT *, CASE WHEN {_PARTS['payoff']} < 3 THEN least(f0, 49) ELSE f0 END AS f1 FROM k),
scored AS (SELECT *, greatest(0, least(100, CASE WHEN t < CASE WHEN action THEN 60 ELSE 55 END OR action OR l_linenumber * 2.0 > 8 THEN least(f1, 79) ELSE f1 END)) AS final FROM l)"""


@query(f"WITH {_FINAL} SELECT l_orderkey, l_linenumber, round(moment, 1) AS moment, round(cut, 1) AS cut, round(final, 1) AS final FROM scored")
def f8_component_score(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.when(n % 2 == 0, "IRL_ACTION").otherwise("QUOTE")
    c = S.component_score(parts(), kind, F.col("l_quantity") * 1.9 + 0.0123, F.lit(True), F.lit(0.0), F.lit(100.0), n * 2.0, F.lit(60.0))
    return lines(spark, sf).withColumn("c", c).select(*_KEY, "c.moment", "c.cut", "c.final")


_LEGACY = f"CASE WHEN {_PARTS['payoff']} < 3 THEN least(b, 49) ELSE b END"


@query(f"WITH m AS (SELECT *, {_MOMENT} AS e, CAST(l_quantity * 1.9 + 0.0123 AS DOUBLE) AS t FROM lineitem), n AS (SELECT *, 0.7 * e + 0.3 * t AS b0 FROM m), o AS (SELECT *, CASE WHEN t < 60 THEN least(b0, 79) ELSE b0 END AS b FROM n) SELECT l_orderkey, l_linenumber, round({_LEGACY}, 1) AS score FROM o")
def f9_legacy_score(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select(*_KEY, S.legacy_score(parts(), F.col("l_quantity") * 1.9 + 0.0123, F.lit(True)).alias("score"))


@query(f"WITH {CANDIDATES} SELECT candidate_id, CASE WHEN score >= 90 THEN 'S' WHEN score >= 75 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS tier FROM cands")
def f10_tier(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("candidate_id", S.tier(F.col("score")).alias("tier"))


@query("SELECT l_orderkey, l_linenumber, NOT ((a >= 60 AND b < 45) OR (b >= 60 AND a < 45)) AND (abs(a - b) <= 15 OR (l_linenumber = 1 AND a >= 50 AND b >= 50)) AS ok FROM (SELECT *, l_quantity * 2 AS a, (l_partkey % 100) * 1.0 AS b FROM lineitem)")
def f11_scores_compatible(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select(*_KEY, S.scores_compatible(F.col("l_quantity") * 2, (F.col("l_partkey") % 100) * 1.0, F.col("l_linenumber") == 1).alias("ok"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN {_PARTS['payoff']} < 3 OR NOT (l_linenumber * 10.0 BETWEEN 2 AND 48) THEN least(49, applied) ELSE applied END AS score FROM (SELECT *, CASE WHEN l_discount >= 0.05 THEN greatest(l_quantity - 12, least(l_quantity + 12, (l_partkey % 100) * 1.0)) ELSE l_quantity END AS applied FROM lineitem)")
def f12_reviewed_score(spark: SparkSession, sf: str) -> DataFrame:
    payoff = F.expr(_PARTS["payoff"]).cast("double")
    ok = S.payoff_ok(F.col("l_linenumber") * 10.0, F.lit(0.0), F.lit(50.0), F.lit("verbal"), payoff)
    confidence = F.when(F.col("l_discount") >= 0.05, 0.9).otherwise(0.5)
    return lines(spark, sf).select(*_KEY, S.reviewed_score(F.col("l_quantity"), (F.col("l_partkey") % 100) * 1.0, confidence, payoff, ok).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_quantity <= 40 AND l_discount * 100 <= 10 AS ok FROM lineitem")
def p15_valid_components(spark: SparkSession, sf: str) -> DataFrame:
    values = F.create_map(F.lit("hook"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity") / 4).otherwise(F.when(F.col("l_linenumber") % 2 == 0, F.lit(float("nan"))).otherwise(11.0)), F.lit("payoff"), F.col("l_discount") * 100)
    return lines(spark, sf).select(*_KEY, S.valid_components(values).alias("ok"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'REVEAL' ELSE 'QUOTE' END AS event_class, CASE WHEN l_linenumber = 2 THEN 70.0 ELSE CAST(least(100, l_quantity * 3) AS DOUBLE) END AS tightness, CASE WHEN l_linenumber = 3 THEN 'reaction' ELSE 'none' END AS payoff_type FROM lineitem")
def p16_editor_fields(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    f = S.editor_fields(F.when(n == 1, "reveal").otherwise("odd"), F.when(n == 2, "n/a").otherwise((F.col("l_quantity") * 3).cast("string")), F.lit("x"), F.when(n == 3, "Reaction").otherwise("?"))
    return lines(spark, sf).withColumn("f", f).select(*_KEY, "f.event_class", "f.tightness", "f.payoff_type")


@query(f"WITH {_RANKED} SELECT l_orderkey AS batch_id, place AS \"index\", l_linenumber = 4 OR (l_linenumber % 5 <> 0 AND l_quantity <= 45) AS scored, CASE WHEN l_linenumber = 4 THEN 'skipped' WHEN l_linenumber % 5 <> 0 AND l_quantity <= 45 THEN 'why' END AS reason FROM ranked")
def p17_score_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth line misses a component, quantities over 45 are out of range, and the texts of fourth lines are blank."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    row = F.struct(F.col("place").alias("index"), F.when(q <= 45, q / 5).otherwise(10.5).alias("hook"), F.lit(3.0).alias("payoff"), F.lit(1.0).alias("emotion"), F.when(n % 5 != 0, 2.0).alias("standalone"), F.lit(4.0).alias("novelty"), F.lit(5.0).alias("technical"), F.lit("why").alias("reason"), F.lit("quote").alias("quote"))
    responses = ranked_lines(spark, sf).groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.concat(F.lit("```json\n"), F.to_json(F.collect_list(row)), F.lit("\n```")).alias("response"))
    windows = ranked_lines(spark, sf).select(F.col("l_orderkey").alias("batch_id"), F.col("place").alias("index"), F.when(n == 4, " ").otherwise("some text").alias("text"))
    done = scout.score_results(windows, responses)
    return done.select("batch_id", F.col("index").cast("long").alias("index"), F.col("breakdown").isNotNull().alias("scored"), "reason")


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), lower(q)) THEN q ELSE '' END AS quote FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN replace(upper(substr(text, 3, 10)), 'ẞ', 'SS') ELSE '~never said~' END AS q FROM conversations)")
def p18_quote_or_blank(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    # Inside a transform, as Catalyst takes lower(upper(x)) for lower(x), which differs for a sharp s.
    upper = F.get(F.transform(F.array(F.substring("text", 3, 10)), F.upper), F.lit(0))
    quote = F.when(F.col("turn") % 2 == 0, upper).otherwise("~never said~")
    return c.select("conv_id", "turn", T.quote_or_blank(quote, F.col("text")).alias("quote"))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """A review per line of an order: odd keys have evidence outside, discounts over 0.08 a bad confidence."""
    k = F.col("l_orderkey")
    rows = lines(spark, sf)
    time = F.when(k % 2 == 1, 999.0).otherwise(10.0)
    return rows.select(
        k.alias("source_id"), F.col("l_linenumber").alias("candidate_id"), F.lit("e").alias("literal_event"), F.lit("s").alias("social_interpretation"), F.lit("k").alias("skeptic"), F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise("u").alias("uncertainties"),
        F.when(F.col("l_discount") > 0.08, 1.5).otherwise(0.9).alias("confidence"), parts().alias("scores"), F.array(F.struct(time.alias("time"), F.lit("q").alias("quote"))).alias("evidence"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"),
    )


@query("SELECT l_orderkey AS source_id, CAST(l_orderkey % 5 = 0 AS INT) + CAST(l_discount > 0.08 AS INT) + CAST(l_orderkey % 2 = 1 AS INT) AS n_errors FROM lineitem")
def p19_review_errors(spark: SparkSession, sf: str) -> DataFrame:
    joined = reviews(spark, sf).withColumns({"c_start": F.lit(0.0), "c_end": F.lit(30.0)})
    return joined.select("source_id", F.size(review.review_errors()).alias("n_errors"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3 OR (l_suppkey % 21) / 2.0 >= 3")
def p20_payoff_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).withColumn("breakdown", F.when(F.col("l_linenumber") != 3, parts()))
    return ranking.paying_off(rows).select(*_KEY)


# --- grouping ------------------------------------------------------------------------------------------------

_SAME = "topic = p_topic"
_GROUPS = f"""RECURSIVE {CANDIDATES}, o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s, candidate_id) AS rn FROM cands WHERE score >= 32),
l AS (SELECT *, lag(e) OVER w AS p_e, lag(score) OVER w AS p_score, lag(topic) OVER w AS p_topic, lag(moment_type) OVER w AS p_kind FROM o WINDOW w AS (PARTITION BY source_id ORDER BY rn)),
a AS (SELECT *, moment_type = 'IRL_ACTION' OR coalesce(p_kind, '') = 'IRL_ACTION' AS act, {_SAME} AS same, s - p_e AS gap FROM l),
j AS (SELECT *, CASE WHEN act THEN 65 ELSE 120 END AS cap, coalesce(CASE WHEN score >= 65 OR p_score >= 65 THEN same AND score >= CASE WHEN act THEN 55 ELSE 50 END AND p_score >= CASE WHEN act THEN 55 ELSE 50 END AND gap <= CASE WHEN act THEN 8 ELSE 15 END
  ELSE (gap <= CASE WHEN act THEN 7 ELSE 12 END OR (gap <= CASE WHEN act THEN 7 ELSE 12 END * 1.8 AND same)) AND NOT ((score >= 60 AND p_score < 45) OR (p_score >= 60 AND score < 45)) AND (abs(score - p_score) <= 15 OR (same AND score >= 50 AND p_score >= 50)) END, FALSE) AS joins FROM a),
f AS (SELECT source_id, rn, s AS head, candidate_id AS group_id FROM j WHERE rn = 1 UNION ALL
  SELECT j.source_id, j.rn, CASE WHEN j.joins AND j.e - f.head <= j.cap THEN f.head ELSE j.s END, CASE WHEN j.joins AND j.e - f.head <= j.cap THEN f.group_id ELSE j.candidate_id END FROM f JOIN j ON j.source_id = f.source_id AND j.rn = f.rn + 1),
grouped AS (SELECT j.*, f.group_id FROM j JOIN f USING (source_id, rn))"""


def strong(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).where("score >= 32")


@query(f"WITH {_GROUPS} SELECT source_id, candidate_id, group_id FROM grouped")
def q3_group_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return moments.group_candidates(strong(spark, sf)).select("source_id", "candidate_id", "group_id")


#: As the query: scores are summed in order, and of equal peaks the first counts.
_FIRST_PEAK = "{'v': -score, 'rn': rn}"
_STATS = "stats AS (SELECT source_id, group_id, count(*) AS size, min(s) AS s, arg_max(e, rn) AS e, list_reduce(list(score ORDER BY rn), lambda a, x: a + x) / count(*) AS mean_score, max(score) AS peak_score FROM grouped GROUP BY 1, 2)"


@query(f"WITH {_GROUPS}, {_STATS} SELECT source_id, group_id, size, s AS start_at, e AS end_at, round(mean_score, 4) AS mean_score, round(peak_score, 4) AS peak_score FROM stats")
def a2_group_stats(spark: SparkSession, sf: str) -> DataFrame:
    g = moments.group_stats(moments.group_candidates(strong(spark, sf)))
    return g.select("source_id", "group_id", "size", F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.round("mean_score", 4).alias("mean_score"), F.round("peak_score", 4).alias("peak_score"))


_DECIDE = f"""{_GROUPS}, {_STATS}, pk AS (SELECT source_id, group_id, min_by(moment_type = 'IRL_ACTION', {_FIRST_PEAK}) AS act FROM grouped GROUP BY 1, 2), d AS (SELECT t.*, CASE WHEN group_id % 7 = 0 THEN NULL ELSE mean_score + 5 END AS m, size > 1 AND peak_score - mean_score >= CASE WHEN pk.act THEN 12 ELSE 20 END AS diluted FROM stats t JOIN pk USING (source_id, group_id)),
decided AS (SELECT *, CASE WHEN m IS NULL THEN CASE WHEN peak_score >= 60 THEN 'peak' ELSE 'drop' END WHEN m < 60 AND peak_score < 55 THEN 'drop' WHEN diluted THEN 'peak' WHEN m >= 60 THEN 'merged' ELSE 'peak' END AS decision FROM d)"""


def decided(spark: SparkSession, sf: str) -> DataFrame:
    """The re-score stands in as the mean plus 5, missing for every seventh group."""
    stats = once(moments.group_stats(moments.group_candidates(strong(spark, sf))))
    return moments.decide_merges(stats, stats.where(F.col("group_id") % 7 != 0).select("source_id", "group_id", (F.col("mean_score") + 5).alias("score")))


@query(f"WITH {_DECIDE} SELECT source_id, group_id, decision FROM decided")
def q4_decide_merges(spark: SparkSession, sf: str) -> DataFrame:
    return decided(spark, sf).select("source_id", "group_id", "decision")


def _text_length(texts: list[str]) -> list[float]:
    """A stand-in for a model: the text's length."""
    return [float(len(t) % 101) for t in texts]


@query(f"WITH {_GROUPS} SELECT source_id, group_id, CAST(len(string_agg(topic, ' ' ORDER BY rn)) % 101 AS DOUBLE) AS score FROM grouped GROUP BY 1, 2")
def x2_rescored_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups scored anew by a callable, on their members' texts."""
    groups = moments.group_stats(moments.group_candidates(strong(spark, sf).withColumn("text", F.col("topic"))))
    return moments.rescore_groups(groups, _text_length).select("source_id", "group_id", "score")


@query(f"WITH {CANDIDATES}, o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s, candidate_id) - 1 AS i, count(*) OVER (PARTITION BY source_id) AS n FROM cands WHERE score >= 60) SELECT source_id, candidate_id FROM o WHERE n <= 3 OR i % 2 = 0")
def x3_ranked_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    """Every other row of a source's strong candidates, picked by a callable that also answers with nonsense."""
    picked = ranking.rank_shortlist(candidates(spark, sf).where("score >= 60"), lambda rows: [*range(0, len(rows), 2), 10**6, -1, "x"], ["score", "topic"])
    return picked.select("source_id", "candidate_id")


#: Greedy suppression over `pool` (source_id, candidate_id, s, e, score), one row of a source per step; `kept` holds the spans so far.
_KEPT = """ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, s, candidate_id) AS rn FROM pool),
walk AS (SELECT source_id, rn, candidate_id, TRUE AS keep, [{'a': s, 'b': e}] AS kept FROM ranked WHERE rn = 1 UNION ALL
  SELECT x.source_id, x.rn, x.candidate_id, x.ok, CASE WHEN x.ok THEN list_append(x.kept, {'a': x.s, 'b': x.e}) ELSE x.kept END FROM (SELECT r.*, walk.kept, len(list_filter(walk.kept, lambda k: abs((k.a + k.b) / 2 - (r.s + r.e) / 2) <= 18 OR (least(r.e - r.s, k.b - k.a) > 0 AND greatest(0, least(r.e, k.b) - greatest(r.s, k.a)) / least(r.e - r.s, k.b - k.a) >= 0.45))) = 0 AS ok FROM walk JOIN ranked r ON r.source_id = walk.source_id AND r.rn = walk.rn + 1) x)"""


@query(f"WITH RECURSIVE {CANDIDATES}, pool AS (SELECT * FROM cands WHERE score >= 32), {_KEPT} SELECT source_id, candidate_id FROM walk WHERE keep")
def q5_suppress_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return moments.suppress_repeats(strong(spark, sf)).select("source_id", "candidate_id")


@query(f"WITH RECURSIVE {CANDIDATES}, o AS (SELECT source_id, s, row_number() OVER (PARTITION BY source_id ORDER BY s, topic, candidate_id) AS rn FROM cands), f AS (SELECT source_id, rn, s, s AS head FROM o WHERE rn = 1 UNION ALL SELECT o.source_id, o.rn, o.s, CASE WHEN o.s - f.head <= 20 THEN f.head ELSE o.s END FROM f JOIN o ON o.source_id = f.source_id AND o.rn = f.rn + 1) SELECT source_id, median(s) AS center, greatest(0, median(s) - 8) AS start_at, median(s) + 8 AS end_at, count(*) AS n FROM f GROUP BY source_id, head HAVING count(*) >= 4")
def a10_cluster_offsets(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf).select("source_id", F.col("start").alias("t"), F.col("topic").alias("src"))
    return moments.cluster_offsets(c).select("source_id", "center", F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.col("count").alias("n"))


@query(f"WITH {CANDIDATES} SELECT candidate_id, score FROM cands WHERE score >= 32")
def p12_candidate_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return live.strong_windows(candidates(spark, sf), DEFAULTS.candidate_threshold).select("candidate_id", "score")


_POOL = f"""pool AS (SELECT d.source_id, d.group_id AS candidate_id, CASE WHEN decision = 'merged' THEN d.s ELSE p.s END AS s, CASE WHEN decision = 'merged' THEN d.e ELSE p.e END AS e, CASE WHEN decision = 'merged' THEN m ELSE peak_score END AS score FROM decided d
  JOIN (SELECT source_id, group_id, min_by(s, {_FIRST_PEAK}) AS s, min_by(e, {_FIRST_PEAK}) AS e FROM grouped GROUP BY 1, 2) p USING (source_id, group_id) WHERE decision <> 'drop')"""


@query(f"WITH {_DECIDE}, {_POOL}, {_KEPT} SELECT source_id, candidate_id, rank FROM (SELECT walk.source_id, walk.candidate_id, row_number() OVER (PARTITION BY walk.source_id ORDER BY pool.score DESC, pool.s, pool.candidate_id) AS rank FROM walk JOIN pool USING (source_id, candidate_id) WHERE keep) WHERE rank <= 10")
def top_moments(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: candidates, grouped, decided, without repeats, the ten best of each source."""
    d = decided(spark, sf).where("decision != 'drop'").select("source_id", F.col("group_id").alias("candidate_id"), F.col("out_start").alias("start"), F.col("out_end").alias("end"), F.col("out_score").alias("score"))
    return ranking.top_n(moments.suppress_repeats(d), 10).select("source_id", "candidate_id", F.col("rank").cast("long").alias("rank"))


# --- ranking and evaluation ----------------------------------------------------------------------------------


@query(f"WITH {CANDIDATES} SELECT source_id, candidate_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, s, candidate_id) AS rank FROM cands) WHERE rank <= 10")
def t1_top_for_review(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_n(candidates(spark, sf), 10).select("source_id", "candidate_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CANDIDATES}, c AS (SELECT source_id, greatest(count(*) FILTER (WHERE score >= 65), CAST(floor(8 * greatest(1.0, (source_id % 5) * 0.75)) AS BIGINT)) AS cap FROM cands GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score >= 65 DESC, score DESC, s, candidate_id) AS n FROM cands) SELECT r.source_id, r.candidate_id FROM r JOIN c USING (source_id) WHERE n <= cap")
def t2_cap_exports(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    sources = c.select("source_id").distinct().withColumn("duration", (F.col("source_id") % 5) * 2700.0)
    return ranking.cap_exports(c, sources).select("source_id", "candidate_id")


@query(f"WITH {CANDIDATES} SELECT source_id, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, s, candidate_id) AS rank FROM cands) WHERE rank <= 3")
def t3_max_clips(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_n(candidates(spark, sf), 3).select("source_id", "candidate_id")


_EVERY = "range(0, o_orderkey % 6)"


@query(f"SELECT o_orderkey AS source_id, CAST(i AS BIGINT) AS \"index\" FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 6 <= 3 THEN {_EVERY} ELSE CASE o_orderkey % 9 WHEN 0 THEN {_EVERY} WHEN 1 THEN [] WHEN 2 THEN [2] WHEN 3 THEN [0, 3] WHEN 4 THEN [] WHEN 5 THEN {_EVERY} WHEN 6 THEN {_EVERY} WHEN 7 THEN [] ELSE [1, 3] END END) AS i FROM orders)")
def t4_picked_indices(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that are no JSON, empty, with digits in quotes, fenced, objects, numbers, null, out of range, and mixed."""
    answers = ["no list", "[]", '["1", 2]', "```json\n[3, 0]\n```", '{"1": 2}', "7", "null", "[99, -1]", '[3, 1, 99, -2, "x", 3, 1.5, [0]]']
    k = F.col("o_orderkey")
    r = table(spark, sf, "orders").select(k.alias("source_id"), (k % 6).cast("int").alias("n"), F.get(F.array(*map(F.lit, answers)), (k % 9).cast("int")).alias("response"))
    return ranking.picked_indices(r).withColumn("index", F.col("index").cast("long"))


@query("SELECT l_orderkey AS job_id, l_extendedprice AS total_seconds FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice, l_discount, l_tax, l_quantity) AS n FROM lineitem WHERE l_discount <= 0.03 AND l_tax >= 0.05 AND l_quantity <= 5) WHERE n = 1")
def t5_best_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select(F.col("l_discount").alias("wer"), F.col("l_tax").alias("candidate_recall"), F.col("l_quantity").alias("boundary_errors"), F.col("l_extendedprice").alias("total_seconds"), F.col("l_orderkey").alias("job_id"))
    return ranking.best_profile(p, 0.03, 0.05, 5).select("job_id", "total_seconds")


@query("SELECT conv_id AS source_id, turn AS window_id, 3 * CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'on') AS INT) + CAST(contains(lower(text), 'er') AS INT) AS priority, row_number() OVER (PARTITION BY conv_id ORDER BY 3 * CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'on') AS INT) + CAST(contains(lower(text), 'er') AS INT) DESC, turn) AS rank FROM conversations")
def t6_scan_order(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("window_id"), "text")
    return ranking.scan_order(w, ["The"], keywords=("on", "er")).select("source_id", "window_id", "priority", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_custkey, o_orderstatus, max(o_orderkey) AS job_id FROM orders GROUP BY 1, 2")
def t8_latest_prior(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("job_id"))
    return ranking.latest_prior(jobs, ["o_custkey", "o_orderstatus"])


@query(f"WITH {CANDIDATES} SELECT source_id, candidate_id FROM cands WHERE score >= 65 OR candidate_id % 3 = 0")
def j14_keep_chosen(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    return ranking.keep_chosen(c, c.where("candidate_id % 3 = 0")).select("source_id", "candidate_id")


_U2 = f"WITH {CANDIDATES} SELECT source_id, candidate_id FROM cands WHERE candidate_id % 3 = 0 UNION SELECT source_id, candidate_id FROM cands WHERE score >= 65"


@query(_U2)
def u2_chosen_or_locked(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    return c.where(ranking.locked_or(F.col("candidate_id") % 3 == 0, F.col("score"))).select("source_id", "candidate_id")


_IOU = "(least(p.e, g.e) - greatest(p.s, g.s)) / (greatest(p.e, g.e) - least(p.s, g.s))"


@query(f"""WITH {CANDIDATES}, g AS (SELECT * FROM cands WHERE topic = 'purchase'), p AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, candidate_id) AS rank FROM cands WHERE topic = 'click'),
m AS (SELECT p.source_id, p.candidate_id AS pid, p.rank, g.candidate_id AS gid, {_IOU} AS iou, abs(p.s - g.s) AS se, abs(p.e - g.e) AS ee FROM p JOIN g USING (source_id) WHERE p.s <= g.e AND g.s <= p.e AND {_IOU} >= 0.2),
bp AS (SELECT source_id, pid, any_value(rank) AS rank, arg_max(se, [iou, -gid]) AS se, arg_max(ee, [iou, -gid]) AS ee FROM m GROUP BY 1, 2),
pp AS (SELECT source_id, count(*) AS predicted, count(*) FILTER (WHERE rank <= 10) AS shown FROM p GROUP BY 1), gg AS (SELECT source_id, count(*) AS gold FROM g GROUP BY 1), r10 AS (SELECT source_id, count(DISTINCT gid) AS n FROM m WHERE rank <= 10 GROUP BY 1), bb AS (SELECT source_id, count(*) AS matched, count(*) FILTER (WHERE rank <= 10) AS useful, avg(se) AS se, avg(ee) AS ee FROM bp GROUP BY 1)
SELECT source_id, coalesce(gold, 0) AS gold_moments, coalesce(predicted, 0) AS predicted_moments, coalesce(matched, 0) AS matched_predictions, round(CASE WHEN coalesce(gold, 0) > 0 THEN coalesce(r10.n, 0) / gold ELSE 0.0 END, 6) AS recall_at_10, round(CASE WHEN coalesce(shown, 0) > 0 THEN coalesce(useful, 0) / shown ELSE 0.0 END, 6) AS precision_at_10, round(se, 6) AS start_error, round(ee, 6) AS end_error
FROM gg FULL JOIN pp USING (source_id) LEFT JOIN r10 USING (source_id) LEFT JOIN bb USING (source_id)""")
def a1_evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf).withColumnRenamed("candidate_id", "item_id")
    r = evaluation.evaluation_report(c.where("topic = 'purchase'").select("source_id", "item_id", "start", "end"), c.where("topic = 'click'").select("source_id", "item_id", "start", "end", "score"))
    return r.select("source_id", "gold_moments", "predicted_moments", "matched_predictions", F.round("recall_at_10", 6).alias("recall_at_10"), F.round("precision_at_10", 6).alias("precision_at_10"), F.round("start_error", 6).alias("start_error"), F.round("end_error", 6).alias("end_error"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber = 2 AS INT) + CAST(l_discount < 0.02 AS INT) AS n_errors FROM lineitem")
def p21_gold_errors(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    g = lines(spark, sf).select(*_KEY, q.alias("gold_start"), (q + F.when(F.col("l_discount") < 0.02, 0.0).otherwise(5.0)).alias("gold_end"), F.lit("e").alias("event_type"), F.when(F.col("l_linenumber") != 2, "w").alias("why_it_is_good"), F.lit("c").alias("required_context"), q.alias("payoff_timestamp"))
    return evaluation.gold_errors(g).select(*_KEY, F.size("errors").alias("n_errors"))


# --- pluggable scorers ---------------------------------------------------------------------------------------


def _by_length(texts: list[str]) -> list[float | None]:
    """A deterministic scorer that fails on batches with a text of 13 words."""
    counts = [len(t.split()) for t in texts]
    if 13 in counts:
        raise ValueError("unlucky")
    return [float(min(100, c)) for c in counts]


_COUNT = "len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))"


@query(f"SELECT conv_id AS source_id, turn, CASE WHEN {_COUNT} = 13 THEN NULL ELSE CAST(least(100, {_COUNT}) AS DOUBLE) END AS score, CASE WHEN {_COUNT} = 13 THEN 'ValueError' END AS error FROM conversations")
def x1_batch_scorer(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "source_id")
    return scorers.apply_scorer(c, _by_length, ["source_id", "turn"])


@query(f"SELECT source_id, count(*) AS windows, count(*) FILTER (WHERE n = 13) AS failed, round(count(*) FILTER (WHERE n = 13) / count(*), 6) AS failed_share FROM (SELECT conv_id AS source_id, {_COUNT} AS n FROM conversations) GROUP BY 1")
def a13_incomplete_scan(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumnRenamed("conv_id", "source_id")
    done = scorers.incomplete(scorers.apply_scorer(c, _by_length, ["source_id", "turn"]))
    return done.select("source_id", "windows", "failed", F.round("failed_share", 6).alias("failed_share"))


_REVIEWED = f"""WITH {CANDIDATES}, r AS (SELECT *, candidate_id % 4 = 0 AS seen, candidate_id % 8 = 0 AS sure, (candidate_id + {list(S.WEIGHTS).index('payoff')}) % 10 + 1 AS payoff, 10 * ({' + '.join(f'{w} * ((candidate_id + {i}) % 10 + 1)' for i, w in enumerate(S.WEIGHTS.values()))}) AS m FROM cands),
f AS (SELECT *, round(least(79, CASE WHEN payoff < 3 THEN least(49, 0.65 * m + 0.35 * 48.4) ELSE 0.65 * m + 0.35 * 48.4 END), 1) AS final FROM r),
a AS (SELECT *, CASE WHEN sure THEN greatest(score - 12, least(score + 12, final)) ELSE score END AS applied FROM f)
SELECT source_id, candidate_id, CASE WHEN sure THEN s - 2 ELSE s END AS start_at, CASE WHEN sure THEN e + 2 ELSE e END AS end_at, round(CASE WHEN seen AND payoff < 3 THEN least(applied, 49) WHEN seen THEN applied ELSE score END, 4) AS score,
  CASE WHEN seen THEN CAST(round(m, 1) AS DOUBLE) END AS moment_score, CASE WHEN seen THEN CAST(48.4 AS DOUBLE) END AS cut_score, CASE WHEN seen THEN printf('%.2f-%.2f', s + 5, e + 2) ELSE '' END AS suggested_trim FROM a"""


@query(_REVIEWED)
def x4_apply_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """A review for the candidates whose id is a multiple of 4."""
    c = candidates(spark, sf).withColumns({"breakdown": F.create_map(F.lit("payoff"), F.lit(5.0)), "tightness": F.lit(80.0)})
    sc = F.create_map(*[x for i, k in enumerate(S.WEIGHTS) for x in (F.lit(k), ((F.col("candidate_id") + i) % 10 + 1).cast("double"))])
    r = c.where("candidate_id % 4 = 0").select("source_id", "candidate_id", F.when(F.col("candidate_id") % 8 == 0, 0.9).otherwise(0.5).alias("confidence"), sc.alias("scores"), (F.col("start") - 2).alias("start"), (F.col("end") + 2).alias("end"), F.lit(85.0).alias("tightness"), (F.col("start") + 10).alias("hook_at_seconds"), (F.col("start") + 12).alias("payoff_at_seconds"), F.lit("verbal").alias("payoff_type"))
    return review.apply_reviews(c, r).select("source_id", "candidate_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.round("score", 4).alias("score"), "moment_score", "cut_score", "suggested_trim")
