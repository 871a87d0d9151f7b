"""Queries of the transcript, interval and window operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals, review, scout, transcript, windows
from .bindings import CANDIDATES, CHUNKS, WORDS, candidates, chunks, table, words
from .registry import Registry

R = Registry()
query = R.query

#: Spans within turns, for the joins of words.
SPANS = "spans AS (SELECT DISTINCT conv_id AS source_id, turn AS clip_id, turn * 1024 + 2.0 AS s, turn * 1024 + 9.0 AS e FROM conversations)"


def spans(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("clip_id")).distinct()
    return t.select("source_id", "clip_id", (F.col("clip_id") * 1024 + 2.0).alias("start"), (F.col("clip_id") * 1024 + 9.0).alias("end"))


MARKS = "marks AS (SELECT source_id, e AS mark FROM (SELECT *, lead(s) OVER (PARTITION BY source_id ORDER BY s, word_idx) AS nxt FROM words) WHERE regexp_matches(rtrim(text), '[.?!]$') OR nxt - e >= 0.6)"


@query(f"WITH {WORDS}, {MARKS} SELECT source_id, mark FROM marks")
def w1_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return transcript.boundaries(words(spark, sf))


WINDOWS = f"""{WORDS}, {MARKS},
ends AS (SELECT source_id, min(s) AS t0, arg_max(e, s) AS last FROM words GROUP BY source_id),
grid AS (SELECT source_id, k AS window_id, t0 + k * 10.0 AS t, least(t0 + k * 10.0 + 20.0, last) AS u, last FROM (SELECT *, unnest(range(0, CAST(ceil((last - t0) / 10.0) AS BIGINT))) AS k FROM ends WHERE last > t0)),
ss AS (SELECT g.source_id, g.window_id, m.mark, row_number() OVER (PARTITION BY g.source_id, g.window_id ORDER BY abs(m.mark - g.t), m.mark) AS n FROM grid g JOIN marks m ON m.source_id = g.source_id AND m.mark BETWEEN g.t - 8 AND g.t + 8),
uu AS (SELECT g.source_id, g.window_id, m.mark, row_number() OVER (PARTITION BY g.source_id, g.window_id ORDER BY abs(m.mark - g.u), m.mark) AS n FROM grid g JOIN marks m ON m.source_id = g.source_id AND m.mark BETWEEN g.u - 8 AND g.u + 8),
snapped AS (SELECT g.source_id, g.window_id, CASE WHEN g.window_id = 0 THEN g.t ELSE coalesce(a.mark, g.t) END AS s, coalesce(b.mark, g.u) AS e FROM grid g LEFT JOIN (SELECT * FROM ss WHERE n = 1) a USING (source_id, window_id) LEFT JOIN (SELECT * FROM uu WHERE n = 1) b USING (source_id, window_id)),
wins AS (SELECT p.source_id, p.window_id, p.s, p.e, string_agg(trim(w.text), ' ' ORDER BY w.s, w.word_idx) AS text FROM snapped p JOIN words w ON w.source_id = p.source_id AND w.s >= p.s AND w.s < p.e WHERE p.e > p.s GROUP BY 1, 2, 3, 4)"""


def short_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.semantic_windows(words(spark, sf), target=20.0, hop=10.0)


@query(f"WITH {WINDOWS} SELECT source_id, window_id, s AS start_at, e AS end_at, text FROM wins")
def q1_semantic_windows(spark: SparkSession, sf: str) -> DataFrame:
    return short_windows(spark, sf).select("source_id", "window_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "text")


@query(f"WITH {WINDOWS} SELECT source_id, min(window_id) AS window_id, s AS start_at, e AS end_at, text FROM wins GROUP BY source_id, s, e, text")
def u3_distinct_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.distinct_windows(short_windows(spark, sf)).select("source_id", "window_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "text")


#: Frequent words of the synthetic corpus stand in for the lexicons, which it never hits.
KEEP, ACTION = ("thth", "ouon", "zue"), ("tionth", "eresh")
_LOW = "lower(text)"
_KEEP_SQL = " OR ".join(f"contains({_LOW}, '{k}')" for k in KEEP)
_ACTION_SQL = " OR ".join(f"contains({_LOW}, '{k}')" for k in ACTION)
_WARM = f"len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 8 AND ({_ACTION_SQL} OR {_KEEP_SQL} OR len({_LOW}) - len(replace({_LOW}, '?', '')) >= 2 OR len({_LOW}) - len(replace({_LOW}, '!', '')) >= 2)"


@query(f"WITH {WINDOWS} SELECT source_id, window_id FROM wins WHERE {_WARM}")
def p11_warm_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.warm_windows(short_windows(spark, sf), keep=KEEP, action=ACTION).select("source_id", "window_id")


@query(f"WITH {WORDS}, {SPANS} SELECT p.source_id, p.clip_id, coalesce(string_agg(w.text, ' ' ORDER BY w.s, w.word_idx), '') AS text FROM spans p LEFT JOIN words w ON w.source_id = p.source_id AND w.s >= p.s AND w.s < p.e GROUP BY 1, 2")
def j1_words_in_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.words_text(spans(spark, sf), words(spark, sf), ["clip_id"]).select("source_id", "clip_id", "text")


@query(f"WITH {WORDS}, {SPANS} SELECT p.source_id, p.clip_id, count(*) AS n FROM spans p JOIN words w ON w.source_id = p.source_id AND w.s BETWEEN p.s AND p.e GROUP BY 1, 2")
def j1_words_in_closed_intervals(spark: SparkSession, sf: str) -> DataFrame:
    points = words(spark, sf).select("source_id", F.col("start").alias("at"))
    return intervals.points_in_intervals(spans(spark, sf), points, closed=True).groupBy("source_id", "clip_id").agg(F.count("*").alias("n"))


def _agg(condition: str, value: str, separator: str) -> str:
    return f"coalesce(string_agg({value}, {separator} ORDER BY w.s, w.word_idx) FILTER (WHERE {condition}), '')"


@query(f"""WITH {WORDS}, {SPANS} SELECT p.source_id, p.clip_id, {_agg('w.s < p.s', 'w.text', "' '")} AS before_text, {_agg('w.s >= p.s AND w.s < p.e', "printf('%.2f', w.s) || ' [' || w.speaker || '] ' || w.text", "chr(10)")} AS lines, {_agg('w.s >= p.e', 'w.text', "' '")} AS after_text
FROM spans p LEFT JOIN words w ON w.source_id = p.source_id AND w.s >= greatest(0, p.s - 45) AND w.s < p.e + 20 GROUP BY 1, 2""")
def j2_context(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.context_text(spans(spark, sf), words(spark, sf), ["clip_id"]).select("source_id", "clip_id", "before_text", "lines", "after_text")


@query(f"WITH {WORDS}, {SPANS} SELECT p.source_id, p.clip_id AS candidate_id, coalesce(string_agg(w.text, ' ' ORDER BY w.s, w.word_idx), '') AS context FROM spans p LEFT JOIN words w ON w.source_id = p.source_id AND w.s >= p.s - 90 AND w.s < p.e + 30 GROUP BY 1, 2")
def j3_review_context(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_context(spans(spark, sf).withColumnRenamed("clip_id", "candidate_id"), words(spark, sf)).select("source_id", "candidate_id", "context")


@query(f"WITH {WORDS} SELECT c.conv_id AS source_id, c.turn AS evidence_id, count(*) AS n, min(w.text) AS first_text FROM (SELECT DISTINCT conv_id, turn FROM conversations) c JOIN words w ON w.source_id = c.conv_id AND w.s BETWEEN c.turn * 1024 + 1 AND c.turn * 1024 + 11 GROUP BY 1, 2")
def j5_evidence_words(spark: SparkSession, sf: str) -> DataFrame:
    evidence = table(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("evidence_id"), (F.col("turn") * 1024 + 3.0).alias("time")).distinct()
    return review.evidence_words(evidence, words(spark, sf)).groupBy("source_id", "evidence_id").agg(F.count("*").alias("n"), F.min("text").alias("first_text"))


@query(f"WITH {WORDS}, {SPANS}, {CHUNKS} SELECT p.source_id, p.clip_id AS range_id, c.idx AS chunk_id FROM spans p JOIN plan c ON c.source_id = p.source_id AND c.c_e >= p.s AND c.c_s <= p.e")
def j6_chunks_in_range(spark: SparkSession, sf: str) -> DataFrame:
    ranges = spans(spark, sf).withColumnRenamed("clip_id", "range_id")
    return intervals.chunks_in_range(ranges, chunks(spark, sf).select("source_id", F.col("index").cast("long").alias("chunk_id"), F.col("core_start").alias("c_start"), F.col("core_end").alias("c_end")))


_GRID = "grid AS (SELECT DISTINCT conv_id AS source_id, turn, turn * 1024 + 6.0 AS t FROM conversations)"


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), "turn", (F.col("turn") * 1024 + 6.0).alias("at")).distinct()


@query(f"WITH {WORDS}, {MARKS}, {_GRID}, ok AS (SELECT g.source_id, g.turn, m.mark, row_number() OVER (PARTITION BY g.source_id, g.turn ORDER BY abs(m.mark - g.t), m.mark) AS n FROM grid g JOIN marks m ON m.source_id = g.source_id AND abs(m.mark - g.t) <= 8) SELECT g.source_id, g.turn, o.mark AS nearest FROM grid g LEFT JOIN (SELECT * FROM ok WHERE n = 1) o USING (source_id, turn)")
def j11_nearest_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.nearest(_grid(spark, sf), transcript.boundaries(words(spark, sf)), 8.0).select("source_id", "turn", "nearest")


@query(f"WITH {WORDS}, {_GRID}, gaps AS (SELECT source_id, pe AS mark FROM (SELECT source_id, s, lag(e) OVER (PARTITION BY source_id ORDER BY s, word_idx) AS pe FROM words) WHERE s - pe >= 0.4), ok AS (SELECT g.source_id, g.turn, m.mark, row_number() OVER (PARTITION BY g.source_id, g.turn ORDER BY abs(m.mark - g.t), m.mark) AS n FROM grid g JOIN gaps m ON m.source_id = g.source_id AND abs(m.mark - g.t) <= 500) SELECT g.source_id, g.turn, o.mark AS nearest FROM grid g LEFT JOIN (SELECT * FROM ok WHERE n = 1) o USING (source_id, turn)")
def j12_snap_to_pause(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.nearest(_grid(spark, sf), transcript.pauses(words(spark, sf)), 500.0).select("source_id", "turn", "nearest")


@query(f"""WITH {WORDS}, {SPANS}, p AS (SELECT *, greatest(0, s - 0.8) AS ps, e + 1.2 AS pe FROM spans), q AS (SELECT p.source_id, p.clip_id, p.ps, p.pe, min(w.s) FILTER (WHERE w.s >= p.ps - 0.4) AS f, max(w.e) FILTER (WHERE w.e <= p.pe + 0.4) AS l FROM p LEFT JOIN words w USING (source_id) GROUP BY 1, 2, 3, 4),
r AS (SELECT source_id, clip_id, coalesce(greatest(0, f - 0.15), ps) AS a, coalesce(l + 0.25, pe) AS b FROM q) SELECT source_id, clip_id, round(a, 4) AS cut_start, round(least(greatest(b, a + 12), a + 45), 4) AS cut_end FROM r""")
def j13_snap_clips(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.media import snap_clips

    return snap_clips(spans(spark, sf), words(spark, sf)).select("source_id", "clip_id", F.round("cut_start", 4).alias("cut_start"), F.round("cut_end", 4).alias("cut_end"))


@query(f"WITH {WORDS}, {CHUNKS} SELECT source_id, idx AS \"index\", a_s AS audio_start, a_e AS audio_end, c_s AS core_start, c_e AS core_end FROM plan")
def p1_chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).withColumn("index", F.col("index").cast("long"))


def heard(spark: SparkSession, sf: str) -> DataFrame:
    """Words as each chunk hears them, on the chunk's clock, with their plan."""
    plan = chunks(spark, sf)
    points = words(spark, sf).withColumns({"at": F.col("start")}).drop("start", "end")
    inside = intervals.points_in_intervals(plan.select("source_id", "index", "audio_start", "audio_end"), points, "audio_start", "audio_end")
    return inside.select("source_id", "index", "word_idx", "text", (F.col("at") - F.col("audio_start")).alias("start"), (F.col("at") + 0.25 - F.col("audio_start")).alias("end"), "confidence", "speaker", "uncertain")


@query(f"WITH {WORDS}, {CHUNKS} SELECT w.source_id, p.idx AS \"index\", w.word_idx, w.s AS start_at, w.e AS end_at FROM words w JOIN plan p ON p.source_id = w.source_id AND w.s >= p.a_s AND w.s < p.a_e")
def p2_global_words(spark: SparkSession, sf: str) -> DataFrame:
    return transcript.to_global(heard(spark, sf), chunks(spark, sf)).select("source_id", F.col("index").cast("long").alias("index"), "word_idx", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(f"WITH {WORDS}, {CHUNKS} SELECT w.source_id, p.idx AS \"index\", w.word_idx, w.text FROM words w JOIN plan p ON p.source_id = w.source_id AND w.s >= p.a_s AND w.s < p.a_e AND (w.s + w.e) / 2 >= p.c_s AND (w.s + w.e) / 2 < p.c_e")
def p4_owned_words(spark: SparkSession, sf: str) -> DataFrame:
    return transcript.owned_words(transcript.to_global(heard(spark, sf), chunks(spark, sf))).select("source_id", F.col("index").cast("long").alias("index"), "word_idx", "text")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'blank' WHEN l_discount > 0.08 THEN 'bad times' WHEN l_tax > 0.07 THEN 'bad confidence' WHEN l_quantity > 49 THEN 'past the audio' ELSE '' END AS first_error FROM lineitem")
def p3_word_validity(spark: SparkSession, sf: str) -> DataFrame:
    n, d, t, q = (F.col(c) for c in ("l_linenumber", "l_discount", "l_tax", "l_quantity"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 3, "  ").otherwise("word").alias("text"), F.when(d > 0.08, 9.0).otherwise(1.0).alias("start"), F.when(d > 0.08, 8.0).otherwise(q).alias("end"), F.when(t > 0.07, 1.5).otherwise(t).alias("confidence"))
    marked = transcript.validate_words(rows.withColumn("end", F.greatest("end", F.lit(1.0))), F.lit(48.0))
    return marked.select("l_orderkey", "l_linenumber", F.coalesce(F.get("errors", F.lit(0)), F.lit("")).alias("first_error"))


@query(f"WITH {WORDS} SELECT source_id, word_idx, confidence FROM words WHERE confidence < 0.5")
def p5_low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return transcript.low_confidence(words(spark, sf)).select("source_id", "word_idx", "confidence")


@query(f"""WITH {WORDS}, {CHUNKS}, done AS (SELECT *, (source_id + idx) % 7 <> 3 AS done FROM plan), gap AS (SELECT source_id, min(idx) FILTER (WHERE NOT done) AS g FROM done GROUP BY 1),
safe AS (SELECT d.source_id, max(c_e) - CASE WHEN any_value(g.g) IS NULL THEN 0 ELSE 15 END AS x FROM done d JOIN gap g USING (source_id) WHERE g.g IS NULL OR d.idx < g.g GROUP BY 1) SELECT w.source_id, count(*) AS n, max(w.e) AS last_end FROM words w JOIN safe USING (source_id) WHERE w.e <= safe.x GROUP BY 1""")
def p6_safe_prefix(spark: SparkSession, sf: str) -> DataFrame:
    plan = chunks(spark, sf).withColumn("done", (F.col("source_id") + F.col("index")) % 7 != 3)
    return transcript.safe_prefix(words(spark, sf), plan, 15.0).groupBy("source_id").agg(F.count("*").alias("n"), F.max("end").alias("last_end"))


@query(f"""WITH {WORDS}, {CHUNKS}, h AS (SELECT w.source_id, w.word_idx, w.text, p.idx, w.s + p.idx % 2 * 0.125 AS s, w.e + p.idx % 2 * 0.125 AS e, (w.confidence + p.idx * 0.25) % 1.0 AS c FROM words w JOIN plan p ON p.source_id = w.source_id AND w.s >= p.a_s AND w.s < p.a_e)
SELECT CAST(source_id AS VARCHAR) AS source_id, CAST(s AS DOUBLE) AS start_at, CAST(e AS DOUBLE) AS end_at, text, CAST(c AS DOUBLE) AS confidence, FALSE AS uncertain FROM h QUALIFY row_number() OVER (PARTITION BY source_id, word_idx ORDER BY c DESC, idx) = 1""")
def q2_merge_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk hears its words with a jitter of an eighth of a second at most."""
    plan = chunks(spark, sf)
    jitter = (F.col("index") % 2) * 0.125
    shifted = transcript.to_global(heard(spark, sf), plan).withColumns({"start": F.col("start") + jitter, "end": F.col("end") + jitter, "confidence": F.pmod(F.col("confidence") + F.col("index") * 0.25, F.lit(1.0))})
    return transcript.merge_overlaps(shifted, 240, 15).select("source_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "text", "confidence", "uncertain")


#: The same words in one-minute chunks that overlap by half, so that most are heard by two or three.
_HALF = f"""{WORDS}, plan AS (SELECT source_id, k AS idx, greatest(0.0, k * 60.0 - 30) AS a_s, least(d, (k + 1) * 60.0 + 30) AS a_e FROM (SELECT source_id, d, unnest(range(0, CAST(ceil(d / 60.0) AS BIGINT))) AS k FROM (SELECT source_id, max(e) AS d FROM words GROUP BY source_id)))"""


@query(f"""WITH {_HALF}, h AS (SELECT w.source_id, w.word_idx, w.text, p.idx, w.s + p.idx % 2 * 0.125 AS s, w.e + p.idx % 2 * 0.125 AS e, (w.confidence + p.idx * 0.25) % 1.0 AS c FROM words w JOIN plan p ON p.source_id = w.source_id AND w.s >= p.a_s AND w.s < p.a_e)
SELECT CAST(source_id AS VARCHAR) AS source_id, CAST(s AS DOUBLE) AS start_at, CAST(e AS DOUBLE) AS end_at, text, CAST(c AS DOUBLE) AS confidence, FALSE AS uncertain FROM h QUALIFY row_number() OVER (PARTITION BY source_id, word_idx ORDER BY c DESC, idx) = 1""")
def q2_half_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of a minute that overlap by half: words are merged between pauses."""
    plan = chunks(spark, sf, 1, 30)
    points = words(spark, sf).withColumns({"at": F.col("start")}).drop("start", "end")
    inside = intervals.points_in_intervals(plan.select("source_id", "index", "audio_start", "audio_end"), points, "audio_start", "audio_end")
    jitter = (F.col("index") % 2) * 0.125
    shifted = inside.withColumns({"start": F.col("at") + jitter, "end": F.col("at") + 0.25 + jitter, "confidence": F.pmod(F.col("confidence") + F.col("index") * 0.25, F.lit(1.0))})
    return transcript.merge_overlaps(shifted, 60, 30).select("source_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "text", "confidence", "uncertain")


@query(f"WITH {WORDS}, {SPANS}, n AS (SELECT p.source_id, p.clip_id, p.s AS cs, w.*, row_number() OVER (PARTITION BY p.source_id, p.clip_id ORDER BY w.s, w.word_idx) - 1 AS r FROM spans p JOIN words w ON w.source_id = p.source_id AND w.s BETWEEN p.s AND p.e) SELECT source_id, clip_id, r // 4 AS line, min(s) - any_value(cs) AS rel_start, max(e) - any_value(cs) AS rel_end, string_agg(trim(text), ' ' ORDER BY r) AS text FROM n GROUP BY 1, 2, 3")
def w2_caption_groups(spark: SparkSession, sf: str) -> DataFrame:
    return transcript.caption_groups(spans(spark, sf), words(spark, sf)).select("source_id", "clip_id", "line", "rel_start", "rel_end", "text")


def _clip_scores(spark: SparkSession, sf: str) -> DataFrame:
    return spans(spark, sf).withColumnRenamed("clip_id", "candidate_id").withColumn("score", ((F.col("source_id") * 7 + F.col("candidate_id") * 13) % 100).cast("double"))


#: The uncertain words of each span, widened; the best span of a source, then the best that doesn't begin in it.
_RANGES = f"""{WORDS}, {SPANS}, last AS (SELECT source_id, max(e) AS last FROM words GROUP BY 1),
u AS (SELECT p.source_id, p.clip_id, (p.source_id * 7 + p.clip_id * 13) % 100 AS score, min(w.s) AS a, max(w.e) AS b FROM spans p JOIN words w ON w.source_id = p.source_id AND w.s >= p.s AND w.s < p.e AND w.confidence < 0.5 GROUP BY ALL),
v AS (SELECT u.*, greatest(0, a - 5) AS x, least(least(last, b + 5), greatest(0, a - 5) + 60) AS y, row_number() OVER (PARTITION BY u.source_id ORDER BY score DESC, clip_id) AS rn FROM u JOIN last USING (source_id)),
w1 AS (SELECT * FROM v WHERE rn = 1), w2 AS (SELECT v.* FROM v JOIN w1 ON v.source_id = w1.source_id AND NOT (w1.x <= v.x AND v.x <= w1.y) QUALIFY row_number() OVER (PARTITION BY v.source_id ORDER BY v.rn) = 1),
ranges AS (SELECT source_id, 0 AS range_id, x::DOUBLE AS x, y::DOUBLE AS y FROM w1 UNION ALL SELECT source_id, 1, x::DOUBLE, y::DOUBLE FROM w2)"""


@query(f"WITH {_RANGES} SELECT source_id, range_id, x AS start_at, y AS end_at FROM ranges")
def q7_repair_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return transcript.repair_ranges(_clip_scores(spark, sf), words(spark, sf), 2).select("source_id", "range_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def _half_seconds(source: object, start: float, end: float) -> list[dict]:
    """A stand-in for a transcriber: clear words every half second; sources of an odd number fail."""
    if source % 2:
        raise TimeoutError
    return [{"text": "clear", "start": start + i / 2, "end": start + i / 2 + 0.25, "confidence": 0.75} for i in range(int((end - start) * 2))]


@query(f"""WITH {_RANGES}, old AS (SELECT r.source_id, r.range_id, avg(w.confidence) AS c, count(*) AS n FROM ranges r JOIN words w ON w.source_id = r.source_id AND w.s >= r.x AND w.s < r.y GROUP BY 1, 2),
ok AS (SELECT r.* FROM ranges r JOIN old o USING (source_id, range_id) WHERE r.source_id % 2 = 0 AND floor((y - x) * 2) > 0 AND 0.75 > o.c AND floor((y - x) * 2) >= o.n * 0.5)
SELECT source_id, s AS start_at, text, confidence FROM words w WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.source_id = w.source_id AND w.s >= ok.x AND w.s < ok.y) UNION ALL SELECT source_id, x + i / 2, 'clear', 0.75 FROM (SELECT *, unnest(range(0, CAST(floor((y - x) * 2) AS BIGINT))) AS i FROM ok)""")
def x5_repaired_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words after doubtful ranges were transcribed again by a callable."""
    return transcript.repair(words(spark, sf), _clip_scores(spark, sf), _half_seconds, 2).select("source_id", F.col("start").alias("start_at"), "text", "confidence")


_REPAIR = f"""{WORDS}, {SPANS}, old AS (SELECT p.source_id, p.clip_id, avg(w.confidence) AS c, count(*) AS n FROM spans p JOIN words w ON w.source_id = p.source_id AND w.s >= p.s AND w.s < p.e GROUP BY 1, 2),
ok AS (SELECT p.source_id, p.clip_id, coalesce(o.c, 0) AS oc, coalesce(o.n, 0) AS n, (0.5 > coalesce(o.c, 0) AND 6 >= coalesce(o.n, 0) * 0.5) AS accepted, p.s, p.e FROM spans p LEFT JOIN old o USING (source_id, clip_id))"""


def _improved(spark: SparkSession, sf: str) -> DataFrame:
    """Six new words of confidence a half for each span."""
    s = spans(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return s.select("source_id", F.col("clip_id").alias("range_id"), (F.lit(-1) - F.col("clip_id") * 10 - F.col("k")).cast("long").alias("word_idx"), F.lit("clear").alias("text"), (F.col("start") + F.col("k")).alias("start"), (F.col("start") + F.col("k") + 0.5).alias("end"), F.lit(0.5).alias("confidence"))


@query(f"WITH {_REPAIR} SELECT source_id, clip_id AS range_id, round(oc, 6) AS old_confidence, n AS old_words, accepted FROM ok")
def a3_repair_decisions(spark: SparkSession, sf: str) -> DataFrame:
    d = transcript.repair_decisions(spans(spark, sf).withColumnRenamed("clip_id", "range_id"), words(spark, sf), _improved(spark, sf))
    return d.select("source_id", "range_id", F.round("old_confidence", 6).alias("old_confidence"), "old_words", "accepted")


@query(f"WITH {_REPAIR}, kept AS (SELECT w.source_id, w.text FROM words w WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.accepted AND ok.source_id = w.source_id AND w.s >= ok.s AND w.s < ok.e) UNION ALL SELECT source_id, 'clear' FROM ok, range(6) WHERE accepted) SELECT source_id, count(*) AS n, count(*) FILTER (WHERE text = 'clear') AS repaired FROM kept GROUP BY 1")
def q8_apply_repair(spark: SparkSession, sf: str) -> DataFrame:
    ranges, new = spans(spark, sf).withColumnRenamed("clip_id", "range_id"), _improved(spark, sf)
    done = transcript.apply_repair(words(spark, sf), transcript.repair_decisions(ranges, words(spark, sf), new), new)
    return done.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("text") == "clear").alias("repaired"))


_TURNS = "turns AS (SELECT conv_id AS source_id, turn AS window_id, turn * 1024.0 AS s, turn * 1024.0 + 30 AS e, text FROM conversations)"


_HITS = "CAST(contains(lower(text), 'thth') AS INT) + CAST(contains(lower(text), 'ouon') AS INT)"


@query(f"""WITH {WORDS}, {_TURNS}, a AS (SELECT t.source_id, t.window_id, min(w.s) AS anchor FROM turns t JOIN words w ON w.source_id = t.source_id AND w.s >= t.s AND w.s < t.e AND (contains(lower(w.text), 'thth') OR contains(lower(w.text), 'ouon')) GROUP BY 1, 2),
k AS (SELECT t.*, a.anchor FROM turns t LEFT JOIN a USING (source_id, window_id) WHERE len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) >= 8 AND {_HITS} >= 1)
SELECT source_id, window_id, CASE WHEN anchor IS NULL THEN greatest(s, e - 45) ELSE greatest(s, anchor - 12) END AS start_at, CASE WHEN anchor IS NULL THEN e ELSE least(e, anchor + 45) END AS end_at, 40.0 + least(20, 6 * ({_HITS}) + 2 * (len(text) - len(replace(replace(text, '!', ''), '?', '')))) AS preliminary_score FROM k""")
def f7_local_candidates(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("window_id"), (F.col("turn") * 1024.0).alias("start"), (F.col("turn") * 1024.0 + 30).alias("end"), "text")
    signals = ("thth", "ouon")
    hit = turns.where(T.count_contained(F.lower("text"), signals) >= 1)
    out = scout.local_candidates(hit, words(spark, sf), signals, keep=signals)
    return out.select("source_id", "window_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "preliminary_score")


@query(f"WITH {CANDIDATES}, best AS (SELECT p.source_id, p.candidate_id, g.candidate_id AS choice_id, (least(p.e, g.e) - greatest(p.s, g.s)) / (greatest(p.e, g.e) - least(p.s, g.s)) AS iou FROM cands p JOIN cands g ON p.source_id = g.source_id AND p.topic = 'click' AND g.topic = 'purchase' AND p.s <= g.e AND g.s <= p.e), top AS (SELECT *, row_number() OVER (PARTITION BY source_id, candidate_id ORDER BY iou DESC, choice_id) AS n FROM best WHERE iou >= 0.2) SELECT c.source_id, c.candidate_id AS item_id, t.choice_id, round(t.iou, 6) AS iou FROM (SELECT * FROM cands WHERE topic = 'click') c LEFT JOIN (SELECT * FROM top WHERE n = 1) t ON t.source_id = c.source_id AND t.candidate_id = c.candidate_id")
def j4_best_match(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf).withColumnRenamed("candidate_id", "item_id").select("source_id", "item_id", "start", "end", "topic")
    found = intervals.best_match(c.where("topic = 'click'").drop("topic"), c.where("topic = 'purchase'").drop("topic"))
    return found.select("source_id", "item_id", "choice_id", F.round("iou", 6).alias("iou"))


@query(f"WITH {CANDIDATES} SELECT g.source_id, g.candidate_id FROM cands g WHERE g.topic = 'purchase' AND NOT EXISTS (SELECT 1 FROM cands c WHERE c.topic = 'click' AND c.source_id = g.source_id AND (g.s + g.e) / 2 BETWEEN c.s - 15 AND c.e + 15)")
def j7_missing_clusters(spark: SparkSession, sf: str) -> DataFrame:
    c = candidates(spark, sf)
    centers = c.where("topic = 'purchase'").select("source_id", "candidate_id", ((F.col("start") + F.col("end")) / 2).alias("center"))
    return intervals.missing_clusters(centers, c.where("topic = 'click'")).select("source_id", "candidate_id")
