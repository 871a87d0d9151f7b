"""How the driver's tables stand in for the operators' inputs, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations: a turn begins every 1,024 s, a word every half second of a turn."""
    w = F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), "turn", "role", F.posexplode(w).alias("i", "text"))
    return rows.select(
        "source_id", (F.col("turn") * 100_000 + F.col("i")).alias("word_idx"), "text", (F.col("turn") * 1024 + F.col("i") * 0.5).cast("double").alias("start"), (F.col("turn") * 1024 + F.col("i") * 0.5 + 0.25).cast("double").alias("end"),
        ((F.col("source_id") * 31 + F.col("i")) % 100 / 128.0).alias("confidence"), F.col("role").alias("speaker"), F.lit(None).cast("string").alias("language"), F.lit(False).alias("uncertain"),
    )


WORDS = r"""
words AS (SELECT source_id, turn * 100000 + i - 1 AS word_idx, w[i] AS text, CAST(turn * 1024 + (i - 1) * 0.5 AS DOUBLE) AS s, CAST(turn * 1024 + (i - 1) * 0.5 + 0.25 AS DOUBLE) AS e, ((source_id * 31 + i - 1) % 100) / 128.0 AS confidence, role AS speaker, turn
  FROM (SELECT source_id, turn, role, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id AS source_id, turn, role, list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM conversations)))
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as candidates of 16 s; a user is a source, 2,048 s of the log are one."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("candidate_id"), F.floor(seconds / 2048).cast("double").alias("start"), (F.floor(seconds / 2048) + 16).cast("double").alias("end"), F.least(F.lit(100.0), "value").alias("score"),
        F.col("event_type").alias("topic"), F.when(F.col("event_id") % 5 == 0, "IRL_ACTION").otherwise("QUOTE").alias("moment_type"),
    )


CANDIDATES = """
cands AS (SELECT user_id AS source_id, event_id AS candidate_id, s, s + 16 AS e, least(100.0, value) AS score, event_type AS topic, CASE WHEN event_id % 5 = 0 THEN 'IRL_ACTION' ELSE 'QUOTE' END AS moment_type
  FROM (SELECT *, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 2048.0) AS DOUBLE) AS s FROM events))
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of job logs; a user is a job."""
    i = F.col("event_id")
    line = (
        F.when(i % 11 == 0, F.concat(F.lit("ERROR request failed api_key=k"), i, F.lit(" https://example.com/f?token="), F.col("user_id"))).when(i % 7 == 0, F.concat(F.lit("PROGRESS scan "), i % 101, F.lit(" eta_seconds "), i % 60))
        .when(i % 13 == 0, "warning: retry after timeout").when(i % 17 == 0, "403 used all available credits or reached spending limit").when(i % 19 == 0, "401 from api.openai.com").when(i % 23 == 0, "dropping this window")
        .when(i % 29 == 0, F.concat(F.lit("PROGRESS estimate "), (i % 90).cast("double"))).otherwise(F.col("event_type"))
    )
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", line.alias("line"), "event_type", "value")


LINES = """
lines AS (SELECT user_id AS job_id, event_id, CASE WHEN event_id % 11 = 0 THEN 'ERROR request failed api_key=k' || event_id || ' https://example.com/f?token=' || user_id WHEN event_id % 7 = 0 THEN 'PROGRESS scan ' || (event_id % 101) || ' eta_seconds ' || (event_id % 60)
  WHEN event_id % 13 = 0 THEN 'warning: retry after timeout' WHEN event_id % 17 = 0 THEN '403 used all available credits or reached spending limit' WHEN event_id % 19 = 0 THEN '401 from api.openai.com' WHEN event_id % 23 = 0 THEN 'dropping this window'
  WHEN event_id % 29 = 0 THEN 'PROGRESS estimate ' || CAST(event_id % 90 AS VARCHAR) || '.0' ELSE event_type END AS line, event_type, value FROM events)
"""


def chunks(spark: SparkSession, sf_dir: str, minutes: float = 4, overlap: float = 15) -> DataFrame:
    from ..operators.transcript import chunk_plan

    sources = words(spark, sf_dir).groupBy("source_id").agg(F.max("end").alias("duration"))
    return chunk_plan(sources, minutes, overlap)


CHUNKS = """
plan AS (SELECT source_id, k AS idx, greatest(0.0, k * 240.0 - 15) AS a_s, least(d, (k + 1) * 240.0 + 15) AS a_e, k * 240.0 AS c_s, least(d, (k + 1) * 240.0) AS c_e FROM (SELECT source_id, d, unnest(range(0, CAST(ceil(d / 240.0) AS BIGINT))) AS k FROM (SELECT source_id, max(e) AS d FROM words GROUP BY source_id)))
"""
