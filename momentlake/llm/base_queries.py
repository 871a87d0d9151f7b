"""Queries over the parts of trained and hashed operators that SQL can express: base scans, counts and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, quality_classifier, quality_rules, secrets
from .common import LOWER, UPPER, table


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base spans of each kind every document has."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"))


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that rules vote on, and the base verdict."""
    return quality_rules.judge_quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen statistics that the quality classifier is fitted to, of every document."""
    found = table(spark, sf_dir, "documents").select("doc_id", quality_classifier.statistics(F.col("text")).alias("x"))
    return found.select("doc_id", *[F.round(F.get("x", F.lit(i)), 9).alias(name) for i, name in enumerate(quality_classifier.STATISTICS)])


_SECRETS_SQL = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: len(x) >= 24)) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

_RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d), h AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM g),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1), c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM r) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d), x AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: len(y))), 0) AS BIGINT) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(x.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""

_LICENSES_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS place, CASE WHEN w[i] = 'cc' AND w[i + 1] = 'by' THEN 'cc-by' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' WHEN w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved' THEN 'reserved' END AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
q AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM p WHERE label IS NOT NULL GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN q USING (doc_id)
"""

_STATISTICS_SQL = r"""
WITH d AS (SELECT doc_id, t, len(w) AS words, greatest(len(w), 1) AS n, greatest(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')), 1) AS chars, len(list_distinct(w)) AS distinct_words, len(list_filter(w, lambda x: len(x) <= 3)) AS short, greatest(len(l), 1) AS lines, len(list_distinct(l)) AS distinct_lines
  FROM (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l FROM documents))
SELECT doc_id, round(ln(1 + words), 9) AS log_words, round(ln(1 + chars / n), 9) AS word_length, round(sqrt((len(t) - len(regexp_replace(t, '[#*$%&<>]', '', 'g'))) / chars), 9) AS symbols, round(sqrt(len(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) / chars), 9) AS capitals, round(sqrt((len(t) - len(replace(t, '!', ''))) / n), 9) AS shouts,
  round(sqrt(len(regexp_replace(t, '[^0-9]+', '', 'g')) / chars), 9) AS digits, round(sqrt((len(t) - len(replace(t, '|', ''))) / n), 9) AS bars, round(sqrt(len(regexp_replace(t, '[^\p{L}]+', '', 'g')) / chars), 9) AS letters, round(least(1.0, distinct_words / least(n, 6 * sqrt(n))), 9) AS distinct, round(sqrt(1 - distinct_lines / lines), 9) AS dup_lines,
  round(ln(1 + n / lines), 9) AS line_words, round(sqrt(short / n), 9) AS short_words, round(sqrt((len(t) - len(replace(t, '.', ''))) / n), 9) AS stops FROM d
"""

QUERIES = {f.__name__: f for f in (base_secrets, base_quality_rules, base_licenses, quality_statistics)}
ORACLES = {"base_secrets": _SECRETS_SQL, "base_quality_rules": _RULES_SQL, "base_licenses": _LICENSES_SQL, "quality_statistics": _STATISTICS_SQL}
