"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base_queries, decontamination, hard_negatives, language, licenses, line_dedup, near_dups, packing, pieces, quality_classifier, quality_rules, resampling, secrets, toxicity
from .common import in_three, table


def _all(places: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    chosen = F.filter(places, lambda s: s["kind"].isin(kinds)) if kinds else places
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_all(F.col("spans"), ["assign", "access", "hex"]), 256).alias("base_sha256"), _all(F.col("spans")).alias("spans"), count("random"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.recurring_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("did").alias("doc_id"), "n_lines", F.size("dropped").alias("n_dropped"), "n_tokens", "dropped_tokens", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = in_three(F.col("doc_id"), 3) == 1
    model = language.fit(docs, usable=~F.coalesce(held, F.lit(True)))
    return language.identify(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = in_three(F.col("doc_id"), 4) == 3
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~held)
    return toxicity.score_toxicity(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "severity", "grade", "toxic")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 9).alias("posterior"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = in_three(F.col("doc_id"), 4) == 2
    scored = quality_classifier.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=~held)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = pieces.encode(docs.select("doc_id", "text", F.octet_length("text").alias("n_bytes")), keep=["doc_id", "n_bytes"])
    # The pieces' spans end with the text.
    whole = F.coalesce(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1), F.lit(0)) == F.coalesce("n_bytes", F.lit(0))
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), whole.alias("spans_cover"), "ids")
    back = pieces.decode(coded, digest="ids_sha256", keep=["doc_id", "n_tokens", "spans_cover"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "spans_cover")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.usable_rows(table(spark, sf_dir, "embeddings"), label, 256)
    return hard_negatives.mine(rows, rows.where(F.col("vec_id") % 50 == 0))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_secrets, op3_decontamination, op4_line_dedup, op5_language, op6_toxicity, op7_quality_rules, op8_quality_classifier, op9_licenses, op10_near_dups, op11_sentencepiece, op12_hard_negatives, op13_resampling, pipeline)} | base_queries.QUERIES

#: All pairs that share a shingle, compared in full, and the smallest id reachable: quadratic, for small tables.
_NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

#: All rows against all anchors.
_NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, min(struct_pack(l := CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, q := list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))))) AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS a, a.r.l = b.r.l AS same, b.vec_id AS b, CAST(list_dot_product(a.r.q, b.r.q) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score QUALIFY rank <= 3
"""

#: CRC-32 of each distinct word, byte by byte.
_RESAMPLE_SQL = r"""
WITH w AS (SELECT 1 AS corpus, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 0, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT corpus, doc_id, unnest(w) AS w FROM w),
t AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)),
h AS (SELECT w, list_transform(range(1, length(hex(w)), 2), lambda p: 16 * (instr('0123456789ABCDEF', substr(hex(w), p, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(w), p + 1, 1)) - 1) AS b FROM (SELECT DISTINCT w FROM f)),
c AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], b), lambda c, x: xor(t.t[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS bucket FROM h, t),
n AS (SELECT bucket, CAST(count(*) FILTER (corpus = 1) AS DOUBLE) AS s, CAST(count(*) FILTER (corpus = 0) AS DOUBLE) AS t FROM f JOIN c USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM n),
d AS (SELECT doc_id, sum(gain) AS weight FROM f JOIN c USING (w) JOIN g USING (bucket) WHERE corpus = 1 GROUP BY doc_id),
u AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  list_reduce(list_concat([0], list_transform(range(1, 9), lambda i: instr('0123456789abcdef', substr(sha256('2024:' || w.doc_id), i, 1)) - 1)), lambda a, x: 16 * a + x) AS h FROM w LEFT JOIN d ON d.doc_id = w.doc_id WHERE corpus = 1),
v AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM u),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM v WHERE n_features >= 20)
SELECT v.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM k) THEN rank END AS rank FROM v LEFT JOIN k ON k.doc_id = v.doc_id
"""

ORACLES = {"op10_near_dups": _NEAR_SQL, "op12_hard_negatives": _NEGATIVES_SQL, "op13_resampling": _RESAMPLE_SQL} | base_queries.ORACLES
