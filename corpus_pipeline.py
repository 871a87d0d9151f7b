"""A corpus from raw documents to training sequences: language ID, line dedup, near-dedup, decontamination, packing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.llm import decontamination, language, line_dedup, near_dups, packing
from momentlake.llm.common import in_three, materialize, release, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the model rejects: no letter, or a calibrated score below the threshold."""
    model = language.fit(docs, usable=in_three(F.col("doc_id"), 3) != 1)
    # Judged and filtered row by row, so repeated ids need no join.
    return language.keep_accepted(docs, model).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take recurring lines out; a document of which nothing is left goes."""
    clean = line_dedup.drop_recurring_lines(docs)
    left = clean.where((F.size("dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return near_dups.keep_one_each(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4,096 tokens."""
    pieces = packing.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), name)
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the trained language model nor the tokenizer.
ORACLE_SQL = None
