"""Odd rows that every operator must bear."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark: SparkSession) -> DataFrame:
    """Null ids, null, empty, blank and very long texts, repeated rows, and an extra column whose name clashes with internal ones."""
    long_text = " ".join(f"word{i % 997}" for i in range(60_000)) + "\n" + "x" * 20_000
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", "en", "s", 4), (4, long_text, "en", "s", 1), (None, "a lone text without any id at all here", "en", None, 1),
        (None, None, None, None, None), (5, "one two three", "de", "s", 1), (5, "one two three", "de", "s", 1), (6, "one two three", "de", "s", 1), (7, "É ñ ü 漢字   wide\r\nline", "fr", "s", 1),
    ]
    return spark.createDataFrame([(*r, 9) for r in rows], SCHEMA + ", id long")


@pytest.fixture(scope="session")
def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
