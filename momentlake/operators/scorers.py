"""Pluggable batch scorers. A scorer is a function from a list of texts to a list of scores (or None) of the same length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[list[str]], list[float | None]]


def score_texts(scorer: Scorer, texts: list[str], batch: int = 8) -> list[tuple[float | None, str | None]]:
    """(score, error) per text: a failed batch is retried text by text."""

    def one(some: list[str]) -> list[tuple[float | None, str | None]]:
        scores = scorer(some)
        if len(scores) != len(some):
            raise ValueError("a scorer must return a score per text")
        return [(s, None) for s in scores]

    out: list[tuple[float | None, str | None]] = []
    for at in range(0, len(texts), batch):
        try:
            out += one(texts[at : at + batch])
        except Exception:  # noqa: BLE001  any failure of the user's scorer
            for text in texts[at : at + batch]:
                try:
                    out += one([text])
                except Exception as error:  # noqa: BLE001
                    out.append((None, type(error).__name__))
    return out


def apply_scorer(df: DataFrame, scorer: Scorer, key: list[str], text: str = "text", batch: int = 8, partitions: int | None = None) -> DataFrame:
    """(key, score, error) per row. A failed batch is retried text by text; a text that fails again has a null score and the error's name.

    Filter before this: Spark can't push filters through it. `partitions` bounds how many batches run at once.
    """
    types = dict(df.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = score_texts(scorer, pdf[text].fillna("").tolist(), batch)
            result = pdf[key].copy()
            result["score"] = pd.Series([s for s, _ in out], index=pdf.index, dtype="float64")
            result["error"] = pd.Series([e for _, e in out], index=pdf.index, dtype=object)
            yield result

    some = df.select(*key, text)
    if partitions:
        some = some.repartition(partitions)
    return some.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in key) + ", score double, error string")


def incomplete(scored: DataFrame) -> DataFrame:
    """Per source: windows, failed, failed_share, and whether nothing was scored."""
    failed = F.count_if(F.col("score").isNull())
    return scored.groupBy("source_id").agg(F.count("*").alias("windows"), failed.alias("failed"), (failed / F.count("*")).alias("failed_share"), (failed == F.count("*")).alias("empty"))
