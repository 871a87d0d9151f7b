"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

All statistics are native columns. Class moments are sums over all labelled rows, combined before the shuffle, so no sample is
needed. Class covariances shrink towards the pooled one and towards a sphere; their Cholesky factors are computed once, and a
text's score is the sigmoid of the scaled difference of its Mahalanobis log-densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import agreed, bind, materialize, occurrences, plain_spaces, words_between

POOLED, SPHERE, LEAST_SCORE = 0.3, 0.05, 0.7
#: Log-density differences are divided by this before the sigmoid: the statistics aren't normal, and their tails overstate.
TEMPERATURE = 3.0
STATISTICS = ("log_words", "word_length", "symbols", "capitals", "shouts", "digits", "bars", "letters", "distinct", "dup_lines", "line_words", "short_words", "stops")


def statistics(text: Column) -> Column:
    """The statistics of a whole text as an array of doubles; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = bind(words_between(t), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), F.size(F.filter(w, lambda x: F.length(x) <= 3)).alias("short")))
    lines = bind(F.filter(F.split(t, "\n"), lambda x: x != ""), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))

    def together(w: Column, x: Column) -> Column:
        n, chars = F.greatest(w["n"], F.lit(1)), F.greatest(F.length(F.replace(plain_spaces(t), F.lit(" "), F.lit(""))), F.lit(1))
        root = lambda c: F.sqrt(c.cast("double"))  # noqa: E731  spreads small shares
        return F.array(
            F.log1p(w["n"].cast("double")), F.log1p(chars / n), root(occurrences(t, "#*$%&<>") / chars), root(F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) / chars),
            root(occurrences(t, "!") / n), root(F.length(F.regexp_replace(t, "[^0-9]+", "")) / chars), root(occurrences(t, "|") / n), root(F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) / chars),
            F.least(F.lit(1.0), w["distinct"] / F.least(n.cast("double"), 6 * F.sqrt(n))), root(1 - x["distinct"] / F.greatest(x["n"], F.lit(1))), F.log1p(n / F.greatest(x["n"], F.lit(1))),
            root(w["short"] / n), root(occurrences(t, ".") / n),
        )

    return bind(F.struct(words.alias("w"), lines.alias("l")), lambda s: together(s["w"], s["l"]))


@dataclass(frozen=True)
class Model:
    """Per class the mean, the inverse of the covariance's Cholesky factor, and the log of prior over root determinant."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        densities = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip((densities[1] - densities[0]) / TEMPERATURE, -40, 40)))


def moments(rows: DataFrame, label: str, x: str, size: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label 0 and 1: count, mean and covariance of the arrays x, from sums."""
    first = [F.sum(F.get(x, F.lit(i))).alias(f"s{i}") for i in range(size)]
    second = [F.sum(F.get(x, F.lit(i)) * F.get(x, F.lit(j))).alias(f"p{i}_{j}") for i in range(size) for j in range(i, size)]
    out = {}
    for r in rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"), *first, *second).collect():  # two rows
        n, mean, cov = r["n"], np.array([r[f"s{i}"] for i in range(size)]) / r["n"], np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / n - mean[i] * mean[j]
        out[r[label]] = n, mean, cov
    return out


def discriminant(found: dict[int, tuple[float, np.ndarray, np.ndarray]], size: int) -> Model | None:
    """A model, or None where one of the labels never occurs."""
    if len(found) < 2:
        return None
    total = sum(n for n, _, _ in found.values())
    pooled = sum(n * cov for n, _, cov in found.values()) / total
    means, factors, constants = [], [], []
    for label in (0, 1):
        n, mean, cov = found[label]
        cov = (1 - POOLED - SPHERE) * cov + POOLED * pooled + SPHERE * np.diag(np.diag(pooled) + 1e-4)
        lower = np.linalg.cholesky(cov + 1e-6 * np.eye(size))
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n / total) - np.log(np.diag(lower)).sum())
    return Model(np.array(means), np.array(factors), np.array(constants))


def classify_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", usable: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.7).

    Learns from labels rows with label 0 or 1 for which `usable` (a column over labels) holds; repeated labels count once, ids with
    both labels are left out. Null, empty and blank texts are scored
    by their statistics like any other. Where only one label occurs, every score is that label, where none does, 0.5. Null ids,
    repeated rows and repeated ids are rows of their own; other columns are ignored; an empty table gives no rows.
    """
    measured = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), statistics(F.col(text)).alias("x")), "statistics")
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & (usable if usable is not None else F.lit(True))).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = agreed(known, "doc_id", "y")
    size = len(STATISTICS)
    found = moments(measured.join(known.hint("shuffle_merge"), "doc_id"), "y", "x", size)
    model = discriminant(found, size)
    if model is None:
        score = F.lit(float(next(iter(found))) if found else 0.5)
        return measured.select("doc_id", score.alias("score"), (score >= LEAST_SCORE).cast("int").alias("predicted"))

    @F.pandas_udf("double")
    def density(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    return measured.select("doc_id", density("x").alias("score")).withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))
