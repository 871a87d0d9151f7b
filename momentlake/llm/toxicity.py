"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade >= j) = sigmoid(w.x - theta_j) with one weight vector for all thresholds theta_1 <= theta_2 <= ...; the expected severity is
the sum of these probabilities. Features are the distinct words of a text and their prefixes of four to seven bytes, hashed;
those that a bounded labelled sample shows to be tied to toxic texts (or to clean ones) are kept. Where labels tell toxic from
clean only, toxic texts are graded by how many distinct telling features they hold (terciles), so that grades are ordered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _IS_LETTER, agreed, list_rows, lower_latin, mix64, text_chunks, word_hashes, word_starts
from .language import sample_rates, sampled

BITS, PREFIXES = 20, (4, 5, 6, 7)
#: The sample: about this many labelled rows per label.
PER_LABEL, MOST_GRADES = 2500, 16
#: A feature is kept from so many sampled texts on, and if its log odds lie so many standard errors from zero; at most so many.
LEAST_TEXTS, LEAST_Z, MOST_FEATURES = 5, 3.5, 4000
GRADES, STEPS, L2 = 3, 400, 0.02


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed features of each of some documents, ordered by document: (document, feature)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = lower_latin(data)
    words, first = word_hashes(text, offsets, letters=True)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(word_starts(_IS_LETTER[text], offsets))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    # Distinct words of each document first: prefixes follow from them.
    order = np.lexsort((words, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    pick = order[fresh]
    words, doc, starts = words[pick], doc[pick], starts[pick]
    padded = np.concatenate([np.where(_IS_LETTER[text], text, 0).astype(np.uint64), np.zeros(8, np.uint64)])
    parts, prefix, alive = [words], np.zeros(len(words), np.uint64), np.ones(len(words), bool)
    docs = [doc]
    for j in range(max(PREFIXES)):
        byte = padded[starts + j]
        alive &= byte > 0
        prefix |= byte << np.uint64(8 * j)
        if j + 1 in PREFIXES:
            parts.append(mix64(prefix[alive] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
            docs.append(doc[alive])
    ids = (np.concatenate(parts) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    both = np.unique(np.concatenate(docs) << BITS | ids)
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    """weights over all hashed features (mostly zero) and the ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -40, 40)))


def select(rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features tied to the label, and their log odds ratios."""
    size = 1 << BITS
    counts = [np.bincount(np.concatenate([r for r, t in zip(rows, toxic, strict=True) if t == v] or [np.zeros(0, int)]), minlength=size).astype(float) for v in (0, 1)]
    totals = [(toxic == v).sum() for v in (0, 1)]
    odds = [np.log((c + 0.5) / (t - c + 0.5)) for c, t in zip(counts, totals, strict=True)]
    error = np.sqrt(sum(1 / (c + 0.5) + 1 / (t - c + 0.5) for c, t in zip(counts, totals, strict=True)))
    ratio = odds[1] - odds[0]
    score = np.where(counts[0] + counts[1] >= LEAST_TEXTS, np.abs(ratio) / error, 0)
    best = np.argsort(-score, kind="stable")[:MOST_FEATURES]
    best = best[score[best] >= LEAST_Z]
    return best, ratio[best]


def grade(rows: list[np.ndarray], toxic: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """0 for clean texts; toxic ones by terciles of how many telling features they hold."""
    held = np.array([len(np.intersect1d(r, positive)) for r in rows])
    found = held[toxic == 1]
    cuts = np.quantile(found, [1 / 3, 2 / 3]) if len(found) else np.zeros(2)
    return np.where(toxic == 1, 1 + (held > cuts[0]) + (held > cuts[1]), 0)


def fit_ordinal(x: np.ndarray, grades: np.ndarray, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised log-loss, by full-batch Adam; thresholds are a first one plus positive gaps."""
    w, first, gaps = np.zeros(x.shape[1]), np.array([1.0]), np.zeros(n_grades - 1)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("w", w), ("f", first), ("g", gaps))}
    for t in range(1, STEPS + 1):
        theta = first[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        p = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - theta, -40, 40)))
        # The likelihood of a grade is a difference of neighbouring cumulative probabilities.
        padded = np.concatenate([np.ones((len(x), 1)), p, np.zeros((len(x), 1))], axis=1)
        cell = np.maximum(padded[np.arange(len(x)), grades] - padded[np.arange(len(x)), grades + 1], 1e-9)
        slope = p * (1 - p)
        d = np.zeros_like(p)  # of the log-likelihood, by z - theta_j
        for j in range(n_grades):
            d[:, j] = np.where(grades == j + 1, slope[:, j] / cell, 0) - np.where(grades == j, slope[:, j] / cell, 0)
        d = np.clip(d, -5, 5)
        by_theta = -d.sum(axis=0) / len(x)
        grads = {"w": x.T @ d.sum(axis=1) / len(x) - L2 / len(x) ** 0.5 * w, "f": np.array([by_theta.sum()]), "g": np.array([by_theta[j + 1 :].sum() * np.exp(gaps[j]) for j in range(n_grades - 1)])}
        for key, value in (("w", w), ("f", first), ("g", gaps)):
            m, v = state[key]
            m[:] = 0.9 * m + 0.1 * grads[key]
            v[:] = 0.99 * v + 0.01 * grads[key] ** 2
            value += 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, first[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def train(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model from texts' features and labels: 0 and 1, or grades from 0 up."""
    toxic = (labels > 0).astype(int)
    weights = np.zeros(1 << BITS, np.float32)
    if not len(rows) or toxic.min() == toxic.max():
        return Model(weights, np.array([4.0, 5.0, 6.0]) if not len(rows) or not toxic.max() else np.array([-4.0, -3.0, -2.0]))
    chosen, ratio = select(rows, toxic)
    grades = labels.astype(int) if labels.max() > 1 else grade(rows, toxic, chosen[ratio > 0])
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, r in enumerate(rows):
        x[i, place[r][place[r] >= 0]] = 1
    w, theta = fit_ordinal(x, grades, max(int(grades.max()), GRADES if labels.max() <= 1 else 1))
    weights[chosen] = w
    return Model(weights, theta)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(1)):
            doc, ids = features(data, offsets)
            cuts = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32)))], names=["label", "ids"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None, per_label: int = PER_LABEL) -> Model:
    """A model from a bounded sample of the labelled documents for which `usable` holds.

    Rows without a label are left out, and so are ids whose labels contradict each other; repeated ones count once. Labels are 0 and
    1, or grades from 0 up; of more than MOST_GRADES values the most frequent are learned.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (usable if usable is not None else F.lit(True)))
    known = agreed(known.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")), "doc_id", "label")
    rates = sample_rates(known, "label", per_label, MOST_GRADES)
    if not rates:
        return train([], np.zeros(0, int))
    # About per_label rows for each of MOST_GRADES labels at most, of a few bytes each.
    wanted = F.broadcast(known.where(sampled(F.col("doc_id"), F.col("label"), rates)))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(wanted, "doc_id").select("label", "text").mapInArrow(_examples, "label int, ids array<int>").toArrow()
    found = sorted(zip(rows["label"].to_pylist(), list_rows(rows["ids"]), strict=True), key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return train([ids.astype(np.int64) for _, ids in found], np.array([y for y, _ in found], int))


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("severity", pa.float64()), ("grade", pa.int32())])


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, score (chance of any toxicity), severity (expected grade), grade (most likely), toxic (score >= 0.5).

    Null, empty and blank texts have no features and get the score of the thresholds alone. Null ids, repeated rows and repeated
    ids are rows of their own; other columns are ignored; an empty table gives no rows. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^20 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                doc, ids = features(data, offsets)
                p = m.at_least(np.bincount(doc, weights=m.weights[ids], minlength=j - i))
                cells = np.concatenate([np.ones((j - i, 1)), p], axis=1) - np.concatenate([p, np.zeros((j - i, 1))], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(cells.argmax(axis=1).astype(np.int32))], schema=_OUT)

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, severity double, grade int")
    return scored.withColumn("toxic", F.col("score") >= 0.5)
