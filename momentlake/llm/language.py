"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Subwords are byte 3-grams and 4-grams of the lower-cased text, letters apart from which count as one space. The embeddings and the
softmax are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows; prediction multiplies the two
into one table, so a text costs one lookup per subword. A temperature and a rejection threshold are fitted on rows set aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import list_rows, lower_latin, text_chunks, unused

BITS, DIMENSIONS, EPOCHS, RATE = 14, 16, 6, 0.5
#: The sample: about this many labelled rows per language, chosen by a hash of the id, in at most so many languages.
PER_LANGUAGE, MOST_LANGUAGES = 400, 512
#: At most about this many in all, so that the driver holds a bounded sample of texts' distinct subwords whatever the languages.
MOST_EXAMPLES = 20_000
#: Of correctly predicted rows set aside, this share may fall below the rejection threshold, which is never over a half.
REJECTED_SHARE, HIGHEST_THRESHOLD = 0.002, 0.5
UNKNOWN = "und"
_SPACED = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of all subwords of some documents, and the document of each."""
    text = _SPACED[lower_latin(data)].astype(np.uint32)
    ids, docs = [], []
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    left = np.repeat(offsets[1:], lengths) - np.arange(len(text))  # bytes from here to the document's end
    for n, factor in ((3, 2654435761), (4, 2246822519)):
        if len(text) < n:
            continue
        value = text[: len(text) - n + 1].copy()
        for j in range(1, n):
            value |= text[j : len(text) - n + 1 + j] << np.uint32(8 * j)
        fits = left[: len(value)] >= n
        blank = (value & np.uint32(0xFFFFFF)) == 0x202020
        fits &= ~blank
        ids.append(((value * np.uint32(factor)) >> np.uint32(32 - BITS)).astype(np.int32)[fits])
        docs.append(doc[: len(value)][fits])
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(ids), np.concatenate(docs)


@dataclass(frozen=True)
class Model:
    """table[subword, language] holds embedding times softmax weights; a text's logits are its mean row plus the bias."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, doc = subwords(data, offsets)
        rows = len(offsets) - 1
        n = np.maximum(np.bincount(doc, minlength=rows), 1)
        sums = [np.bincount(doc, weights=self.table[:, c][ids], minlength=rows) for c in range(len(self.languages))]
        return np.stack(sums, axis=1) / n[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], languages: tuple[str, ...], seed: int = 7) -> Model:
    """Fit on (subword ids, their counts, language's rank) by stochastic gradient descent; every fifth example is set aside."""
    rng = np.random.default_rng(seed)
    aside, used = examples[::5], [e for i, e in enumerate(examples) if i % 5] or examples
    k = len(languages)
    embedding, weights, bias = rng.normal(0, 0.1, (1 << BITS, DIMENSIONS)), np.zeros((DIMENSIONS, k)), np.zeros(k)
    weights = rng.normal(0, 0.1, (DIMENSIONS, k))

    def short(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A few subwords of a text, so that short texts are learned too."""
        take = rng.choice(len(ids), min(len(ids), int(rng.integers(8, 120))), replace=False, p=counts / counts.sum()) if len(ids) else ids
        return ids[take], np.ones(len(take))

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(used)):
            ids, counts, label = used[i]
            for own, n in ((ids, counts), short(ids, counts)):
                if not len(own):
                    continue
                share = n / n.sum()
                mean = share @ embedding[own]
                z = mean @ weights + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label] -= 1
                back = weights @ p
                weights -= rate * np.outer(mean, p)
                bias -= 0.1 * rate * p
                embedding[own] -= rate * len(own) ** 0.5 * share[:, None] * back
    model = Model(languages, (embedding @ weights).astype(np.float32), bias)
    return calibrate(model, aside)


def calibrate(model: Model, aside: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """The temperature of least log-loss on rows set aside, then the threshold that few correct rows of them fall below."""
    aside = [e for e in aside if len(e[0])]
    if not aside:
        return model
    logits = np.stack([(n / n.sum()) @ model.table[ids] + model.bias for ids, n, _ in aside])
    labels = np.array([e[2] for e in aside])
    losses = {}
    for t in np.geomspace(0.25, 8, 26):
        p = Model(model.languages, model.table, model.bias, t).probabilities(logits)
        losses[t] = -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()
    best = Model(model.languages, model.table, model.bias, min(losses, key=losses.get))
    p = best.probabilities(logits)
    right = p.max(axis=1)[p.argmax(axis=1) == labels]
    threshold = min(HIGHEST_THRESHOLD, float(np.quantile(right, REJECTED_SHARE))) if len(right) else 0.0
    return Model(best.languages, best.table, best.bias, best.temperature, threshold)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(1)):
            ids, doc = subwords(data, offsets)
            pair, counts = np.unique(doc.astype(np.int64) << BITS | ids, return_counts=True)
            cuts = np.searchsorted(pair >> BITS, np.arange(j - i + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v.astype(np.int32))) for v in (pair & ((1 << BITS) - 1), counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *lists], names=["label", "ids", "counts"])


def sample_rates(labelled: DataFrame, label: str, wanted: int, most: int, in_all: int = MOST_EXAMPLES) -> dict:
    """Per label value (the `most` frequent ones) the share of rows that gives about `wanted` of them, and `in_all` of all of them at most."""
    found = labelled.groupBy(label).count().orderBy(F.desc("count"), label).limit(most).collect()
    return {r[0]: min(1.0, min(wanted, in_all / len(found)) / r[1]) for r in found}


def sampled(doc_id: Column, label: Column, rates: dict) -> Column:
    """Whether a row is in the sample: a hash of its id, uniform in [0, 1), is below its label's rate."""
    place = F.pmod(F.xxhash64(doc_id), F.lit(1_000_003)) / 1_000_003
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), label)
    return F.coalesce(place < rate, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", usable: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """A model from the labelled rows of docs for which `usable` holds; only their text and language are looked at.

    It learns from a sample of about per_language rows of each of the MOST_LANGUAGES most frequent languages; others can't be predicted.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (usable if usable is not None else F.lit(True)))
    rates = sample_rates(known, lang, per_language, MOST_LANGUAGES)
    if not rates:
        return Model((), np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    languages = tuple(sorted(rates))
    rows = known.where(sampled(F.col(doc_id), F.col(lang), rates)).select(F.col(lang).alias("label"), F.col(text).alias("text")).mapInArrow(_examples, "label string, ids array<int>, counts array<int>").toArrow()
    rank = {x: i for i, x in enumerate(languages)}
    examples = [(ids.astype(np.int64), counts.astype(np.float64), rank[x]) for x, ids, counts in zip(rows["label"].to_pylist(), list_rows(rows["ids"]), list_rows(rows["counts"]), strict=True)]
    examples.sort(key=lambda e: (e[2], len(e[0]), e[0][:8].tolist(), e[1].tolist()))
    return train([examples[i] for i in np.random.default_rng(1).permutation(len(examples))], languages)


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score (calibrated probability), rejected.

    A null text, or one without a letter, is `und` with score 0 and rejected, and so is every text if no language was learned;
    else lang_pred is a learned language and rejected tells that its score is below the threshold. Ties go to the language that
    sorts first. Null ids, repeated rows and repeated ids are rows of their own; other columns are ignored. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2^14 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                has = np.array(batch.column(2).slice(i, j - i).to_pylist(), bool)
                if not m.languages:
                    has[:] = False
                    best, top = np.zeros(j - i, int), np.zeros(j - i)
                else:
                    p = m.probabilities(m.logits(data, offsets))
                    best, top = p.argmax(axis=1), p.max(axis=1)
                names = [m.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(np.where(has, top, 0.0)), pa.array(~has | (top < m.threshold))], schema=_OUT)

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), letter.alias("has")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs whose text isn't rejected, all columns as they are, whatever their names.

    A null text, or one without a letter, goes. If no language was learned, nothing else is rejected. Rows are judged one by one, so
    repeated rows and rows of one id stay or go by their own text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            has = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            plain = batch.select(range(batch.num_columns - 1))
            for i, j, data, offsets in text_chunks(plain.column(plain.schema.get_field_index(text))):
                good = has[i:j] & (m.probabilities(m.logits(data, offsets)).max(axis=1) >= m.threshold) if m.languages else has[i:j]
                yield plain.slice(i, j - i).filter(pa.array(good))

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select("*", letter.alias(unused(docs, "_has_letter")[0])).mapInArrow(run, docs.schema)
