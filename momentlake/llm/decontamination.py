"""Benchmark decontamination with SimHash.

1. Exact prefilter. A passage at the similarity asked for holds at least that share of an item's word 5-grams. All 5-grams of the
   benchmark set bits of a bitmap of bounded size; one scan of the documents keeps the stretches in which enough of them lie
   together. All else is dropped there and never looked at again, whatever the benchmark's size.
2. In these stretches every window of an item's size that begins with a 5-gram of an item of that size, and holds enough of them,
   is fingerprinted from running sums of its words' hash bits.
3. Multi-index Hamming blocks find all items within the radius: a fingerprint is four 16-bit blocks, and a window looks its blocks
   up with all values at most 3 bits away, so any item at most 15 bits away is met (16 differing bits are the fewest that can
   leave every block with four).
4. Candidates are verified on whole windows: the weighted Jaccard similarity of word 5-gram counts.

The benchmark is read in blocks of a bounded number of words; the stretches, not the documents, are read again for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, release, text_chunks, word_hashes

RADIUS, SHINGLE, SIMILARITY = 15, 5, 0.8
#: Words of items that one pass over the kept stretches carries (8 bytes each, and as much again for fingerprints).
WORDS_PER_BLOCK = 1_000_000
#: Bits of the bitmap: 64 for each 5-gram of the benchmark, within these powers of two (8 kB and 16 MB).
LEAST_BITS, MOST_BITS = 16, 27
_BLOCKS, _AT_ONCE = 4, 64


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words."""
    n = len(words) - k + 1
    out = np.full(max(n, 0), k, np.uint64)
    for j in range(k if n > 0 else 0):
        out += words[j : j + n] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1)
    return out


def bit_sums(words: np.ndarray) -> np.ndarray:
    """Running counts of set hash bits; they may wrap, differences over at most 32,767 words do not."""
    bits = np.unpackbits(mix64(words).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(words) + 1, 64), np.int16 if len(words) < 32_768 else np.int64)
    np.cumsum(bits, axis=0, dtype=out.dtype, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of windows [start, end); each word's 64 hash bits vote with weight one."""
    ones = sums[end] - sums[start]
    return np.packbits(2 * ones.astype(np.int64) > (end - start)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def neighbours(width: int, most: int) -> np.ndarray:
    """All differences of `width` bits with at most `most` bits set."""
    return np.array([sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(width), n)], np.int64)


class Index:
    """A bounded block of items: their 5-grams by item size, and their fingerprints by 16-bit blocks."""

    def __init__(self, items: list[tuple[int, np.ndarray]], k: int, radius: int) -> None:
        self.k, self.radius = k, radius
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sizes = np.array([len(w) for _, w in items], np.int64)
        self.grams = [np.unique(grams(w, min(k, len(w))), return_counts=True) for _, w in items]
        pairs = [(g, np.full(len(g), n)) for (g, _), n in zip(self.grams, self.sizes, strict=True)]
        gram, size = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, t) for i, t in ((0, np.uint64), (1, np.int64)))
        order = np.lexsort((size, gram))
        gram, size = gram[order], size[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (size[1:] != size[:-1])
        #: Distinct (5-gram, item size), by 5-gram.
        self.gram, self.gram_size = gram[fresh], size[fresh]
        prints = [fingerprints(bit_sums(w), np.array([0]), np.array([len(w)])) for _, w in items]
        self.prints = np.concatenate([*prints, np.zeros(0, np.uint64)])
        self.near = neighbours(64 // _BLOCKS, radius // _BLOCKS)
        self.tables = []
        for b in range(_BLOCKS):
            value = self._block(self.prints, b)
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange((1 << 16) + 1)), order))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(print, item) of all pairs within the radius, some more than once."""
        found = []
        for b, (pointers, owner) in enumerate(self.tables):
            value = (self._block(prints, b)[:, None] ^ self.near[None, :]).ravel()
            first, count = pointers[value], pointers[value + 1] - pointers[value]
            at = np.flatnonzero(count)
            n = count[at]
            row = np.repeat(at // len(self.near), n)
            item = owner[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(len(row))]
            good = np.bitwise_count(prints[row] ^ self.prints[item]) <= self.radius
            found.append(np.stack([row[good], item[good]]))
        return tuple(np.concatenate(found, axis=1))

    def windows(self, words: np.ndarray, opens: bool, closes: bool, least: float) -> list[tuple[int, int, int]]:
        """(start, end, item size) of the windows to fingerprint.

        A passage at the similarity asked for stays one if moved so that it begins with a 5-gram of its item; only at the
        document's first word may it begin before, cut off there, as windows at the last word are.
        """
        out = []
        for k in {min(self.k, int(n)) for n in np.unique(self.sizes)}:
            g = grams(words, k)
            lo, hi = np.searchsorted(self.gram, g, "left"), np.searchsorted(self.gram, g, "right")
            at = np.flatnonzero(hi > lo)
            n = (hi - lo)[at]
            place = np.repeat(at, n)
            size = self.gram_size[np.repeat(lo[at] - (np.cumsum(n) - n), n) + np.arange(len(place))]
            for one in np.unique(size[np.minimum(size, self.k) == k]).tolist():
                marks, total = place[size == one], one - k + 1
                enough = max(1, int(np.ceil(total * least - 1e-9)))
                held = np.searchsorted(marks, marks + total) - np.arange(len(marks))
                starts = marks[(held >= enough) & ((marks + one <= len(words)) | closes)].tolist()
                if opens:
                    before = np.arange(enough - total, 0)
                    starts += before[np.searchsorted(marks, before + total) >= enough].tolist()
                out += [(max(s, 0), min(s + one, len(words)), one) for s in starts]
        return out

    def matches(self, words: np.ndarray, opens: bool, closes: bool, least: float) -> dict[int, tuple[float, int]]:
        """item: (similarity, -start) of its best window."""
        best: dict[int, tuple[float, int]] = {}
        windows = self.windows(words, opens, closes, least)
        sums = bit_sums(words) if windows else None
        for i in range(0, len(windows), _AT_ONCE):
            start, end, size = np.array(windows[i : i + _AT_ONCE]).T
            row, item = self.within(fingerprints(sums, start, end))
            for r, which in set(zip(row.tolist(), item.tolist(), strict=True)):
                if self.sizes[which] == size[r]:
                    s = similarity(words[start[r] : end[r]], *self.grams[which], self.k)
                    if s >= least:
                        best[which] = max(best.get(which, (0.0, 0)), (s, -int(start[r])))
        return best


def similarity(words: np.ndarray, own: np.ndarray, counts: np.ndarray, k: int) -> float:
    """Weighted Jaccard of 5-gram counts: sum of minima over sum of maxima; fewer words count as one whole."""
    g, n = np.unique(grams(words, min(k, len(words))), return_counts=True)
    _, a, b = np.intersect1d(g, own, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[a], counts[b]).sum())
    return both / (int(n.sum()) + int(counts.sum()) - both)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(1)):
            words, first = word_hashes(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["item_id", "words"])


def _slots(gram: np.ndarray, bits: int) -> np.ndarray:
    return (gram >> np.uint64(64 - bits)).astype(np.int64)


def _bitmap(k: int, bits: int):
    """The bits that items set, as 64-bit pieces of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch.column(0):
                w = np.asarray(words.values).view(np.uint64)
                slots = np.unique(_slots(grams(w, min(k, len(w))), bits))
                piece, first = np.unique(slots >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), first) if len(slots) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(value.view(np.int64))], names=["piece", "value"])

    return run


_STRETCHES = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("closes", pa.bool_()), ("row", pa.int64()), ("words", pa.list_(pa.int64()))])


def _stretches(shared, kinds: list[int], bits: int, gap: int, least_marks: int):
    """Stretches of documents in which at least `least_marks` 5-grams of the benchmark follow each other within twice `gap` words.

    row numbers the documents over all tasks, so that repeated ones stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            before, seen = seen, seen + batch.num_rows
            for i, j, data, offsets in text_chunks(batch.column(2)):
                words, first = word_hashes(data, offsets)
                marks = []
                for k in kinds:
                    slot = _slots(grams(words, k), bits)
                    at = np.flatnonzero((bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
                    marks.append(at[at + k <= first[np.searchsorted(first, at, "right")]])
                at = np.unique(np.concatenate(marks))
                if not len(at):
                    continue
                doc = np.searchsorted(first, at, "right") - 1
                cut = np.flatnonzero((np.diff(at) > 2 * gap) | (np.diff(doc) > 0)) + 1
                a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
                good = b - a >= least_marks
                a, b = a[good], b[good]
                doc = doc[a]
                lo, hi = np.maximum(first[doc], at[a] - gap), np.minimum(first[doc + 1], at[b - 1] + gap)
                parts = [words[x:y] for x, y in zip(lo, hi, strict=True)]
                cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                row = pa.array(doc + i)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(lo - first[doc]), pa.array(hi == first[doc + 1]), pa.array(doc + i + before), lists], schema=_STRETCHES)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("row", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])


def _match(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = []
            for n, (start, closes, words) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(5), strict=True)):
                found = index.matches(np.asarray(words.values).view(np.uint64), start == 0, closes, least)
                rows += [(n, int(index.ids[w]), start - at, int(index.sizes[w]), s) for w, (s, at) in sorted(found.items())]
            which = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(which) for c in (0, 1, 4)] + [pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64()))], schema=_OUT)

    return run


def _leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, radius: int, k: int, least: float) -> DataFrame:
    """find_leaks with th, the hash of the document's text; written."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_items, "item_id long, words array<long>")
    items = materialize(items.where(F.size("words") > 0), "items")
    size, shingles = F.size("words"), F.greatest(F.size("words") - (k - 1), F.lit(1))
    total, n_grams, shortest, longest = items.agg(F.sum(size), F.sum(shingles), F.min(size), F.max(size)).first()
    if not total:
        release(items)
        return spark.createDataFrame([], "doc_id long, th long, item_id long, start_word long, n_words long, similarity double")
    kinds = [r[0] for r in items.select(F.least(size, F.lit(k)).alias("k")).distinct().orderBy("k").collect()]
    bits = min(MOST_BITS, max(LEAST_BITS, int(64 * n_grams - 1).bit_length()))
    pieces = items.select("words").mapInArrow(_bitmap(k, bits), "piece long, value long").groupBy("piece").agg(F.bit_or("value").alias("value")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[np.asarray(pieces["piece"])] = np.asarray(pieces["value"]).view(np.uint64)
    # What a passage may hold between two 5-grams of its item, or before the first and after the last one of it.
    gap = int((longest - k + 1) * (1 - least)) + k + 1
    least_marks = max(1, int(np.ceil(max(1, shortest - k + 1) * least - 1e-9)))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    shared = sc.broadcast(bitmap)
    kept = texts.mapInArrow(_stretches(shared, kinds, bits, gap, least_marks), "doc_id long, th long, start long, closes boolean, row long, words array<long>")
    stretches = materialize(kept, "stretches")
    blocks, found = -(-total // WORDS_PER_BLOCK), []
    for n in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n).toArrow()
        index = Index([(i, np.asarray(w.values).view(np.uint64)) for i, w in zip(block["item_id"].to_pylist(), block["words"], strict=True)], k, radius)
        carried = sc.broadcast(index)
        found.append(materialize(stretches.mapInArrow(_match(carried, least), "doc_id long, th long, row long, item_id long, start_word long, n_words long, similarity double"), "leaks"))
        carried.destroy()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # An item may stand in several stretches of a document; equal items have equal ids only if they are repeated.
    best = every.groupBy("doc_id", "th", "row", "item_id").agg(F.max_by(F.struct("start_word", "n_words", "similarity"), F.struct("similarity", -F.col("start_word"))).alias("b"))
    out = materialize(best.select("doc_id", "th", "item_id", "b.*"), "leaks")
    shared.destroy()
    for done in (items, stretches, *found):
        release(done)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, start_word, n_words, similarity (of the best place).

    The documents are scanned once, without a shuffle, whatever the benchmark's size. A place begins with a 5-gram of its item, or
    at the document's first word. Null, empty and blank texts and items match nothing; items with a null id are left out; items of
    equal text are each reported, rows of one item id as one item, at their best place; repeated document rows are reported as
    often as they stand; null document ids stay null. Windows never cross documents and are cut off at their ends. Other columns
    are ignored. An empty table on either side gives no rows.
    """
    return _leaks(docs, benchmark, doc_id, text, item_id, item_text, radius, shingle, least).drop("th")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without any benchmark item, all columns as they are.

    Rows are judged by their own text: of rows with one id, or without an id, only those go whose text holds an item.
    """
    names = [f"_leak_{n}" for n in range(2)]
    leaked = _leaks(docs, benchmark, doc_id, text, "item_id", "text", RADIUS, SHINGLE, SIMILARITY).select("doc_id", "th").distinct().toDF(*names)
    # Written, so that Spark knows its size and broadcasts it only below its threshold.
    return docs.join(materialize(leaked, "leaked"), docs[doc_id].cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col(names[1])), "left_anti")
