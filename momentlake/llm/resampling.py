"""Importance resampling towards a target distribution, over hashed word n-grams.

A document's words are joined by single spaces and scanned once: the running CRC-32 register is kept at every word's bounds. The CRC of
any run of words then follows from the registers at its two ends, for the register is linear over GF(2): the one at the start, shifted
by the run's length, cancels what came before. Shifts are products with fixed 32 x 32 bit matrices, done as table lookups. Documents are
ranked by the summed log-ratio of their buckets in target and corpus plus a Gumbel number of their id, which draws without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import _TO_LOWER, materialize, release, text_chunks, word_starts

NGRAM, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Texts are scanned in runs of about this many bytes.
TEXT_BYTES = 4 << 20
#: Registers are carried over rows of this many bytes; shifts by less have a table of their own.
ROW = 64
_POLYNOMIAL, _ONES = np.uint32(0xEDB88320), np.uint32(0xFFFFFFFF)  # fixed values of CRC-32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWERED = _TO_LOWER.astype(np.uint8)


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ _POLYNOMIAL, out >> 1).astype(np.uint32)
    return out


_STEP = _byte_table()


def _tables_of(shift) -> np.ndarray:
    """Four tables of 256, one per byte of the register, for a map that is linear over GF(2)."""
    return np.stack([shift(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Shifts by 0 to ROW - 1 zero bytes, flat as (bytes, register byte, value), and by ROW times each power of two."""
    by_one = _tables_of(lambda x: _STEP[x & 255] ^ (x >> 8))
    small = [_tables_of(lambda x: x)]
    for _ in range(ROW):
        small.append(_tables_of(lambda x, t=small[-1]: _apply(by_one, _apply(t, x))))
    powers = [small.pop()]
    while len(powers) < 32:
        powers.append(_tables_of(lambda x, t=powers[-1]: _apply(t, _apply(t, x))))
    return np.concatenate([t.reshape(-1) for t in small]), powers


_SMALL, _POWERS_OF_ROW = _shift_tables()


def shifted(registers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes more."""
    at = (lengths % ROW).astype(np.int64) * 1024
    x = registers
    out = _SMALL[at + (x & 255)] ^ _SMALL[at + 256 + ((x >> 8) & 255)] ^ _SMALL[at + 512 + ((x >> 16) & 255)] ^ _SMALL[at + 768 + (x >> 24)]
    rest, k = lengths // ROW, 0
    far = np.flatnonzero(rest)
    while len(far):
        odd = far[(rest[far] >> k) & 1 == 1]
        out[odd] = _apply(_POWERS_OF_ROW[k], out[odd])
        k += 1
        far = far[(rest[far] >> k) > 0]
    return out


def prefix_registers(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The running register, from 0, before byte at[i] of data.

    Rows of ROW bytes are scanned side by side; the registers at their ends are then carried over, doubling the reach each time.
    """
    n = -(-max(len(data), 1) // ROW)
    padded = np.zeros(n * ROW, np.uint8)
    padded[: len(data)] = data
    columns = np.ascontiguousarray(padded.reshape(n, ROW).T)
    seen, register = np.zeros((ROW + 1, n), np.uint32), np.zeros(n, np.uint32)
    for j in range(ROW):
        register = _STEP[(register & 255) ^ columns[j]] ^ (register >> 8)
        seen[j + 1] = register
    carried, reach, k = register.copy(), 1, 0
    while reach < n:
        before = _apply(_POWERS_OF_ROW[k], carried[:-reach])
        carried[reach:] ^= before
        reach, k = reach * 2, k + 1
    carried = np.concatenate([np.zeros(1, np.uint32), carried])
    row, column = at // ROW, at % ROW
    own = seen[column, np.minimum(row, n - 1)]
    own[row >= n] = 0
    return own ^ shifted(carried[row], column)


def gram_crcs(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For runs of 1 to n words of the texts data[offsets[i]:offsets[i+1]]: their CRC-32 values, the texts they belong to, and the words per text."""
    inside = _IS_WORD[data]
    texts = len(offsets) - 1
    if not inside.any():
        return [np.zeros(0, np.uint32)] * n, [np.zeros(0, np.int64)] * n, np.zeros(texts, np.int64)
    begins = word_starts(inside, offsets)
    starts = np.flatnonzero(begins)
    sizes = np.add.reduceat(inside.astype(np.int64), starts)
    # The words of all texts, lower-cased, each with one space after it.
    stream = np.insert(_LOWERED[data[inside]], np.cumsum(sizes), 0x20)
    ends = np.cumsum(sizes + 1) - 1
    firsts = ends - sizes
    registers = prefix_registers(stream, np.concatenate([firsts, ends]))
    at_start, at_end = registers[: len(starts)], registers[len(starts) :]
    text_of = np.searchsorted(offsets, starts, "right") - 1
    crcs, owners = [], []
    for k in range(1, n + 1):
        m = max(0, len(starts) - k + 1)
        one = text_of[:m] == text_of[len(starts) - m :]
        a, b = np.flatnonzero(one), np.flatnonzero(one) + k - 1
        length = ends[b] - firsts[a]
        # A CRC starts from all ones, so that start is shifted along too.
        crcs.append(at_end[b] ^ shifted(at_start[a] ^ _ONES, length) ^ _ONES)
        owners.append(text_of[a])
    return crcs, owners, np.bincount(text_of, minlength=texts)


def _scan(ngram: int, buckets: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1), TEXT_BYTES):
                crcs, owners, words = gram_crcs(data, offsets, ngram)
                found, owner = np.concatenate(crcs) % np.uint32(buckets), np.concatenate(owners)
                if ngram > 1:
                    order = np.argsort(owner, kind="stable")
                    found, owner = found[order], owner[order]
                counts = np.bincount(owner, minlength=j - i)
                cuts = np.concatenate([[0], np.cumsum(counts)]) * np.dtype(width).itemsize
                blobs = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(found.astype(width))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words.astype(np.int64)), pa.array(counts.astype(np.int64)), blobs], names=["doc_id", "n_words", "n_features", "buckets"])

    return run


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets (binary: the bucket of each run of 1 to ngram words); written."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return materialize(source.mapInArrow(_scan(ngram, buckets, _width(buckets)), "doc_id long, n_words long, n_features long, buckets binary"), "features")


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features fall in each bucket; tasks count first, so at most `buckets` rows a task are shuffled."""
    width = _width(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            column = batch.column(0)
            if column.buffers()[2] is not None:
                at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
                total += np.bincount(np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(width), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return scanned.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: floor(1000 ln) of the ratio of its smoothed shares in target and corpus; one row for each bucket."""
    total = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy()), F.lit(0))  # noqa: E731  over the buckets, a number fixed by the parameter
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(corpus.withColumnRenamed("n", "s").hint("shuffle_merge"), "bucket", "left").join(target.withColumnRenamed("n", "t").hint("shuffle_merge"), "bucket", "left").fillna(0, ["s", "t"])
    wide = both.select("bucket", *[F.col(c).cast("double").alias(c) for c in ("s", "t")]).withColumns({"all_s": total("s"), "all_t": total("t")})
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return wide.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weigh(gain: np.ndarray, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(width) if column.buffers()[2] is not None else np.zeros(0, width)
            run_sum = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[raw])])
            cuts = (at - at[0]) // np.dtype(width).itemsize
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(run_sum[cuts[1:]] - run_sum[cuts[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the hash of seed and id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs: doc_id, n_words, n_features, weight, score, rank (null if not drawn). target needs only a column `text`.

    floor(percent/100) of the documents of at least `least` words are drawn, highest scores first, ties to the smaller id (a null id last). Null and
    empty texts have no words: weight 0, never drawn. Repeated rows and ids are ranked as rows of their own. An empty target or corpus
    counts as one in which all buckets are equal; an empty table of documents gives no rows. Other columns are ignored.
    """
    scanned = features(docs, doc_id, text, ngram, buckets)
    wanted = features(target.select(F.lit(None).cast("long").alias("_id"), F.col("text").alias("_text")), "_id", "_text", ngram, buckets)
    table = gains(bucket_counts(scanned, buckets), bucket_counts(wanted, buckets), buckets).toArrow()  # `buckets` rows
    release(wanted)
    gain = np.zeros(buckets, np.int64)
    gain[np.asarray(table["bucket"])] = np.asarray(table["gain"])
    weighed = scanned.mapInArrow(_weigh(gain, _width(buckets)), "doc_id long, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    release(scanned)
    eligible = F.col("n_words") >= least
    drawn = percent * scored.where(eligible).count() // 100
    placed = numbered(scored.withColumn("_eligible", eligible), [], [F.desc("_eligible"), F.desc("score"), F.asc_nulls_last("doc_id")])
    release(scored)
    return placed.withColumn("rank", F.when(F.col("_eligible") & (F.col("rank") <= drawn), F.col("rank"))).drop("_eligible")
