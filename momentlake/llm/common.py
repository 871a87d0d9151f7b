"""Helpers shared by the training-data operators: input tables, shared scratch space, byte-level word hashing."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, release, scratch_root  # noqa: F401  for the operators beside this

#: ASCII white space, the separator of words in most operators (as a Java and Python character class).
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Python tasks cut their Arrow batches into runs of documents of about this many bytes of text.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that df has not, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def agreed(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One row per key whose labels are all the same."""
    found = labels.groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("_other"))
    return found.where(F.col(label) == F.col("_other")).drop("_other")


def list_rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays, without a Python object per value."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        offsets, values = np.asarray(chunk.offsets), np.asarray(chunk.values)
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def plain_spaces(text: Column, characters: str = "\t\n\x0b\x0c\r") -> Column:
    """Other white space turned into spaces: plain replacements, and a split at one space, are far cheaper than a pattern."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_between(text: Column) -> Column:
    """Runs without ASCII white space; a null text has none."""
    return F.filter(F.split(plain_spaces(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def occurrences(text: Column, characters: str) -> Column:
    """How many of the given characters stand in the text."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.length(text) - F.length(rest)


def in_three(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def bind(value: Column, use) -> Column:
    """use(value) with value computed once per row: a one-element transform keeps Catalyst from copying the expression into lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


# --- word hashing on whole Arrow buffers -------------------------------------------------------------------

_MUL, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TO_LOWER = np.arange(256, dtype=np.uint64)
_TO_LOWER[65:91] += 32
_POWERS = np.cumprod(np.full(4096, 0x20000000657, np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lower_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals U+00C0 to U+00DE lowered."""
    out = _TO_LOWER[data].astype(np.uint8)
    if len(out) > 1:
        after = out[1:]
        capital = (out[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        after[capital] += 0x20
    return out


def word_starts(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the maximal runs of `inside` begin; a document's first byte always begins one."""
    before = np.empty(len(inside), bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[offsets < len(inside)]] = False
    return inside & ~before


def word_hashes(data: np.ndarray, offsets: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the documents data[offsets[i]:offsets[i+1]], A-Z lowered.

    Words are maximal runs without ASCII white space; with `letters`, of ASCII letters and bytes of other scripts.
    Returns the hashes in order and, per document, the index of its first word (one more entry than documents).
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _IS_LETTER[data] if letters else ~_IS_SPACE[data]
    begins = word_starts(inside, offsets)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(n, dtype=np.int64) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
    folded = place >> 12  # words beyond 4,096 bytes reuse the powers with another multiplier
    value = (_TO_LOWER[data] + np.uint64(1)) * _POWERS[place & 4095]
    if folded.any():
        value = np.where(folded > 0, mix64(value + folded.astype(np.uint64) * _MUL), value)
    value[~inside] = 0
    return mix64(np.add.reduceat(value, starts)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one document; with fewer words, of the whole sequence as one; none without words."""
    if not len(words):
        return words
    k_here = min(k, len(words))
    total = np.zeros(len(words) - k_here + 1, np.uint64)
    for j in range(k_here):
        m = np.uint64(pow(int(_MUL), j + 1, 1 << 64))
        total += mix64(words[j : len(words) - k_here + 1 + j] ^ m) * m
    return mix64(total + np.uint64(k_here))


def text_chunks(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows of at most `limit` bytes or of one row; null texts are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if pa.types.is_large_string(text.type) or not pa.types.is_string(text.type):
        text = text.cast(pa.string())
    text = text.fill_null("") if text.null_count else text
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's vocabulary lies on this machine; MOMENTLAKE_TOKENIZERS names another folder."""
    if folder := os.environ.get("MOMENTLAKE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
