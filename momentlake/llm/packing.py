"""Packing documents into training sequences: concatenate and cut.

Pass 1 tokenizes each input partition and numbers its tokens from 0; the result is written once. The prefix sums over the
partitions' token totals (one row per partition) then give every document its offset in the corpus, and pass 2 cuts the
token stream into fixed windows. No token is shuffled in either pass. Only the corpus's last sequence is short.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _IS_SPACE, materialize, text_chunks, tokenizer_file, word_starts

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("packing writes native 32-bit integers as little-endian ones")

TOKENIZER, SEQUENCE_LENGTH, END_ID = "word_bpe_49k.json", 4096, 2
#: Words, and lower-cased letter runs, whose ids a Python worker remembers at most; beyond that it starts afresh.
CACHED_WORDS, CACHED_STEMS = 400_000, 600_000
#: Texts are encoded in runs of about this many bytes.
TEXT_BYTES = 4 << 20
_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[65:91] += 32
#: A run of letters with ASCII signs after it, but for the apostrophe, which the tokenizer's pattern joins with letters.
_PLAIN = re.compile(rb"([A-Za-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)")
_loaded: dict[str, _Words] = {}


class _Words:
    """Ids of words as little-endian 32-bit integers, by the tokenizer in a file.

    The tokenizer never joins characters across ASCII white space (its normaliser and its pattern work on each side alone), so the ids
    of a text are those of its words in order, and each distinct word needs to be encoded once. Nor does it join letters with signs
    other than apostrophes: a run of Latin letters is encoded lower-cased, straight by the vocabulary's model, and its signs apart.
    Any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        lower = [chr(c).lower() for c in range(0x130) if chr(c).isalpha()]
        self.letters = {c: bytewise.pre_tokenize_str(c)[0][0] for c in lower if len(c) == 1}
        # Stems are taken apart from the rest only if this tokenizer agrees on a sample of letters and signs.
        sample = [f"{a}{b}{s}" for a in self.letters for b in ("e", a) for s in ("", ",", "!!", "*.")]
        self.plain = self.tokenizer.model.__class__.__name__ == "BPE" and all(self._by_stem(w.encode()) == self._whole([w])[0] for w in sample)
        self.words.clear()
        self.stems.clear()

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _by_stem(self, word: bytes) -> bytes | None:
        """Ids of a run of Latin letters and the signs after it; None for other words."""
        m = _PLAIN.fullmatch(word)
        if not m:
            return None
        stem = self.stems.get(m[1])
        if stem is None:
            text = m[1].decode("utf-8").lower()
            mapped = [self.letters.get(c) for c in text]
            if None in mapped:
                return None
            stem = array("I", [t.id for t in self.tokenizer.model.tokenize("".join(mapped))]).tobytes()
            if len(self.stems) > CACHED_STEMS:
                self.stems.clear()
            self.stems[m[1]] = stem
        if not m[2]:
            return stem
        tail = self.words.get(m[2])
        if tail is None:
            tail = self.words[m[2]] = self._whole([m[2].decode("utf-8")])[0]
        return stem + tail

    def encode(self, words: list[bytes]) -> list[bytes]:
        known = self.words
        if len(known) > CACHED_WORDS:
            known.clear()
        odd = []
        for w in set(words).difference(known):
            ids = self._by_stem(w) if self.plain else None
            if ids is None:
                odd.append(w)
            else:
                known[w] = ids
        for at in range(0, len(odd), 20_000):
            some = odd[at : at + 20_000]
            known.update(zip(some, self._whole([w.decode("utf-8") for w in some]), strict=True))
        return [known[w] for w in words]


def encode_words(words: list[bytes], path: str) -> list[bytes]:
    """Ids of each word; the caches outlive a task where Spark reuses the Python worker."""
    if path not in _loaded:
        _loaded[path] = _Words(path)
    return _loaded[path].encode(words)


_PASS1 = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def encode_texts(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[pa.BinaryArray, np.ndarray]:
    """Ids of the words of texts data[offsets[i]:offsets[i+1]], and per text the index of its first word.

    Each distinct word of the texts is looked up once. Case is dropped first, as the tokenizer does, unless a special token's string
    may stand in the texts, which it matches as it is.
    """
    inside = ~_IS_SPACE[data]
    begins = word_starts(inside, offsets) if len(data) else inside
    starts = np.flatnonzero(begins)
    letters = data[inside]
    if b"<|" not in data.tobytes():
        letters = _LOWER_BYTES[letters]
    lengths = np.add.reduceat(inside.astype(np.int32), starts) if len(starts) else np.zeros(0, np.int32)
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(lengths, dtype=np.int32)])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    ids = pa.array(encode_words(words.dictionary.to_pylist(), path), pa.binary())
    return ids.take(words.indices), np.searchsorted(starts, offsets)


def _pass1(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, part, at, end = tokenizer_file(tokenizer), TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1), TEXT_BYTES):
                found, first = encode_texts(data, offsets, path)
                raw = found.buffers()[2]
                cuts = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1][first].tolist()
                view = memoryview(raw) if raw is not None else memoryview(b"")
                ids = [bytes(view[a:b]) + end for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([part] * (j - i), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], schema=_PASS1)

    return run


_PASS2 = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("continues", pa.bool_()), ("goes_on", pa.bool_())])


def _pass2(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, firsts, totals = batch.column(0), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            if not len(firsts):
                continue
            n = (firsts + totals - 1) // length - firsts // length + 1  # pieces of each document
            row = np.repeat(np.arange(len(n)), n)
            seq = firsts[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = np.maximum(firsts[row], seq * length)
            stop = np.minimum(firsts[row] + totals[row], (seq + 1) * length)
            blobs = batch.column(3).to_pylist()
            ids = [blobs[r][4 * a : 4 * b] for r, a, b in zip(row.tolist(), (begin - firsts[row]).tolist(), (stop - firsts[row]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(row)), *map(pa.array, (begin - firsts[row], stop - begin)), pa.array(ids, pa.binary()), *map(pa.array, (totals[row], seq, begin - seq * length, begin > firsts[row], stop < firsts[row] + totals[row]))], schema=_PASS2)

    return run


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, length: int = SEQUENCE_LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens: doc_id, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset, continues, goes_on.

    `continues` and `goes_on` are the boundary records: whether the piece's document also lies in the sequence before, or after.
    A null or empty text is one `end_id`. A null id, repeated rows and repeated ids are packed like any other row. Other columns of
    `docs` are ignored. An empty table gives no pieces. Sequences are numbered from 0 in input order without gaps.
    """
    tokens = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_pass1(tokenizer, end_id), "doc_id long, part int, start_in_part long, doc_tokens long, ids binary"), "pack")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the input, so its size is bounded by the number of tasks, not by the rows.
    offsets = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("first"), "doc_tokens", "ids")
    return placed.mapInArrow(_pass2(length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, continues boolean, goes_on boolean")


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences from pieces: sequence_id, n_tokens, ids. A group holds at most one sequence's tokens."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined: Column = F.aggregate(ordered, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
