"""SentencePiece encoding and decoding that keeps every piece's place in the source.

Normalisation replaces, from left to right, the longest prefix that the model's compiled character map knows, and records for each byte
it writes the source byte it stems from. The normalised text is cut where no piece of the vocabulary holds the two bytes that meet, so
that no merge can reach across; distinct segments of one length are merged together, a step at a time (the best-scored pair of each),
and their pieces are laid back over the text and projected to byte spans of the source. All steps work on whole Arrow buffers.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import text_chunks, tokenizer_file, unused

MODEL = "piece_bpe_32k.model"
#: Texts are encoded in runs of about this many bytes.
TEXT_BYTES = 2 << 20
#: Segments of more characters are merged one by one with a heap, all others at once.
SHORT = 24
#: Fixed values of the model format: the sign for a space, piece types, and what a piece of type unknown decodes to.
SPACE_SIGN, NORMAL, UNKNOWN, CONTROL, BYTE, UNKNOWN_SURFACE = "▁", 1, 2, 3, 6, " ⁇ "
_loaded: dict[str, Model] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message: integers as they are, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """A compiled map: a double-array trie over source bytes, and the zero-ended strings that its leaves point to."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.pool = np.frombuffer(blob[4 + size :], np.uint8)
        ends = np.flatnonzero(self.pool == 0)
        self.end_of = lambda starts: ends[np.searchsorted(ends, starts)] if len(ends) else starts

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest known prefix at each start (0: none) that stays before the end, and where its replacement begins."""
        length, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.units):
            return length, value
        live, depth = np.arange(len(starts)), 0
        node = np.full(len(starts), self._offset(self.units[:1])[0], np.int64)
        while True:
            inside = starts[live] + depth < ends[live]
            live, node = live[inside], node[inside]
            if not len(live):
                return length, value
            byte = data[starts[live] + depth].astype(np.int64)
            node = node ^ byte
            known = node < len(self.units)
            live, node, byte = live[known], node[known], byte[known]
            unit = self.units[node]
            same = (unit & (0x80000000 | 0xFF)) == byte
            live, node, unit = live[same], node[same], unit[same]
            node = node ^ self._offset(unit)
            depth += 1
            leaf = (unit >> 8) & 1 == 1
            length[live[leaf]], value[live[leaf]] = depth, self.units[node[leaf]] & 0x7FFFFFFF


class Model:
    """A byte-pair model read from its file: vocabulary, scores, character map and the rules for white space."""

    #: The rank of pairs that nothing merges.
    NEVER = 1 << 30

    def __init__(self, data: bytes) -> None:
        pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode("utf-8"), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3, 1) != 2 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or not rules.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only byte-pair models without unused or user-defined pieces, with escaped white space before words, can be read")
        self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.map = CharacterMap(rules.get(2, b""))
        normal = [(p.replace(SPACE_SIGN, " "), i, score) for i, (p, score, kind) in enumerate(pieces) if kind == NORMAL]
        self.id_of, self.score_of = {p: i for p, i, _ in normal}, {p: score for p, _, score in normal}
        byte_ids = [i for i, (_, _, kind) in enumerate(pieces) if kind == BYTE]
        self.byte_ids = byte_ids if trainer.get(35, 0) and len(byte_ids) == 256 else None
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        surface = trainer[44] if 44 in trainer else UNKNOWN_SURFACE.encode()
        place = {i: n for n, i in enumerate(byte_ids)}
        self.surfaces = [b"" if kind == CONTROL else surface if kind == UNKNOWN else bytes([place[i]]) if kind == BYTE else p.replace(SPACE_SIGN, " ").encode() for i, (p, _, kind) in enumerate(pieces)]
        self.is_control = np.array([kind == CONTROL for _, _, kind in pieces])
        self.drops_space = np.array([kind == NORMAL and p.startswith(SPACE_SIGN) for p, _, kind in pieces]) & (self.prefix or self.squeeze)
        # Two bytes that meet within some piece; between any others no merge can happen.
        self.meets = np.zeros((256, 256), bool)
        for p, _, _ in normal:
            b = np.frombuffer(p.encode(), np.uint8)
            self.meets[b[:-1], b[1:]] = True
        self._index_pairs(normal, len(pieces))

    def _index_pairs(self, normal: list[tuple[str, int, float]], first_free: int) -> None:
        """Tables for merging many segments at once: symbol of each character, and of each pair of symbols the merged one and its rank."""
        symbols = dict(self.id_of)
        for c in sorted({c for p, _, _ in normal for c in p}):
            symbols.setdefault(c, first_free + len(symbols))
        self.pieces = first_free
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.width_of = np.zeros(max(symbols.values()) + 1, np.int32)
        for p, i in symbols.items():
            self.width_of[i] = len(p.encode())
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        ranks = {score: rank for rank, score in enumerate(sorted({score for _, _, score in normal}, reverse=True))}
        pairs = [(symbols[p[:k]], symbols[p[k:]], i, ranks[score]) for p, i, score in normal for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        table = np.array(pairs, np.int64).reshape(-1, 4)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys)
        # The last entry stands for pairs that nothing merges.
        self.pair_keys = np.r_[keys[order], np.iinfo(np.int64).max]
        self.pair_to, self.pair_rank = np.r_[table[order, 2], -1].astype(np.int32), np.r_[table[order, 3], self.NEVER].astype(np.int32)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the pairs stand in the table of merges; its last entry if they don't."""
        keys = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, at, len(self.pair_keys) - 1)

    # --- normalisation -----------------------------------------------------------------------------------

    def normalised(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of the texts data[offsets[i]:offsets[i+1]], their offsets, and of each byte (and of the end) its source byte.

        Spaces, and the sign that stands for them, are the byte 0x20. A text that is empty, or of which nothing is left, has no bytes.
        """
        source = np.arange(len(data), dtype=np.int32)
        if len(self.map.units):
            data, source, offsets_now = self._replaced(data, offsets)
        else:
            offsets_now = offsets.astype(np.int64)
        doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets_now))
        keep = np.ones(len(data), bool)
        if self.squeeze and len(data):
            space = data == 0x20
            first = np.r_[True, doc[1:] != doc[:-1]]
            keep = ~(space & (first | np.r_[False, space[:-1]]))
            kept = np.flatnonzero(keep)
            last = np.r_[doc[kept][1:] != doc[kept][:-1], True] if len(kept) else np.zeros(0, bool)
            keep[kept[last & space[kept]]] = False
        # The sign for a space, written out in the text, is one space too.
        sign = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
        if len(sign):
            data = data.copy()
            data[sign] = 0x20
            keep[sign + 1] = keep[sign + 2] = False
        data, source, doc = data[keep], source[keep], doc[keep]
        sizes = np.bincount(doc, minlength=len(offsets) - 1)
        begins = np.cumsum(sizes) - sizes
        if self.prefix:
            fresh = begins[sizes > 0]
            data, source = np.insert(data, fresh, 0x20), np.insert(source, fresh, source[fresh])
            sizes = sizes + (sizes > 0)
        return data, np.concatenate([[0], np.cumsum(sizes)]), source

    def _replaced(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the character map, their source bytes, and the texts' offsets."""
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        text_end = offsets[np.searchsorted(offsets, starts, "right")]
        width = np.diff(np.r_[starts, len(data)])
        length, value = self.map.longest(data, starts, text_end)
        wide = length > width
        if wide.any():  # a prefix of several characters takes those after it along
            reach, lives = 0, np.ones(len(starts), bool)
            at, stop = np.flatnonzero(wide), starts + length
            for i in at.tolist():
                if starts[i] >= reach:
                    reach = int(stop[i])
                    j = int(np.searchsorted(starts, reach))
                    lives[i + 1 : j] = False
            starts, width, length, value = starts[lives], width[lives], length[lives], value[lives]
        found = length > 0
        begin = np.where(found, value + len(data), starts)
        size = np.where(found, self.map.end_of(np.where(found, value, 0)) - value, width)
        ends = np.cumsum(size)
        both = np.concatenate([data, self.map.pool])
        out = both[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out, np.repeat(starts, size), np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]

    # --- merging -----------------------------------------------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """Symbols of a segment after all merges: the best-scored pair first, of equal ones the leftmost."""
        symbols, score_of = list(text), self.score_of
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (score := score_of.get(pair := symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-score, i, pair, j))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, pair, j = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or after[i] != j or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def _segment(self, segment: bytes) -> tuple[bytes, bytes]:
        """Ids of a segment's pieces and where they end in it, both as 32-bit integers.

        A character outside the vocabulary becomes its bytes' pieces, of which the last spans the character.
        """
        ids, ends, at = [], [], 0
        for symbol in self._merged(segment.decode("utf-8")):
            raw = symbol.encode()
            if (i := self.id_of.get(symbol)) is not None:
                ids.append(i)
            elif self.byte_ids:
                # The sign for a space has three bytes of its own.
                spelled = SPACE_SIGN.encode() if symbol == " " else raw
                ids += [self.byte_ids[b] for b in spelled]
                ends += [at] * (len(spelled) - 1)
            else:
                ids.append(self.unknown)
            at += len(raw)
            ends.append(at)
        return np.array(ids, np.int32).tobytes(), np.array(ends, np.int32).tobytes()

    def _merged_alike(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of symbols (segments of one length) after all merges: (which rows, their symbols), rows that end with one length together.

        Each step merges the best pair of every row that still has one, so all rows left are one symbol shorter after it.
        """
        rows = np.arange(len(symbols))
        pairs = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            if symbols.shape[1] == 1:
                yield rows, symbols
                return
            ranks = self.pair_rank[pairs]
            best = ranks.argmin(axis=1)
            over = ranks[np.arange(len(rows)), best] == self.NEVER
            if over.any():
                yield rows[over], symbols[over]
                rows, symbols, pairs, best = rows[~over], symbols[~over], pairs[~over], best[~over]
                if not len(rows):
                    return
            each, width = np.arange(len(rows)), symbols.shape[1]
            symbols[each, best] = self.pair_to[pairs[each, best]]
            columns = np.arange(width)
            symbols = symbols[columns != best[:, None] + 1].reshape(len(rows), width - 1)
            pairs = pairs[columns[:-1] != best[:, None]].reshape(len(rows), width - 2)
            for right in (0, 1):  # the pairs left and right of the merged symbol
                has = best < width - 2 if right else best > 0
                at = best[has] - 1 + right
                pairs[each[has], at] = self._pairs(symbols[each[has], at], symbols[each[has], at + 1])

    def _segments(self, segments: pa.BinaryArray) -> tuple[pa.BinaryArray, pa.BinaryArray]:
        """Of each segment the ids of its pieces and where they end in it, as binary arrays of 32-bit integers."""
        at = np.frombuffer(segments.buffers()[1], np.int32)[: len(segments) + 1].astype(np.int64)
        raw = np.frombuffer(segments.buffers()[2], np.uint8)[: at[-1]]
        symbols = self.symbol_of[np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
        length = np.diff(chars)
        odd = (length > SHORT) | (np.add.reduceat(symbols < 0, chars[:-1]) > 0)
        count, done = np.zeros(len(segments), np.int64), []
        for n in np.unique(length[~odd]).tolist():
            which = np.flatnonzero((length == n) & ~odd)
            for rows, out in self._merged_alike(symbols[chars[which][:, None] + np.arange(n)]):
                plain = (out < self.pieces).all(axis=1)
                odd[which[rows[~plain]]] = True
                done.append((which[rows[plain]], out[plain]))
                count[which[rows[plain]]] = out.shape[1]
        slow = {i: self._segment(segments[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        for i, (ids, _) in slow.items():
            count[i] = len(ids) // 4
        first = np.concatenate([[0], np.cumsum(count)])
        ids, ends = np.empty(first[-1], np.int32), np.empty(first[-1], np.int32)
        for which, out in done:
            places = first[which][:, None] + np.arange(out.shape[1])
            ids[places], ends[places] = out, np.cumsum(self.width_of[out], axis=1)
        for i, (a, b) in slow.items():
            ids[first[i] : first[i + 1]], ends[first[i] : first[i + 1]] = np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)
        cuts = pa.py_buffer((first * 4).astype(np.int32))
        return tuple(pa.Array.from_buffers(pa.binary(), len(segments), [None, cuts, pa.py_buffer(x)]) for x in (ids, ends))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the source byte at which each piece ends, and per text the index of its first piece (one more entry)."""
        text, bounds, source = self.normalised(data, offsets)
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        cut = np.r_[True, ((text[1:] & 0xC0) != 0x80) & ~self.meets[text[:-1], text[1:]]]
        cut[bounds[bounds < len(text)]] = True
        starts = np.flatnonzero(cut)
        segments = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(text)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))]).dictionary_encode()
        ids, ends = (x.take(segments.indices) for x in self._segments(segments.dictionary))
        first = np.frombuffer(ids.buffers()[1], np.int32)[: len(starts) + 1].astype(np.int64) // 4
        stop = np.frombuffer(ends.buffers()[2], np.int32)[: first[-1]] + np.repeat(starts, np.diff(first))
        # A piece ends where the source of the next byte begins, a text's last one with the text.
        where = np.r_[source, 0][stop]
        piece = first[np.searchsorted(starts, bounds)]
        full = np.diff(piece) > 0
        last = np.repeat(bounds[1:][full], np.diff(piece)[full])
        where[stop == last] = np.repeat(offsets[1:][full], np.diff(piece)[full])[stop == last]
        return np.frombuffer(ids.buffers()[2], np.int32)[: first[-1]], where, piece

    # --- decoding ----------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """Texts of the id sequences ids[first[i]:first[i+1]]."""
        ids = np.where((ids >= 0) & (ids < len(self.surfaces)), ids, -1)
        surfaces = pa.array([*self.surfaces, b""], pa.binary()).take(pa.array(np.where(ids < 0, len(self.surfaces), ids)))
        raw = np.frombuffer(surfaces.buffers()[2], np.uint8) if surfaces.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = np.frombuffer(surfaces.buffers()[1], np.int32)[: len(ids) + 1].astype(np.int64)
        raw = raw[: at[-1]]
        # The space that encoding puts before a text goes with its first piece that isn't a control piece.
        silent = np.where(ids < 0, True, self.is_control[ids])
        loud = np.flatnonzero(~silent)
        which = np.searchsorted(loud, first[:-1])
        lead = loud[np.minimum(which, len(loud) - 1)] if len(loud) else np.zeros(len(first) - 1, np.int64)
        some = (which < len(loud)) & (lead < first[1:])
        gone = lead[some][self.drops_space[ids[lead[some]]]] if some.any() else np.zeros(0, np.int64)
        keep = np.ones(len(raw), bool)
        keep[at[gone]] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        ends, clean = kept[at[first]], raw[keep]
        out = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(clean)])
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:  # byte pieces that spell no character, somewhere
            return pa.array([_spelled(clean[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def _spelled(raw: bytes) -> str:
    """UTF-8 bytes as text; each byte that belongs to no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode("utf-8"), "�"]
            at += e.start + 1
    return "".join(out)


def load(name: str) -> Model:
    """The model in a file of public tokenizers, or at a path; it outlives a task where Spark reuses the Python worker."""
    if name not in _loaded:
        with open(name if "/" in name else tokenizer_file(name), "rb") as f:
            _loaded[name] = Model(f.read())
    return _loaded[name]


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """docs with ids (array<int>) and ends (array<int>: the byte of the UTF-8 text at which each piece ends; it begins where the last one ended).

    A null or empty text has no pieces. Pieces tile the text's bytes; those that stand for nothing in the source, such as the space put
    before a text, have empty spans. Rows, repeated ones too, keep their other columns (or those in `keep`), whatever their names;
    columns called ids or ends are replaced. An empty table stays empty.
    """
    others = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "ends")]
    (row,) = unused(docs, "_text")
    # The text is sent once, and sent back only if it is kept.
    source = docs.select(*[F.col(c) for c in others if c != text], F.col(text).alias(row))
    sent = [c for c in others if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            texts = batch.column(len(sent))
            rest = {c: batch.column(i) for i, c in enumerate(sent)} | {text: texts}
            for i, j, data, offsets in text_chunks(texts, TEXT_BYTES):
                ids, ends, first = m.encode(data, offsets)
                places = ends - np.repeat(offsets[:-1], np.diff(first))
                cuts = pa.array(first.astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (ids, places.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*[rest[c].slice(i, j - i) for c in others], *lists], names=[*others, "ids", "ends"])

    schema = docs.select(*others).schema.add("ids", ArrayType(IntegerType())).add("ends", ArrayType(IntegerType()))
    return source.mapInArrow(run, schema)


def decode(coded: DataFrame, ids: str = "ids", model: str = MODEL, to: str = "decoded", digest: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """coded with the text of its ids (array<int>) in column `to`, and in `digest`, if named, the SHA-256 of the decimal ids joined by commas.

    Other columns (or those in `keep`) are kept. Null or empty ids give an empty text; null entries and ids outside the vocabulary give
    nothing, and stand as -1 in the digest. Bytes that spell no character become U+FFFD.
    """
    new = [to, *([digest] if digest else [])]
    others = [c for c in (coded.columns if keep is None else keep) if c not in new]
    source = coded.select(*[F.col(c) for c in others], F.coalesce(F.transform(F.col(ids), lambda x: F.coalesce(x, F.lit(-1))), F.array().cast("array<int>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            at = np.asarray(lists.offsets).astype(np.int64)
            i = 0
            while i < len(lists):  # some rows at a time, for their texts are far larger than their ids
                j = max(i + 1, int(np.searchsorted(at, at[i] + TEXT_BYTES // 4, "right")) - 1)
                first, flat = at[i : j + 1] - at[i], np.asarray(lists.values)[at[i] : at[j]]
                made = [m.decode(flat, first), *([_digests(flat, first)] if digest else [])]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[:-1]], *made], names=[*others, *new])
                i = j

    schema = coded.select(*others).schema
    for c in new:
        schema = schema.add(c, StringType())
    return source.mapInArrow(run, schema)


def _digests(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    values, which = np.unique(ids, return_inverse=True)
    spelled = pa.array([b"%d," % v for v in values.tolist()] or [b""], pa.binary()).take(pa.array(which))
    raw = memoryview(spelled.buffers()[2] or b"")
    at = np.frombuffer(spelled.buffers()[1], np.int32)[: len(ids) + 1][first].tolist() if len(ids) else [0] * len(first)
    return pa.array([hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
