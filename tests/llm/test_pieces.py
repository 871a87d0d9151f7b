"""SentencePiece encoding against the library; normalisation by a compiled map against a plain walk."""

from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from momentlake.llm import pieces
from momentlake.llm.common import text_chunks, tokenizer_file

ODD = ["", " ", "  ", "Hello  world\n\t▁x é 漢字 ﬁ  ", "▁", "▁▁a ▁ b", "x" * 500, " " * 300 + "y" + " " * 77, "<s> </s><0x41> <unk>", "\x00\x01", "😀😀 a😀", "é é", "　全角", "don't 12.5% [x](y)", "a▁b"]


def test_rows_equal_the_library(spark, odd_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(pieces.MODEL))
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t, None, None, None, 1) for i, t in enumerate(ODD)], odd_docs.schema))
    rows = pieces.decode(pieces.encode(docs.repartition(3)), digest="sha").collect()
    assert len(rows) == docs.count() and set(docs.columns) < set(rows[0].asDict())
    for r in rows:
        text = r["text"] or ""
        found = library.encode(text, return_type="proto").pieces
        assert r["ids"] == [p.id for p in found] and r["ends"] == [p.end for p in found]
        assert r["decoded"] == library.decode(r["ids"]) and r["sha"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert (r["ends"] or [0])[-1] == len(text.encode())


def test_any_ids_decode_like_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(pieces.MODEL))
    rng = random.Random(4)
    ids = [[1, 259, 264, 2], [259], [3, 4, 195, 130], [230, 129, 264], [0, 264], [264, 0], [], [1, 2]] + [[rng.choice([rng.randrange(300), rng.randrange(32_000)]) for _ in range(9)] for _ in range(300)]
    coded = spark.createDataFrame([(i, x) for i, x in enumerate(ids)] + [(998, None), (999, [None, 10**6, 264])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in pieces.decode(coded).collect()}
    assert got[998] == "" and got[999] == library.decode([264])
    assert [got[i] for i in range(len(ids))] == [library.decode(x) for x in ids]


def compiled(entries: dict[str, str]) -> bytes:
    """A character map in the model's format: a sparse double array, each node's children in a block of 256 of its own."""
    pool, at = b"", {}
    for key, value in entries.items():
        at[key.encode()] = len(pool)
        pool += value.encode() + b"\0"
    prefixes = sorted({k[:i] for k in at for i in range(len(k) + 1)})
    block = {p: 256 * (i + 1) for i, p in enumerate(prefixes)}
    units = [0] * (256 * (len(prefixes) + 1))
    place = {b"": 0}
    for p in prefixes:  # a node's unit: where its children are, whether it ends a key, and its byte
        if p:
            place[p] = block[p[:-1]] ^ p[-1]
        here = place[p]
        units[here] = ((here ^ block[p]) << 10) | ((p in at) << 8) | (p[-1] if p else 0)
        if p in at:
            units[block[p]] = at[p] | 0x80000000
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + pool


def plain_normalised(text: str, entries: dict[str, str], squeeze: bool) -> tuple[bytes, list[int]]:
    """Character by character: bytes and, for each, the source byte."""
    out, at = [], 0
    raw = text.encode()
    keys = sorted((k.encode() for k in entries), key=len, reverse=True)
    while at < len(raw):
        key = next((k for k in keys if raw.startswith(k, at)), None)
        if key is None:
            n = next(n for n in range(1, 5) if at + n == len(raw) or raw[at + n] & 0xC0 != 0x80)
            piece, step = raw[at : at + n], n
        else:
            piece, step = entries[key.decode()].encode(), len(key)
        out += [(b, at) for b in piece]
        at += step
    if squeeze:
        kept = [x for i, x in enumerate(out) if x[0] != 32 or (i and out[i - 1][0] != 32)]
        while kept and kept[-1][0] == 32:
            kept.pop()
        out = kept
    if out:
        out = [(32, out[0][1]), *out]
    return bytes(b for b, _ in out), [s for _, s in out]


def test_compiled_map_and_alignment():
    entries = {"ﬁ": "fi", "A": "a", "AB": "(ab)", "é": "e", "\t": " ", "ABC": "", "…": "...", "　": " "}
    model = pieces.load(pieces.MODEL)
    own = pieces.Model.__new__(pieces.Model)
    own.__dict__ = {**model.__dict__, "map": pieces.CharacterMap(compiled(entries))}
    rng = random.Random(7)
    texts = ["", "ABC", "AB", "ABABC", "\t\t", "ﬁné… AB", " x　 y "] + ["".join(rng.choice(["A", "B", "C", "ﬁ", "é", "…", " ", "\t", "x", "漢", "　"]) for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    for squeeze in (False, True):
        own.squeeze = squeeze
        for i, j, data, offsets in text_chunks(pa.array(texts)):
            got, bounds, source = own.normalised(data, offsets)
            for k in range(j - i):
                want, places = plain_normalised(texts[i + k], entries, squeeze)
                assert got[bounds[k] : bounds[k + 1]].tobytes() == want
                assert (source[bounds[k] : bounds[k + 1]] - offsets[k]).tolist() == places
            ids, ends, first = own.encode(data, offsets)
            for k in range(j - i):
                mine = ends[first[k] : first[k + 1]] - offsets[k]
                assert (np.diff(mine) >= 0).all() and (not len(mine) or mine[-1] == len(texts[i + k].encode()))


def test_long_words_merge_as_short_ones():
    model = pieces.load(pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(pieces.MODEL))
    rng = random.Random(3)
    for n in (20, 24, 25, 26, 60, 5_000):
        text = "".join(rng.choice("etaoinshrdlu") for _ in range(n))
        data = np.frombuffer(text.encode(), np.uint8)
        assert model.encode(data, np.array([0, len(data)]))[0].tolist() == library.encode(text)


def test_empty_and_kept_columns(spark, no_docs):
    assert pieces.decode(pieces.encode(no_docs)).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5)], "id long, body string, ids int")
    row = pieces.encode(docs, text="body", keep=["id"]).first()
    assert set(row.asDict()) == {"id", "ids", "ends"} and row["ends"][-1] == 3
    assert pieces.encode(docs.withColumn("ends", F.lit(1)), text="body").columns == ["id", "body", "ids", "ends"]
