from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

from momentlake.llm import packing
from momentlake.llm.common import tokenizer_file


def expected_ids(texts):
    t = Tokenizer.from_file(tokenizer_file(packing.TOKENIZER))
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(docs, pieces, length):
    """Every id lies in one piece, offsets have no gaps, and only the last sequence is short."""
    want = sorted(map(tuple, expected_ids([r["text"] for r in docs.collect()])))
    seqs: dict[int, list] = {}
    parts: dict[tuple, list] = {}
    for r in pieces:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
        parts.setdefault((r["sequence_id"] * length + r["offset"] - r["start"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    got = []
    for (_, total), found in parts.items():
        ids = np.frombuffer(b"".join(b for _, b in sorted(found)), "<u4")
        assert len(ids) == total
        got.append(tuple(ids.tolist()))
    assert sorted(got) == want
    fills = []
    for s in sorted(seqs):
        at = 0
        for offset, n, ids in sorted(seqs[s]):
            assert offset == at and len(ids) == 4 * n
            at += n
        fills.append(at)
    assert sorted(seqs) == list(range(len(seqs))) and all(f == length for f in fills[:-1])


def test_round_trip(spark, odd_docs):
    for length in (7, 4096):
        check(odd_docs, packing.pack_documents(odd_docs.repartition(3), length=length).collect(), length)


def test_special_and_unicode_texts(spark):
    texts = ["<|endoftext|> a<|startoftext|>b", "é ́x  y\u0085z \x1c1\x1f2", "İΣ ΑΣ don't we'll 123 ½!?", "﻿ tab\tnl\nvt\x0bff\x0c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs, packing.pack_documents(docs, length=16).collect(), 16)


def test_empty(spark, no_docs):
    assert packing.pack_documents(no_docs).count() == 0


def test_sequences_and_boundary_records(spark, odd_docs):
    pieces = packing.pack_documents(odd_docs, length=64)
    rows = packing.sequences(pieces).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 256 for r in rows)
    for r in pieces.collect():
        assert r["continues"] == (r["start"] > 0) and r["goes_on"] == (r["start"] + r["length"] < r["doc_tokens"])
