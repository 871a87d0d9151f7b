"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Text that people write costs few tokens under a byte-pair vocabulary; a random key costs a token for every one or two letters or
digits. Candidates are runs of key characters of any length; known digests and identifiers are set aside first, unless they are
assigned to a secret's name. A run passes as a whole, or by the stretch of its tokens that is least efficient (a key behind a name).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_file

#: Fixed patterns of the base scan; letters in either case are the ASCII ones.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the minimum can stand in the pattern
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: The method's candidates, and what it sets aside: digests of usual lengths, UUIDs, numbers joined by signs.
MIN_RUN = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")  # greedy, so whole runs
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\Z")
IDENTIFIER = re.compile(r"(?:[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}|[0-9+/_-]+)\Z")
#: Most letters and digits per token of a random run, and of a random stretch within a run.
VOCABULARY, RUN_RATIO, STRETCH_RATIO = "byte_bpe_50k.tiktoken", 2.0, 1.7
#: Runs are encoded in pieces of so many characters, so that the cost stays in proportion to their length.
_PIECE = 2048
_encoders: dict[str, object] = {}


def _encoder(name: str):
    if name not in _encoders:
        import tiktoken

        with open(tokenizer_file(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=r"""\p{N}{1,3}|\p{L}+|[^\s\p{L}\p{N}]+|\s+""", mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def tokens_of(run: str, encoder) -> list[tuple[int, bool]]:
    """(length, whether letters or digits) of the tokens of a run."""
    out = []
    for i in range(0, len(run), _PIECE):
        for part in encoder.decode_tokens_bytes(encoder.encode_ordinary(run[i : i + _PIECE])):
            out.append((len(part), part.isalnum()))
    return out


def random_stretch(run: str, encoder, ratio: float) -> tuple[int, int] | None:
    """Start and end, in the run, of what is random of it: the whole run, its least efficient stretch, or nothing."""
    tokens = tokens_of(run, encoder)
    own = [n for n, plain in tokens if plain]
    if not own or sum(own) <= ratio * len(own):
        return (0, len(run)) if own else None
    # The stretch of the largest sum of (ratio - length) over tokens of letters or digits.
    best, total, begin, at = (0.0, 0, 0), 0.0, 0, 0
    for i, (n, plain) in enumerate(tokens):
        if total <= 0:
            total, begin = 0.0, i
        total += (ratio - n) if plain else 0.0
        if total > best[0]:
            best = (total, begin, i + 1)
    a, b = best[1:]
    # A key may begin or end with a longer token, up to the next sign.
    while a > 0 and tokens[a - 1][1] and tokens[a - 1][0] <= 3:
        a -= 1
    while b < len(tokens) and tokens[b][1] and tokens[b][0] <= 3:
        b += 1
    own = [n for n, plain in tokens[a:b] if plain]
    at = sum(n for n, _ in tokens[:a])
    end = at + sum(n for n, _ in tokens[a:b])
    return (at, end) if end - at >= MIN_RUN and sum(own) <= min(ratio, STRETCH_RATIO) * len(own) else None


def scan(text: str, encoder, ratio: float) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) of every span in code points; the method judges all candidates, within base spans too."""
    assigned = [m for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    found = [(m.start(), 0, m.end()) for m in assigned]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    values = {m.start(2) for m in assigned}
    for m in CANDIDATE.finditer(text):
        if m.start() in values or not (DIGEST.match(m[0]) or IDENTIFIER.match(m[0])):
            if part := random_stretch(m[0], encoder, ratio):
                found.append((m.start() + part[0], 3, m.start() + part[1]))
    return sorted(found)


_OUT = pa.schema([("doc_id", pa.int64()), ("starts", pa.list_(pa.int64())), ("kinds", pa.list_(pa.string())), ("ends", pa.list_(pa.int64())), ("values", pa.list_(pa.string()))])


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, ratio: float = RUN_RATIO) -> DataFrame:
    """Per row of docs: doc_id and spans array<struct<start,kind,end,value>> by start, then kind (assign, access, hex, random).

    Positions are code points, ends exclusive; spans of different kinds may overlap, those of one kind don't. A null or empty text has no spans; null ids, repeated rows and repeated ids are
    kept as rows of their own; other columns of docs are ignored; an empty table gives no rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                spans = [scan(t, encoder, ratio) if t else [] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[s[0] for s in x] for x in spans], pa.list_(pa.int64())), pa.array([[KINDS[s[1]] for s in x] for x in spans], pa.list_(pa.string())), pa.array([[s[2] for s in x] for x in spans], pa.list_(pa.int64())), pa.array([[t[a:b] for a, _, b in x] for t, x in zip(texts, spans, strict=True)], pa.list_(pa.string()))], schema=_OUT)

    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, starts array<long>, kinds array<string>, ends array<long>, values array<string>")
    return found.select("doc_id", F.arrays_zip(F.col("starts").alias("start"), F.col("kinds").alias("kind"), F.col("ends").alias("end"), F.col("values").alias("value")).alias("spans"))
