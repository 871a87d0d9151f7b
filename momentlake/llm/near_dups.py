"""Near-duplicate groups by banded MinHash with sequential Bayesian verification.

1. One scan hashes every text into its set of word shingles and writes the set's size, a 128-bit hash of it and its MinHash
   signature. Texts with equal sets form a class; the class's smallest doc_id represents it, and only it goes on.
2. Bands of the signature are grouped. A band bucket's pairs aren't listed: each member is compared with two centres of its
   bucket. So a group of many near copies costs a star. Buckets whose members still lie in different
   components are left; their members are paired by a shared shingle among their rarest ones. A pair at the threshold must share
   one within its first 20 % (longer text) and 11 % (shorter text) in any fixed order, at places that leave room for the overlap
   it needs, so no link is lost, while texts that share a frequent passage but differ elsewhere aren't paired at all.
3. A pair's signatures are compared batch by batch. After each, the posterior of the similarity (uniform prior) tells whether the
   chance that it reaches the threshold is below `miss`; then the pair is dropped. Survivors are verified on their full sets.
4. Links become components (large-star, small-star).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, release, shingle_hashes, text_chunks, word_hashes
from .components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 5 values: a pair at similarity 0.8 shares no band with probability (1 - 0.8^5)^32 = 3e-6.
BANDS, ROWS = 32, 5
#: Values compared at a time, and the posterior chance below which a pair is dropped.
BATCH, MISS = 32, 1e-6
#: About how many texts are compared with one copy of their centre.
PART_SIZE = 64
#: Values a scan holds at once: shingles times hash functions.
_TILE = 4096


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (seeds >> np.uint64(32)).astype(np.uint32), (seeds.astype(np.uint32) | np.uint32(1))


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """Minimum of n hash functions over a set of shingle hashes."""
    flip, factor = hash_family(n)
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _TILE // 8):
        x = (low[None, at : at + _TILE // 8] ^ flip[:, None]) * factor[:, None]
        np.minimum(out, (x ^ (x >> np.uint32(15))).min(axis=1), out=out)
    return out


def least_matches(n_values: int, batch: int, similarity: float, miss: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on): with m of n matching, P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(batch, n_values + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append((n, m))
    return out


_SCAN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())])


def _scan(k: int, n_values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(2)):
                words, first = word_hashes(data, offsets)
                n, sums, sigs = [], [], []
                for d in range(j - i):
                    own = np.unique(shingle_hashes(words[first[d] : first[d + 1]], k))
                    n.append(len(own))
                    sums.append((own.sum(dtype=np.uint64), mix64(own ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)))
                    sigs.append(signature(own, n_values).tobytes() if len(own) else None)
                both = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sigs, pa.binary())], schema=_SCAN)

    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, bands, rows).astype(np.uint64)
                h = np.broadcast_to(salt, (len(sig), bands)).copy()
                for r in range(rows):
                    h = mix64(h * np.uint64(31) + sig[:, :, r])
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(part.column(0)), bands))], names=["bucket", "id"])

    return run


def _prune(steps: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in (2, 3))
            alive, done, matches = np.arange(batch.num_rows), 0, np.zeros(batch.num_rows, int)
            for n, least in steps:
                matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
                keep = matches >= least
                alive, matches, done = alive[keep], matches[keep], n
            yield batch.select([0, 1]).take(pa.array(alive))

    return run


def _verify(k: int, percent: int):
    """Rows (hub, part, leaf, text) in order of hub, part and leaf, the hub's own text first, without a leaf: pairs that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            is_hub, good = np.asarray(pa.compute.is_null(batch.column(2))), []
            for i, j, data, offsets in text_chunks(batch.column(3)):
                words, first = word_hashes(data, offsets)
                for d in range(j - i):
                    here = np.unique(shingle_hashes(words[first[d] : first[d + 1]], k))
                    if is_hub[i + d]:
                        own = here
                        continue
                    both = len(np.intersect1d(own, here, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(here) - both):
                        good.append(i + d)
            rows = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows)], names=["a", "b"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(2)):
                words, first = word_hashes(data, offsets)
                sets = [np.unique(shingle_hashes(words[first[d] : first[d + 1]], k)).view(np.int64) for d in range(j - i)]
                sizes = [len(x) for x in sets]
                row = pa.array(np.repeat(np.arange(i, j), sizes))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["id", "comp", "n", "g"])

    return run


def rare_shingle_pairs(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of texts (id, comp, text) of different components that may reach the threshold, by prefix filtering.

    Shingles are ordered by how many of these texts have them. Those of a single text come first and pair nothing, so only shared
    ones are ranked, after them.
    """
    own = materialize(texts.select("id", "comp", "text").mapInArrow(_sets(k), "id long, comp long, n long, g long"), "shingles")
    shared = own.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    each = Window.partitionBy("id")  # one text's shingles
    ranked = own.join(shared.hint("rebalance").hint("shuffle_merge"), "g").select("id", "comp", "n", "g", (F.col("n") - F.count("*").over(each) + F.row_number().over(each.orderBy("df", "g"))).alias("at"))
    n = F.col("n")
    prefix = materialize(ranked.where(F.col("at") <= n - F.ceil(n * percent / 100) + 1), "prefix")
    release(own)
    x, y = (prefix.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "comp", "n", "at")]) for s in "xy")
    y = y.where(F.col("at_y") <= F.col("n_y") - F.ceil(F.col("n_y") * (2 * percent) / (100 + percent)) + 1)
    longer = (F.col("n_x") > F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") > F.col("id_y")))
    room = (1 + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))) * (100 + percent) >= percent * (F.col("n_x") + F.col("n_y"))
    met = (x.g == y.g) & (F.col("comp_x") != F.col("comp_y")) & longer & (100 * F.col("n_y") >= percent * F.col("n_x")) & room
    return x.join(y.hint("shuffle_merge"), met).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))


def _linked(pairs: DataFrame, members: DataFrame, steps: list[tuple[int, int]], k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that hold: dropped on signatures where hopeless, then compared as full sets.

    The texts of a's partners are dealt into parts of about PART_SIZE; a's own text goes once to each part, not to each pair.
    """
    both = pairs
    for side in ("a", "b"):
        both = both.join(members.select(F.col("id").alias(side), F.col("sig").alias(f"sig_{side}")).hint("shuffle_merge"), side)
    left = materialize(both.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(steps), "a long, b long"), "pairs")
    hubs = materialize(left.groupBy("a").agg(F.ceil(F.count("*") / PART_SIZE).cast("long").alias("parts")), "hubs")
    text = members.select(F.col("id"), "text")
    leaves = left.join(hubs.hint("shuffle_merge"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b").join(text.withColumnRenamed("id", "b").hint("shuffle_merge"), "b")
    heads = hubs.join(text.withColumnRenamed("id", "a").hint("shuffle_merge"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(leaves.select("a", "part", "b", "text")).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    out = materialize(rows.mapInArrow(_verify(k, percent), "a long, b long"), "links")
    for done in (left, hubs):
        release(done)
    return out


def _classes(real: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct set: keys, did and th (the smallest id that has it, and its text's hash), sig, id (a key of its own); written.

    The key is did; of several sets with one did, which repeated ids with different texts bring about, all but one get a hash.
    """
    least = real.groupBy(*keys).agg(F.min(F.struct("doc_id", "th")).alias("f"), F.any_value("sig").alias("sig"))
    classes = materialize(least.select(*keys, F.col("f.doc_id").alias("did"), "f.th", "sig", F.col("f.doc_id").alias("id")), "classes")
    shared = classes.groupBy("did").agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2")).alias("one")).where("n > 1").select("did", "one")
    shared = materialize(shared, "shared")
    if shared.isEmpty():
        release(shared)
        return classes
    key = F.when(F.col("one").isNull() | (F.col("one") == F.struct("h1", "h2")), F.col("did")).otherwise(F.xxhash64("did", "h1", "h2"))
    out = materialize(classes.join(shared.hint("shuffle_merge"), "did", "left").withColumn("id", key).drop("one"), "classes")
    for done in (classes, shared):
        release(done)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, batch: int = BATCH, miss: float = MISS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Words are runs without ASCII white space, A-Z lowered; a text's set is its distinct `shingle`-word windows, with fewer words the
    whole sequence as one. Null, empty and blank texts have no set and are linked with nothing. Rows with a null id are returned,
    unlinked, kept, with a null component. Repeated rows get the same answer each; the texts of a repeated id are compared each for
    itself, and each row has the answer of its own text. Other columns are ignored; an empty table gives no rows.
    """
    return _near(docs, doc_id, text, shingle, similarity, bands, rows, batch, miss).select("doc_id", "n_shingles", "component_id", "kept")


def _near(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float, bands: int, rows: int, batch: int, miss: float) -> DataFrame:
    """near_duplicates with th, the hash of the text, and stays: whether this text stands for its group; written."""
    percent = round(100 * similarity)
    steps = least_matches(bands * rows, batch, similarity, miss)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    scanned = materialize(texts.mapInArrow(_scan(shingle, bands * rows), "doc_id long, th long, n_shingles long, h1 long, h2 long, sig binary"), "minhash")
    keys = ["n_shingles", "h1", "h2"]
    real = scanned.where("doc_id is not null and n_shingles > 0")
    classes = _classes(real, keys)

    spread = materialize(classes.select("id", "sig").mapInArrow(_bands(bands, rows), "bucket long, id long"), "bands")
    shared = spread.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last").select("bucket")
    buckets = materialize(spread.join(shared.hint("rebalance").hint("shuffle_merge"), "bucket", "left_semi"), "buckets")
    release(spread)
    involved = buckets.select("id").distinct()
    chosen = materialize(classes.join(involved.hint("shuffle_merge"), "id", "left_semi").select("id", "sig", F.col("did").alias("doc_id"), "th"), "chosen")
    members = materialize(texts.join(chosen.hint("shuffle_merge"), ["doc_id", "th"]).select("id", "sig", "text").dropDuplicates(["id"]), "members")
    release(chosen)

    # Aggregates are dealt anew before they join what they were made of, so that adaptive execution can split a hot bucket.
    # Stars: each member against the smallest id of its bucket, and against one picked by a hash.
    centres = buckets.groupBy("bucket").agg(F.min("id").alias("least"), F.max_by("id", F.xxhash64("id")).alias("other"))
    rays = buckets.join(centres.hint("rebalance").hint("shuffle_merge"), "bucket").select(F.explode(F.array_distinct(F.array("least", "other"))).alias("a"), F.col("id").alias("b")).where("a != b")
    links = _linked(rays.distinct(), members, steps, shingle, percent)
    component = connected_components(links)
    named = buckets.join(component.withColumnRenamed("node", "id").hint("shuffle_merge"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp"))
    mixed = named.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 != c2").select("bucket")
    left = materialize(named.join(mixed.hint("rebalance").hint("shuffle_merge"), "bucket", "left_semi").select("id", "comp").distinct(), "left")
    rest = materialize(rare_shingle_pairs(members.join(left.hint("shuffle_merge"), "id"), shingle, percent).distinct(), "rest")
    found = _linked(rest, members, steps, shingle, percent)
    if not found.isEmpty():
        component = connected_components(found.unionByName(component.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    mapped = materialize(classes.join(component.withColumnRenamed("node", "id").hint("shuffle_merge"), "id", "left").select(*keys, "did", "th", F.coalesce("component", "id").alias("comp")), "mapped")
    # The text that stands for a group is the smallest one by id and hash.
    first = mapped.groupBy("comp").agg(F.min(F.struct("did", "th")).alias("f"))
    mapped = mapped.select(*keys, "comp").join(first.hint("shuffle_merge"), "comp").select(*keys, F.col("f.did").alias("component_id"), F.col("f.th").alias("first_th"))
    joined = real.select("doc_id", "th", *keys).join(mapped.hint("shuffle_merge"), keys)
    grouped = joined.select("doc_id", "th", "n_shingles", "component_id", ((F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("first_th"))).alias("stays"))
    alone = scanned.where("doc_id is null or n_shingles = 0").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    out = materialize(grouped.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near")
    for done in (scanned, classes, buckets, members, left, rest, links, found):
        release(done)
    return out


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the texts that are near copies of one that stands for their group: that with the smallest id (and hash, in one id).

    All columns stay as they are. Rows are told apart by id and text: of a repeated id, texts unlike any other stay; rows equal in
    both stay or go together; rows without an id, and those without words, stay.
    """
    gone = _near(docs, doc_id, text, shingle, similarity, BANDS, ROWS, BATCH, MISS).where("not stays").select(F.col("doc_id").alias("_near_0"), F.col("th").alias("_near_1")).distinct()
    # Written, so that Spark knows its size and broadcasts it only below its threshold.
    return docs.join(materialize(gone, "gone"), (docs[doc_id].cast("long") == F.col("_near_0")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("_near_1")), "left_anti")
