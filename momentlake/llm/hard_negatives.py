"""Hard-negative mining over integer inner products, with spanning-tree bounds.

Anchors are sorted by label and cut into blocks; each block has a minimum spanning tree by distance. A candidate's score at an anchor
lies within the edge's length times the candidate's norm of its score at the parent anchor, so going down the tree every candidate has a
range of scores, and is scored anew only where that range reaches what the anchor still looks for: a score among its best of the same
label, or a score within a positive's window. Scores and bounds are of whole blocks against whole chunks of rows, in numpy.

The query set meets all rows in blocks: chunks of rows are dealt to groups, anchors' blocks are sent to every group once, and within a
group each block passes over all chunks, keeping only what may still be among its best. Per group and anchor a few rows remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Rows of a chunk, anchors of a block, and rows of a group of chunks.
CHUNK, BLOCK, GROUP = 8_192, 512, 1 << 20
#: Rows with a component beyond this, after scaling, take no part: a score times 100 could overflow 64 bits in 4,096 dimensions.
LARGEST = 1 << 22
_CHUNK = "part long, n int, dim int, ids binary, labels binary, vectors binary"
_BLOCK = "block long, n int, dim int, ids binary, labels binary, vectors binary, parent binary, edge binary"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("int"))


def usable_rows(embeddings: DataFrame, label: Column, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, label, q (integer components), one row per vec_id; written.

    Rows with a null id, label or vector, or with a component that is null, not finite, or beyond LARGEST after scaling, take no part. Of
    rows with one id, equal ones count once, and of different ones the smallest (label, components) counts.
    """
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > LARGEST / scale))
    rows = embeddings.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & label.isNotNull()).where(~odd)
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), quantised(F.col(vector), scale).alias("q")).alias("r"))
    return materialize(named.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.*"), "vectors")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    at = np.asarray(lists.offsets).astype(np.int64)
    values, sizes = np.asarray(lists.values)[at[0] : at[-1]], np.diff(at)
    if len(sizes) and (sizes == sizes[0]).all():
        return values.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), sizes.max(initial=0)), values.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of consecutive runs of at most `most` rows, full ones but for the last."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal held, rows
        table = pa.Table.from_batches(held).combine_chunks()
        now, rest = table.slice(0, size), table.slice(size)
        held, rows = rest.to_batches(), len(rest)
        q = now["q"].combine_chunks()
        return np.asarray(now["vec_id"]), np.asarray(now["label"]), _matrix(q.chunk(0) if isinstance(q, pa.ChunkedArray) else q)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows >= most:
            yield cut(most)
    if rows:
        yield cut(rows)


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for ids, labels, q in _runs(batches, size):
            row = [[part], [len(ids)], [q.shape[1]], [ids.tobytes()], [labels.tobytes()], [q.astype(np.int32).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int32()), pa.array(row[2], pa.int32()), *[pa.array(x, pa.binary()) for x in row[3:]]], names=["part", "n", "dim", "ids", "labels", "vectors"])

    return run


def spanning_tree(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order in which to visit the rows, each one's parent (as a place in that order, -1 for the root) and distance to it: a minimum spanning tree."""
    n, x = len(q), q.astype(np.float64)
    norms = (x * x).sum(axis=1)
    near, link = np.full(n, np.inf), np.full(n, -1)
    place, order, parent, edge = np.full(n, -1), [], [], []
    at = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))) if n else -1
    while at >= 0:
        place[at] = len(order)
        order.append(at)
        parent.append(place[link[at]] if link[at] >= 0 else -1)
        edge.append(np.sqrt(((x[at] - x[link[at]]) ** 2).sum()) if link[at] >= 0 else 0.0)
        away = np.maximum(norms + norms[at] - 2 * (x @ x[at]), 0)
        closer = (place < 0) & (away < near)
        near[closer], link[closer] = away[closer], at
        left = np.where(place < 0, near, np.inf)
        at = int(np.argmin(left)) if len(order) < n else -1
    return np.array(order, np.int64), np.array(parent, np.int32), np.array(edge)


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for ids, labels, q in _runs(batches, size):
            order, parent, edge = spanning_tree(q)
            row = [ids[order], labels[order], q[order].astype(np.int32), parent, edge]
            yield pa.RecordBatch.from_arrays([pa.array([(part << 33) + k], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([q.shape[1]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in row]], names=["block", "n", "dim", "ids", "labels", "vectors", "parent", "edge"])
            k += 1

    return run


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of consecutive rows as arrays; written."""
    return materialize(rows.mapInArrow(_chunks(chunk), _CHUNK), "chunks")


def anchor_blocks(anchors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of anchors that follow each other by label, each with its tree; written. A label that most anchors have spans several blocks."""
    return materialize(anchors.orderBy("label", "vec_id").mapInArrow(_blocks(block), _BLOCK), "anchors")


class _Block:
    """Anchors in tree order, and what each still looks for."""

    def __init__(self, row: dict) -> None:
        n, dim = row["n"], row["dim"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(n, dim)
        self.parent, self.edge = np.frombuffer(row["parent"], np.int32), np.frombuffer(row["edge"], np.float64)
        self.largest = float(np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        self.rescored = self.pairs = 0

    def score_ranges(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, object]]:
        """Going down the tree, per anchor: its place, the least and the greatest score of each row, and a function that gives exact scores.

        The function takes a mask of rows; what it gives narrows the ranges of the anchors below.
        """
        dim = min(q.shape[1], self.vectors.shape[1])
        norm = np.sqrt((q[:, :dim].astype(np.float64) ** 2).sum(axis=1))
        # Doubles are exact as long as scores are below 2^53; rounding of bounds is covered by one more.
        exact = np.float64 if self.largest * norm.max(initial=0) < 2**52 else np.int64
        rows, anchors = np.ascontiguousarray(q[:, :dim]).astype(exact), self.vectors[:, :dim].astype(exact)
        last_use = np.full(len(self.ids), -1)
        last_use[self.parent[self.parent >= 0]] = np.flatnonzero(self.parent >= 0)
        ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(len(self.ids)):
            p = int(self.parent[k])
            if p < 0:
                all_scores = (rows @ anchors[k]).astype(np.int64)
                low, high = all_scores.astype(np.float64), all_scores.astype(np.float64)
            else:
                reach = (self.edge[k] * (1 + 1e-12)) * norm + 1
                low, high = ranges[p][0] - reach, ranges[p][1] + reach
            self.pairs += len(ids)

            def score(wanted: np.ndarray, k: int = k, low: np.ndarray = low, high: np.ndarray = high) -> np.ndarray:
                found = (rows[wanted] @ anchors[k]).astype(np.int64)
                low[wanted] = high[wanted] = found
                self.rescored += len(found)
                return found

            yield k, low, high, score
            if last_use[k] > k:
                ranges[k] = (low, high)
            if p >= 0 and last_use[p] == k:
                del ranges[p]


def _best(ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:most]
    return ids[order], scores[order]


class _Positives(_Block):
    """The best rows of each anchor's own label so far."""

    schema = "anchor_id long, positive_id long, positive_score long"

    def __init__(self, row: dict, most: int) -> None:
        super().__init__(row)
        self.most = most
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]

    def meet(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        for k, low, high, score in self.score_ranges(ids, labels, q):
            known_ids, known = self.found[k]
            wanted = np.flatnonzero((labels == self.labels[k]) & (ids != self.ids[k]))
            # As many rows as are looked for surely reach the least of the best lower bounds.
            sure = np.partition(low[wanted], -self.most)[-self.most] if len(wanted) > self.most else -np.inf
            wanted = wanted[high[wanted] >= max(sure, known[-1] if len(known) == self.most else -np.inf)]
            if len(wanted):
                self.found[k] = _best(np.concatenate([known_ids, ids[wanted]]), np.concatenate([known, score(wanted)]), self.most)

    def rows(self) -> list[np.ndarray]:
        sizes = [len(f[0]) for f in self.found]
        return [np.repeat(self.ids, sizes), np.concatenate([f[0] for f in self.found]), np.concatenate([f[1] for f in self.found])]


class _Negatives(_Block):
    """Of each positive's window, the best rows of other labels so far."""

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def __init__(self, row: dict, most: int) -> None:
        super().__init__(row)
        self.most = most
        counts = np.frombuffer(row["n_windows"], np.int32)
        at = np.concatenate([[0], np.cumsum(counts)])
        cut = lambda name: [np.frombuffer(row[name], np.int64)[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.positives, self.scores, self.lows, self.highs = cut("positives"), cut("scores"), cut("lows"), cut("highs")
        self.found = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in p] for p in self.positives]

    def meet(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        for k, low, high, score in self.score_ranges(ids, labels, q):
            other, wanted = labels != self.labels[k], np.zeros(len(ids), bool)
            for (_, known), a, b in zip(self.found[k], self.lows[k], self.highs[k], strict=True):
                # A window is full once the worst of its best is known.
                wanted |= (high >= (max(a, known[-1]) if len(known) == self.most else a)) & (low <= b)
            wanted = np.flatnonzero(wanted & other)
            if not len(wanted):
                continue
            scores = score(wanted)
            for j, (a, b) in enumerate(zip(self.lows[k], self.highs[k], strict=True)):
                fits = (scores >= a) & (scores <= b)
                if fits.any():
                    known_ids, known = self.found[k][j]
                    self.found[k][j] = _best(np.concatenate([known_ids, ids[wanted[fits]]]), np.concatenate([known, scores[fits]]), self.most)

    def rows(self) -> list[np.ndarray]:
        per = [[len(f[0]) for f in found] for found in self.found]
        flat = [f for found in self.found for f in found]
        sizes = np.array([s for p in per for s in p], np.int64)
        windows = np.repeat(self.ids, [len(p) for p in per])
        spread = lambda parts: np.repeat(np.concatenate(parts) if parts else np.zeros(0, np.int64), sizes)
        empty = [np.zeros(0, np.int64)]
        return [np.repeat(windows, sizes), spread(self.positives), spread(self.scores), np.concatenate([f[0] for f in flat] or empty), np.concatenate([f[1] for f in flat] or empty)]


def _search(kind: type, most: int):
    names = [f.split()[0] for f in kind.schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != at:
                    if block is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.rows()], names=names)
                    block, at = kind(row, most), row["block"]
                q = np.frombuffer(row["c_vectors"], np.int32).reshape(row["c_n"], row["c_dim"])
                block.meet(np.frombuffer(row["c_ids"], np.int64), np.frombuffer(row["c_labels"], np.int64), q)
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.rows()], names=names)

    return run


def _met(blocks: DataFrame, chunks: DataFrame, groups: int, kind: type, most: int) -> DataFrame:
    """Per group of chunks, what each block finds in it. Blocks are sent to every group once; a block's chunks follow each other."""
    dealt = chunks.select((F.col("part") % groups).alias("group"), *[F.col(c).alias(f"c_{c}") for c in ("n", "dim", "ids", "labels", "vectors")])
    sent = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("group", F.col("group").cast("long"))
    return sent.hint("merge").join(dealt.hint("merge"), "group").drop("group").mapInArrow(_search(kind, most), kind.schema)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk: int = CHUNK, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows (vec_id, label, q) come from usable_rows; anchors are some of them. An anchor's positives are its first `positives` other rows of the
    same label by score, then id; the negatives of each are the first `negatives` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score. Anchors without positives, and positives without negatives,
    give no rows. Vectors of different lengths are compared as if the shorter ended in zeros. Empty tables give no rows.
    """
    chunks, blocks = chunked(rows, chunk), anchor_blocks(anchors, block)
    groups = max(1, -(-rows.count() // group), min(chunks.count(), rows.sparkSession.sparkContext.defaultParallelism))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = _met(blocks, chunks, groups, _Positives, positives)
    first = materialize(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives).drop("n"), "positives")
    # The smallest and the greatest integer score of each window, in integers.
    bounds = first.withColumns({"low": F.expr(f"({low} * positive_score + pmod(-{low} * positive_score, 100)) div 100"), "high": F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100")})
    windows = _with_windows(blocks, bounds)
    of_positive = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = _met(windows, chunks, groups, _Negatives, negatives)
    out = found.withColumn("rank", F.row_number().over(of_positive)).where(F.col("rank") <= negatives)
    release(first)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _with_windows(blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """Blocks with the windows of their anchors' positives, in the anchors' order; written."""
    places = blocks.mapInArrow(_places, "block long, at int, anchor_id long")
    listed = places.hint("merge").join(bounds.hint("merge"), "anchor_id").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "positive_id", "positive_score", "low", "high"))).alias("windows"))
    joined = blocks.hint("merge").join(listed.hint("merge"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _BLOCK.split(", ")]
        for batch in batches:
            columns: list[list[bytes]] = [[], [], [], [], []]
            for n, windows in zip(batch.column("n").to_pylist(), batch.column("windows"), strict=True):
                w = windows.values
                columns[0].append(np.bincount(np.asarray(w.field("at")), minlength=n).astype(np.int32).tobytes())
                for i, name in enumerate(("positive_id", "positive_score", "low", "high")):
                    columns[i + 1].append(np.asarray(w.field(name)).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(c, pa.binary()) for c in columns]], names=[*names, "n_windows", "positives", "scores", "lows", "highs"])

    return materialize(joined.mapInArrow(run, f"{_BLOCK}, n_windows binary, positives binary, scores binary, lows binary, highs binary"), "windows")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where in its block each anchor stands."""
    for batch in batches:
        for block, ids in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            found = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(found)], names=["block", "at", "anchor_id"])
