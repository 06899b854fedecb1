"""Hard negatives for anchor frames by a vertical scan over feature vectors.

The recorder's vectors are the feature frames of its denoiser (``frame_id``, ``clip_id``, ``bands``: one value per
band).  An anchor frame's positives are the frames of its own clip that resemble it most; its hard negatives
are frames of other clips that score nearly as high.  Any table with an integer id, an integer group and
a column of numbers serves.

Method: BOND, a branch-and-bound scan over decomposed vectors.  Blocks hold their vectors by dimension, with
each dimension's least and greatest value.  An anchor reads dimensions in descending order of its own
magnitudes.  What the dimensions still unread can add at least and at most turns each partial sum into an interval;
candidates whose interval misses every score that still counts leave the bitmap, until the sums
that are left are exact.  First the best scores of the anchor's own group are found so, then, for each of
them, the best scores of other groups inside its window.

Anchors go in passes of a bounded number of components, which every task holds; blocks stay where they are and
are read again by each pass.  Bounds rise from block to block within a task, which sends its best rows only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import ranks, shared_table
from cliploom.session import durable_dir

SCALE = 256
EVERY = 100
POSITIVES = 5
NEGATIVES = 5
AT_LEAST = 80  # percent of the positive's score
BLOCK = 2048  # vectors of a block
BLOCK_CELLS = 1 << 20  # components of a block
PASS_CELLS = 1 << 22  # components of the anchors of one pass: the bound of what is broadcast
FIRST_DIMS = 8  # dimensions read before the first look at the bounds; the number doubles
EXACT = 2**53
LONGEST = 2**63 - 1


def whole_frames(frames: DataFrame, id_column: str, group_column: str, vector_column: str, scale: int) -> DataFrame:
    """``frame_id, clip_id, dim, v`` (floor(scale * x)) of the rows that take part."""
    v = F.transform(vector_column, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    there = F.col(id_column).isNotNull() & F.col(group_column).isNotNull() & F.col(vector_column).isNotNull()
    return frames.where(there).where(fine).select(
        F.col(id_column).cast("long").alias("frame_id"), F.col(group_column).cast("long").alias("clip_id"),
        F.size(vector_column).alias("dim"), F.transform(v, lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))


def column_blocks(vectors: DataFrame) -> DataFrame:
    """``dim, ids, clips, data``: runs of rows in order of (dim, clip_id, frame_id), by dimension."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["dim", "clip_id", "frame_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, clips, dims = (batch.column(c).to_numpy() for c in ("frame_id", "clip_id", "dim"))
            flat, ends = batch.column("v").flatten().to_numpy(), np.cumsum(dims.astype(np.int64))
            at = 0
            while at < len(ids):
                dim = int(dims[at])
                stop = min(at + min(BLOCK, max(1, BLOCK_CELLS // max(dim, 1))), int(np.searchsorted(dims, dim, side="right")))
                data = flat[ends[at] - dim : ends[stop - 1]].reshape(stop - at, dim)
                most = int(max(abs(int(data.max())), abs(int(data.min())))) if data.size else 0
                kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
                yield pa.RecordBatch.from_arrays([
                    pa.array([dim], pa.int32()), pa.array([ids[at:stop].tobytes()], pa.binary()), pa.array([clips[at:stop].tobytes()], pa.binary()),
                    pa.array([np.ascontiguousarray(data.T).astype(kind).tobytes()], pa.binary())], names=["dim", "ids", "clips", "data"])
                at = stop

    dealt = vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(pack, "dim int, ids binary, clips binary, data binary")


class Block:
    """Vectors by dimension; sums are exact in floating point, or else made with unbounded integers."""

    def __init__(self, row: dict, most: int):
        self.ids, self.clips = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["clips"], np.int64)
        n, dim = len(self.ids), row["dim"]
        kind = {2: "<i2", 4: "<i4", 8: "<i8"}[len(row["data"]) // (n * dim)] if dim else "<i2"
        whole = np.frombuffer(row["data"], kind).reshape(dim, n)
        top = max(abs(int(whole.max())), abs(int(whole.min()))) if dim else 0
        self.kind = np.float64 if top * most * max(dim, 1) < EXACT else object
        self.columns = whole.astype(np.int64).astype(self.kind)
        self.least, self.greatest = (whole.min(1).astype(np.int64).astype(self.kind), whole.max(1).astype(np.int64).astype(self.kind)) if dim else (np.zeros(0), np.zeros(0))

    def bounds(self, q: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the dimensions from each place of the order on can add at least and at most, for every anchor."""
        a, b = q * self.least, q * self.greatest
        end = np.zeros((len(q), 1), self.kind)
        low, high = (np.take_along_axis(f(a, b), order, 1)[:, ::-1].cumsum(1)[:, ::-1] for f in (np.minimum, np.maximum))
        return np.concatenate([low, end], 1), np.concatenate([high, end], 1)

    def scan(self, q: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray, need, top) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the rows in the bitmap ``alive`` that score from ``need`` to ``top``."""
        if not alive.any() or high[0] < need or low[0] > top:
            return np.zeros(0, np.int64), np.zeros(0, self.kind)
        at = np.flatnonzero(alive)
        sums = np.zeros(len(at), self.kind)
        done, step = 0, FIRST_DIMS
        while done < len(q):
            dims = order[done : done + step]
            columns = self.columns[dims] if len(at) == len(self.ids) else self.columns[np.ix_(dims, at)]
            sums = sums + q[dims] @ columns
            done, step = done + len(dims), done + len(dims)
            keep = ((sums + high[done] >= need) & (sums + low[done] <= top)).astype(bool)
            if not keep.all():
                at, sums = at[keep], sums[keep]
                if not len(at):
                    break
        if not len(q):
            keep = (sums >= need) & (sums <= top)
            at, sums = at[keep.astype(bool)], sums[keep.astype(bool)]
        return at, sums


def _clipped(scores: np.ndarray) -> np.ndarray:
    return scores.astype(np.int64) if scores.dtype == np.float64 else np.array([max(-LONGEST, min(LONGEST, int(s))) for s in scores], np.int64)


class Best:
    """The best scores so far of every place, highest first, ties by the smaller id."""

    def __init__(self, shape: tuple[int, ...], k: int):
        self.k = k
        self.scores = np.full((*shape, k), -LONGEST - 1, np.int64)
        self.ids = np.zeros((*shape, k), np.int64)
        self.count = np.zeros(shape, np.int64)

    def floor(self, at):
        """The score that a row must reach to count at a place."""
        return int(self.scores[at][-1]) if self.count[at] == self.k else -float("inf")

    def add(self, at, scores: np.ndarray, ids: np.ndarray) -> None:
        n = self.count[at]
        scores, ids = np.concatenate([self.scores[at][:n], scores]), np.concatenate([self.ids[at][:n], ids])
        best = np.lexsort((ids, -scores))[: self.k] if (scores > -LONGEST - 1).all() else np.arange(0)
        n = len(best)
        self.scores[at][:n], self.ids[at][:n], self.count[at] = scores[best], ids[best], n


class Anchors:
    """The anchors of one pass, of one number of dimensions."""

    def __init__(self, ids: np.ndarray, clips: np.ndarray, v: np.ndarray):
        self.ids, self.clips, self.v = ids, clips, v
        self.order = np.argsort(-np.abs(v.astype(np.float64)), axis=1, kind="stable")
        self.most = max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0


def _arranged(table: pa.Table) -> dict[int, Anchors]:
    out = {}
    dims, ids, clips = (table.column(c).to_numpy() for c in ("dim", "frame_id", "clip_id"))
    flat, ends = table.column("v").combine_chunks().flatten().to_numpy(), np.cumsum(dims.astype(np.int64))
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        cells = flat[(ends[at] - dim)[:, None] + np.arange(dim)[None, :]].reshape(len(at), dim)
        out[dim] = Anchors(ids[at], clips[at], cells)
    return out


def _own(batches: Iterator[pa.RecordBatch], anchors: dict[int, Anchors], k: int) -> Iterator[pa.RecordBatch]:
    """Best rows of each anchor's own group among the blocks of a task."""
    best = {dim: Best((len(a.ids),), k) for dim, a in anchors.items()}
    for batch in batches:
        for row in batch.to_pylist():
            a = anchors.get(row["dim"])
            if a is None:
                continue
            block = Block(row, a.most)
            begin, end = np.searchsorted(block.clips, a.clips, side="left"), np.searchsorted(block.clips, a.clips, side="right")
            asked = np.flatnonzero(end > begin)
            if not len(asked):
                continue
            q = a.v[asked].astype(block.kind)
            low, high = block.bounds(q, a.order[asked])
            for i, x in enumerate(asked.tolist()):
                alive = np.zeros(len(block.ids), bool)
                alive[begin[x] : end[x]] = True
                alive &= block.ids != a.ids[x]
                at, scores = block.scan(q[i], a.order[x], low[i], high[i], alive, best[row["dim"]].floor(x), float("inf"))
                if len(at):
                    best[row["dim"]].add(x, _clipped(scores), block.ids[at])
    for dim, a in anchors.items():
        found = best[dim]
        there = np.arange(k)[None, :] < found.count[:, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(a.ids, found.count)), pa.array(found.ids[there]), pa.array(found.scores[there])],
            names=["anchor_id", "positive_id", "positive_score"])


def _others(batches: Iterator[pa.RecordBatch], anchors: dict[int, Anchors], found: dict[int, list[tuple[int, int]]], k: int,
            at_least: int) -> Iterator[pa.RecordBatch]:
    """Best rows of other groups inside the window of each anchor's positives, among the blocks of a task."""
    best, windows = {}, {}
    for dim, a in anchors.items():
        # (place, lowest score, highest score); ceil(at_least * p / 100) in whole numbers, empty below zero
        windows[dim] = [[(n, -(-at_least * p // 100), p) for n, (_, p) in enumerate(found.get(int(i), [])) if p >= 0] for i in a.ids]
        best[dim] = Best((len(a.ids), max([len(found.get(int(i), [])) for i in a.ids], default=0)), k)
    for batch in batches:
        for row in batch.to_pylist():
            a = anchors.get(row["dim"])
            if a is None:
                continue
            block, held = Block(row, a.most), best[row["dim"]]
            same = np.searchsorted(block.clips, a.clips, side="left"), np.searchsorted(block.clips, a.clips, side="right")
            mixed = same[1] - same[0] < len(block.ids)
            asked = np.array([x for x in np.flatnonzero(mixed).tolist() if windows[row["dim"]][x]], np.int64)
            if not len(asked):
                continue
            q = a.v[asked].astype(block.kind)
            low, high = block.bounds(q, a.order[asked])
            for i, x in enumerate(asked.tolist()):
                open_ = [(n, max(lo, held.floor((x, n))), p) for n, lo, p in windows[row["dim"]][x]]
                alive = block.ids != a.ids[x]
                alive[same[0][x] : same[1][x]] = False
                top = max(o[2] for o in open_)  # at the limit of 64 bits any higher sum counts as it
                at, scores = block.scan(
                    q[i], a.order[x], low[i], high[i], alive, min(o[1] for o in open_), top if top < LONGEST else float("inf"))
                if not len(at):
                    continue
                scores = _clipped(scores)
                for n, lo, p in open_:
                    inside = (scores >= lo) & (scores <= p)
                    if inside.any():
                        held.add((x, n), scores[inside], block.ids[at[inside]])
    for dim, a in anchors.items():
        x, n, r = np.nonzero(np.arange(k)[None, None, :] < best[dim].count[:, :, None])
        pairs = [found[int(i)][m] for i, m in zip(a.ids[x], n, strict=True)]
        yield pa.RecordBatch.from_arrays([
            pa.array(a.ids[x]), pa.array(n + 1, pa.int32()), pa.array([p for p, _ in pairs], pa.int64()), pa.array([s for _, s in pairs], pa.int64()),
            pa.array(best[dim].ids[x, n, r]), pa.array(best[dim].scores[x, n, r])],
            names=["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])


def hard_negatives(frames: DataFrame, id_column: str = "frame_id", group_column: str = "clip_id", vector_column: str = "bands",
                   every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, at_least: int = AT_LEAST,
                   scale: int = SCALE) -> DataFrame:
    """``anchor_id, place, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the frames whose id is divisible by ``every``.  A frame's score is its integer inner product with the
    anchor, of components floor(scale * x).  An anchor's ``positives`` are the best other frames of its clip, with
    ``place`` from 1; for each, the best ``negatives`` frames of other clips that score at least ``at_least``
    percent of the positive's score and no more than it get a ``rank`` from 1.  Higher scores come first, ties
    by the smaller id; where there are fewer frames, all of them.  A positive of negative score has no negatives.

    Rows whose id, clip or vector is null, or that hold null or non-finite components, take no part.  Only vectors
    of one length are compared; empty ones score 0.  Rows that repeat an id are candidates of their own, none of
    them for an anchor of that id, and one of them, the first by its numbers, is the anchor.  Components and scores
    beyond 64 bits end at the limits of these.  Other columns are not read.
    """
    spark = frames.sparkSession
    vectors = shared_table(whole_frames(frames, id_column, group_column, vector_column, scale), "frames")
    blocks = shared_table(column_blocks(vectors), "column-blocks")
    first = vectors.where(F.col("frame_id") % every == 0).groupBy("frame_id").agg(F.min(F.struct("clip_id", "v", "dim")).alias("a"))
    widest = vectors.agg(F.max("dim")).first()[0] or 1
    asked = ranks(first.select("frame_id", "a.clip_id", "a.dim", "a.v"), ["frame_id"], "anchors")
    per_pass = max(1, PASS_CELLS // max(widest, 1))
    folder = f"{durable_dir(spark).rstrip('/')}/hard-negatives-{uuid.uuid4().hex}"
    fields = "anchor_id long, place int, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    by_pair = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    by_anchor = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    n_anchors = asked.count()
    for number in range(-(-n_anchors // per_pass)):
        part = asked.where((F.col("rank") >= number * per_pass) & (F.col("rank") < (number + 1) * per_pass))
        anchors = spark.sparkContext.broadcast(_arranged(part.drop("rank").toArrow()))
        own = blocks.mapInArrow(
            lambda b, anchors=anchors: _own(b, anchors.value, positives), "anchor_id long, positive_id long, positive_score long")
        near = own.withColumn("at", F.row_number().over(by_anchor)).where(F.col("at") <= positives)
        found: dict[int, list[tuple[int, int]]] = {}
        for row in near.orderBy("anchor_id", "at").toLocalIterator():  # so many for each anchor of the pass
            found.setdefault(row["anchor_id"], []).append((row["positive_id"], row["positive_score"]))
        known = spark.sparkContext.broadcast(found)
        others = blocks.mapInArrow(
            lambda b, anchors=anchors, known=known: _others(b, anchors.value, known.value, negatives, at_least),
            "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
        best = others.withColumn("rank", F.row_number().over(by_pair)).where(F.col("rank") <= negatives)
        best.select(*[f.split()[0] for f in fields.split(", ")]).write.parquet(f"{folder}/pass={number}")
        anchors.unpersist()
        known.unpersist()
    if not n_anchors:
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(*[f"{folder}/pass={n}" for n in range(-(-n_anchors // per_pass))])
