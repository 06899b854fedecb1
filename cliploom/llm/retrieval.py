"""Exact top-k search by inner product over feature vectors.

The recorder's vectors are the feature frames of its denoiser (``frame_id``, ``bands``: one value per
band); any table with an integer id column and a column of numbers serves.

Method: norm-bucketed retrieval.  Vectors are grouped by length.  Each query first gets a threshold, its
k-th best score among a fixed number of the longest vectors.  A bucket whose longest vector cannot
reach the threshold is never paired with the query's block.  In a bucket the threshold becomes a
local bound on the cosine.  Where that is high, vectors are pruned by the query's largest coordinates
and a Cauchy-Schwarz bound on the rest (coordinate pruning), else by their length alone (length
pruning).  What is left is verified by integer products.

Buckets are runs of rows in order of their length, packed once and read where they lie.  Queries go in passes of
a bounded number of components, which every task holds: a task meets its buckets from the longest down, raises the
thresholds on the way and sends its best rows only.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import ranks, share_of, shared_table

SCALE = 64
BLOCK = 2048  # vectors of one bucket
BLOCK_CELLS = 1 << 20  # components of one bucket
PASS_CELLS = 1 << 22  # components of the queries of one pass, and of the longest vectors: the bound of what is broadcast
SEEDS = 4096  # of the longest vectors give the first thresholds
TOGETHER = 256  # queries of one matrix product
COSINE = 0.5  # local threshold from which coordinates prune
FOCUS = 8  # coordinates used then
CLASSES = 4  # length classes for each doubling of the squared norm
EXACT = float(2**53)


def whole_vectors(frames: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``frame_id, v`` (long array: floor(scale * x)), squared norm; only vectors of finite components."""
    v = F.transform(vector_column, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = frames.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).where(fine)
    return rows.select(
        F.col(id_column).cast("long").alias("frame_id"),
        F.transform(v, lambda x: F.floor(x * float(scale)).cast("long")).alias("v"),
    ).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).withColumn(
        "dim", F.size("v"))


def _class(norm2: Column) -> Column:
    return F.when(norm2 > 0, F.floor(F.log2(norm2) * CLASSES)).otherwise(-1).cast("int")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point only where every partial sum is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def buckets(vectors: DataFrame) -> DataFrame:
    """``dim, ids, data``: rows of about the same length, the longest first, by the row."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("dim"), F.col("norm2").desc(), F.col("frame_id")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims = batch.column("frame_id").to_numpy(), batch.column("dim").to_numpy()
            flat, ends = batch.column("v").flatten().to_numpy(), np.cumsum(dims.astype(np.int64))
            at = 0
            while at < len(ids):
                dim = int(dims[at])
                stop = min(at + min(BLOCK, max(1, BLOCK_CELLS // max(dim, 1))), int(np.searchsorted(dims, dim, side="right")))
                data = flat[ends[at] - dim : ends[stop - 1]]
                most = int(max(abs(int(data.max())), abs(int(data.min())))) if data.size else 0
                kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
                yield pa.RecordBatch.from_arrays([
                    pa.array([dim], pa.int32()), pa.array([ids[at:stop].tobytes()], pa.binary()),
                    pa.array([data.astype(kind).tobytes()], pa.binary())], names=["dim", "ids", "data"])
                at = stop

    dealt = vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(packed, "dim int, ids binary, data binary")


def _longest(vectors: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the longest vectors: whole length classes from the top, and a share of the next."""
    counts = vectors.groupBy("class").count().orderBy(F.desc("class")).collect()  # as many rows as doublings of length
    whole, left = [], most
    for row in counts:
        if row["count"] > left:
            part = (F.col("class") == row["class"]) & share_of(F.xxhash64("frame_id", F.lit(3)), left / row["count"])
            return vectors.where(F.col("class").isin(whole) | part)
        whole.append(row["class"])
        left -= row["count"]
    return vectors


def _by_dim(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of every number of components."""
    out = {}
    ids, dims = table.column("frame_id").to_numpy(), table.column("dim").to_numpy()
    flat, ends = table.column("v").combine_chunks().flatten().to_numpy(), np.cumsum(dims.astype(np.int64))
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        out[dim] = ids[at], flat[(ends[at] - dim)[:, None] + np.arange(dim)[None, :]].reshape(len(at), dim).astype(np.int64)
    return out


def _floors(batches: Iterator[pa.RecordBatch], longest: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The k-th best score of each query among the longest vectors; null where there are fewer."""
    for batch in batches:
        for dim, (ids, v) in _by_dim(pa.Table.from_batches([batch])).items():
            found: list[int | None] = [None] * len(ids)
            other, m = longest.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim), np.int64)))
            for at in range(0, len(ids), TOGETHER) if len(other) >= k else ():
                scores = _products(v[at : at + TOGETHER], m).astype(np.float64)
                scores[ids[at : at + TOGETHER, None] == other[None, :]] = -np.inf
                best = np.partition(scores, -k, axis=1)[:, -k]
                found[at : at + TOGETHER] = [None if np.isinf(x) else float(x) for x in best]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found, pa.float64())], names=["frame_id", "floor"])


class _Asked:
    """The queries of one pass, of one number of components, with their best rows so far."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, floors: dict[int, float | None], k: int):
        self.ids, self.v = ids, v
        self.norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        self.floor = np.array([-np.inf if floors.get(int(i)) is None else floors[int(i)] for i in ids])
        self.scores, self.found = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.count, self.k = np.zeros(len(ids), np.int64), k

    def need(self) -> np.ndarray:
        """The length from which on a vector can still reach each query's threshold."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((self.floor > 0) & (self.norm > 0), self.floor / self.norm, 0.0) * (1 - 1e-9)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """New rows (query's place, id, score), of any number for each query."""
        touched = np.unique(query)
        held = np.arange(self.k)[None, :] < self.count[touched][:, None]
        query = np.concatenate([query, np.repeat(touched, self.count[touched])])
        ids, scores = np.concatenate([ids, self.found[touched][held]]), np.concatenate([scores, self.scores[touched][held]])
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        best = place < self.k
        self.found[query[best], place[best]], self.scores[query[best], place[best]] = ids[best], scores[best]
        self.count[touched] = np.minimum(self.k, np.diff(np.append(starts, len(query))))
        full = touched[self.count[touched] == self.k]
        self.floor[full] = np.maximum(self.floor[full], self.scores[full, self.k - 1])


def _search(batches: Iterator[pa.RecordBatch], queries: dict, k: int) -> Iterator[pa.RecordBatch]:
    asked = {dim: _Asked(ids, v, floors, k) for dim, (ids, v, floors) in queries.items()}
    for batch in batches:
        for row in batch.to_pylist():
            q, ids = asked.get(row["dim"]), np.frombuffer(row["ids"], np.int64)
            if q is None:
                continue
            size = len(row["data"]) // (len(ids) * row["dim"]) if row["dim"] else 8
            x = np.frombuffer(row["data"], {2: np.int16, 4: np.int32, 8: np.int64}[size]).reshape(len(ids), row["dim"]).astype(np.int64)
            _bucket(q, ids, x)
    for q in asked.values():
        there = np.arange(k)[None, :] < q.count[:, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(q.ids, q.count)), pa.array(q.found[there]), pa.array(q.scores[there])], names=["query_id", "frame_id", "score"])


def _bucket(q: _Asked, ids: np.ndarray, x: np.ndarray) -> None:
    """All queries that a bucket may serve: by the row where coordinates prune, else together up to the length that is needed."""
    xs = x.astype(np.float64)
    length = np.sqrt((xs**2).sum(1))  # descending
    need = q.need()
    reach = np.searchsorted(-length, -need, side="right")
    near = need / max(length[0], 1e-300) >= COSINE
    unit = xs / np.maximum(length, 1e-300)[:, None] if (near & (reach > 0)).any() else xs
    for i in np.flatnonzero(near & (reach > 0)).tolist():
        w = q.v[i] / q.norm[i]
        pick = np.arange(reach[i])  # length pruning
        focus = np.argsort(-np.abs(w))[:FOCUS]
        there = unit[: reach[i]][:, focus]
        rest = np.sqrt(np.maximum(0.0, 1 - (there**2).sum(1))) * np.sqrt(max(0.0, 1 - float((w[focus] ** 2).sum())))
        pick = pick[(there @ w[focus] + rest) * length[: reach[i]] >= need[i] * (1 - 1e-9)]  # coordinate pruning
        pick = pick[ids[pick] != q.ids[i]]
        if len(pick):
            scores = _products(q.v[i : i + 1], x[pick])[0]
            good = scores >= q.floor[i]
            if good.any():
                q.add(np.full(int(good.sum()), i), ids[pick][good], scores[good])
    others = np.flatnonzero(~near & (reach > 0))
    for at in range(0, len(others), TOGETHER):
        part = others[at : at + TOGETHER]
        most = int(reach[part].max())
        scores = _products(q.v[part], x[:most])
        good = (scores >= q.floor[part, None]) & (ids[None, :most] != q.ids[part, None])
        if most > q.k:  # no more than the k best of the bucket, and those equal to the last of them
            good &= scores >= np.partition(np.where(good, scores, np.iinfo(np.int64).min), -q.k, axis=1)[:, -q.k, None]
        i, j = np.nonzero(good)
        if len(i):
            q.add(part[i], ids[j], scores[i, j])


def top_products(frames: DataFrame, k: int = 20, every: int = 20, id_column: str = "frame_id", vector_column: str = "bands",
                 scale: int = SCALE) -> DataFrame:
    """``query_id, rank, frame_id, score``: the ``k`` largest integer products of each query.

    Vectors become integers floor(scale * x).  Queries are the rows whose id is divisible by ``every``;
    candidates are all rows but those of the query's own id.  Ties go to the smaller id; a query with
    fewer candidates than ``k`` gets all of them.  Only vectors of one length are compared.

    Vectors that are null or hold null or non-finite components take no part, nor do rows of null id;
    empty vectors score 0 with each other.  Rows that repeat an id are candidates of their own, and one
    of them, the first by its numbers, is the query.  Scores are 64-bit sums: vectors whose products go beyond them
    are not meant to be compared, and wrap around.  Other columns are not read.
    """
    spark = frames.sparkSession
    vectors = shared_table(whole_vectors(frames, id_column, vector_column, scale).withColumn("class", _class(F.col("norm2"))), "vectors")
    widest = max(1, vectors.agg(F.max("dim")).first()[0] or 1)
    asked = vectors.where(F.col("frame_id") % every == 0).groupBy("frame_id").agg(F.min(F.struct("v", "dim")).alias("q"))
    asked = ranks(asked.select("frame_id", "q.v", "q.dim"), ["frame_id"], "queries")
    n_asked = asked.count()
    longest = spark.sparkContext.broadcast(_by_dim(_longest(vectors, min(SEEDS, max(1, PASS_CELLS // widest))).select("frame_id", "dim", "v").toArrow()))
    packed = shared_table(buckets(vectors), "buckets")
    per_pass = max(1, PASS_CELLS // widest)
    parts = []
    for number in range(-(-n_asked // per_pass)):
        part = asked.where((F.col("rank") >= number * per_pass) & (F.col("rank") < (number + 1) * per_pass)).select("frame_id", "dim", "v")
        floors = part.mapInArrow(lambda b: _floors(b, longest.value, k), "frame_id long, floor double").toArrow()
        first = dict(zip(floors.column("frame_id").to_pylist(), floors.column("floor").to_pylist(), strict=True))
        queries = spark.sparkContext.broadcast({
            dim: (ids, v, {int(i): first[int(i)] for i in ids}) for dim, (ids, v) in _by_dim(part.toArrow()).items()})
        found = packed.mapInArrow(lambda b, queries=queries: _search(b, queries.value, k), "query_id long, frame_id long, score long")
        ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, frame_id)"))
        parts.append(shared_table(ranked.where(F.col("rank") <= k).select("query_id", "rank", "frame_id", "score"), "products"))
        queries.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, frame_id long, score long")
    return functools.reduce(DataFrame.unionByName, parts)
