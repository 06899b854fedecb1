"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.session import durable_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    The written files survive any executor, so later steps never recompute what led to them.  Shuffle files of the
    write go when it ends; else they'd stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{durable_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_key(text: str | Column) -> Column:
    """64-bit hash that tells rows of one id with different texts apart; null and empty text share it."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def unsized(side: DataFrame) -> DataFrame:
    """A side of a join that is dealt by a shuffle, never broadcast.

    Plans go by the size of files and don't count what a scan or an explode makes of a row, so a side may look small enough
    to be collected when it is not.  Sides that are read as they were written need no such care.
    """
    return side.hint("merge")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equality join in which null keys match each other; the keys are kept once, from the left."""
    renamed = right.select([F.col(c).alias(f"__r_{c}" if c in keys else c) for c in right.columns])
    on = None
    for k in keys:
        match = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = match if on is None else on & match
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def released(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``scan`` that gives memory back to the machine when a task ends, since the worker process lives on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def as_bytes(column: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8 bytes without decoding them; null becomes empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of the published SplitMix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def share_of(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in the lowest ``share`` of its range."""
    return F.shiftrightunsigned(hashed, 11).cast("double") < F.lit(share * 2.0**53)


def bounded_sample(rows: DataFrame, hashed: Column, most: int) -> DataFrame:
    """All of ``rows``, or an even share of them by hash whose expected size is nineteen twentieths of ``most``.

    The share comes from one count; nothing is sorted and no task sees more than its own rows.
    """
    n = rows.count()
    return rows if n <= most else rows.where(share_of(hashed, 0.95 * most / n))


ID_BITS = 33  # of a monotonically increasing id for the place in its partition


def ranks(rows: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 on in ``order``, whatever the ties.

    Rows are sorted by ranges and written; a range's rows are numbered by themselves, and the sizes of the ranges
    before it, one row for each task, are added.
    """
    placed = shared_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "__place", F.monotonically_increasing_id()), name)
    part = F.shiftright("__place", ID_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    sizes = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    rank = F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn("rank", rank).drop(
        "__part", "__place", "__before")
