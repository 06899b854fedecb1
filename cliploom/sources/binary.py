"""Binary payloads to rows: interleaved PCM and strided 16-bit planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from cliploom.functions.sound import BLOCK_FRAMES

DECODE_BYTES = 1 << 20  # of slices that are decoded together

_INT_BY_BYTES = {2: "<i2", 4: "<i4"}


def decode_pcm(raw: bytes, width: int) -> np.ndarray:
    """Little-endian signed samples of 2, 3 or 4 bytes."""
    if width in _INT_BY_BYTES:
        return np.frombuffer(raw, _INT_BY_BYTES[width]).astype(np.int32)
    triples = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    value = triples[:, 0] | triples[:, 1] << 8 | triples[:, 2] << 16
    return (value ^ 0x800000) - 0x800000


def read_pcm(
    df: DataFrame,
    bits: int,
    channels: int,
    block: int = BLOCK_FRAMES,
    blocks_per_slice: int = 64,
    key: str = "clip_id",
    payload: str = "payload",
) -> DataFrame:
    """``(key, payload BINARY)`` to one row per sample: ``key, ch, n, ival``.

    Only whole blocks count; a partial last block is dropped.  A payload is cut into slices of
    whole blocks which are spread over the cluster before decoding, so one long recording fans out.
    """
    width = bits // 8
    frame_bytes = width * channels
    slice_frames = block * blocks_per_slice
    usable = F.expr(f"length({payload}) div {block * frame_bytes} * {block * frame_bytes}")
    slice_bytes = slice_frames * frame_bytes
    slices = (
        df.select(key, F.col(payload).alias("__raw"), usable.cast("int").alias("__usable"))
        .filter("__usable > 0")
        .withColumn("__slice", F.explode(F.expr(f"sequence(0, (__usable - 1) div {slice_bytes})")))
        .select(
            key,
            F.col("__slice").cast("long").alias("__slice"),
            F.substring(
                "__raw",
                F.col("__slice").cast("int") * slice_bytes + 1,
                F.least(F.lit(slice_bytes), F.col("__usable") - F.col("__slice").cast("int") * slice_bytes),
            ).alias("__bytes"),
        )
        .repartition(key, "__slice")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("__bytes").cast(pa.large_binary())
            counts = np.diff(np.frombuffer(raws.buffers()[1], np.int64, len(raws) + 1, raws.offset * 8)) // frame_bytes
            ends = np.cumsum(counts)
            at = 0
            while at < len(counts):  # a batch has thousands of slices: decoded some at a time
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] - counts[at] + DECODE_BYTES // frame_bytes, side="right")))
                yield some(batch.slice(at, stop - at), counts[at:stop])
                at = stop

    def some(batch: pa.RecordBatch, counts: np.ndarray) -> pa.RecordBatch:
        values = decode_pcm(b"".join(batch.column("__bytes").to_pylist()), width)  # slices hold whole frames: one pass for all
        first = np.repeat(batch.column("__slice").to_numpy() * slice_frames - (np.cumsum(counts) - counts), counts)
        n = first + np.arange(counts.sum())
        keys = batch.column(key).take(pa.array(np.repeat(np.arange(len(counts)), counts * channels)))
        return pa.RecordBatch.from_arrays([
            keys, pa.array(np.tile(np.arange(channels, dtype=np.int32), len(n))), pa.array(np.repeat(n, channels)),
            pa.array(values)], names=[key, "ch", "n", "ival"])

    kind = df.schema[key].dataType.simpleString()
    return slices.mapInArrow(decode, f"{key} {kind}, ch int, n long, ival int")


def explode_raw16(frames: DataFrame, key: str = "frame_id") -> DataFrame:
    """``(key, w, h, stride, data)`` to ``(key, y, x, v)``: the first ``2*w`` bytes of every stride."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def decode_row(rows: pa.Array) -> pa.Array:
        raws = rows.to_pylist()
        ends = np.concatenate([[0], np.cumsum([len(raw) // 2 for raw in raws])]).astype(np.int32)
        values = np.frombuffer(b"".join(raw[: len(raw) // 2 * 2] for raw in raws), "<u2").astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    rows = (
        frames.filter("h > 0 AND w > 0")
        .select(key, "w", "stride", "data", F.explode(F.expr("sequence(0, h - 1)")).alias("y"))
        .select(key, "y", F.expr("substring(data, y * stride + 1, w * 2)").alias("row"))
        .repartition(key, "y")
    )
    return rows.select(key, "y", F.posexplode(decode_row("row")).alias("x", "v"))
