"""Burst to merged image, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.operators import bursts
from cliploom.operators.scalars import geometry_guard
from cliploom.session import cut_lineage


def merge_bursts(
    frames: DataFrame, pixels: DataFrame, w: int, h: int, aligned: bool = True, as_written: bool = False
) -> DataFrame:
    """Quantised merged pixels of every complete burst: burst, y, x, value, white.

    ``frames``: burst, frame_id, idx, expected, exposure_ns, iso, white, black, w, h, bytes;
    ``pixels``: frame_id, y, x, v.  Bursts short of frames or of mixed size give nothing.
    """
    counts = frames.groupBy("burst").agg(F.count(F.lit(1)).alias("have"), F.max("expected").alias("need"))
    whole = counts.filter("have = need AND need >= 2").select("burst")
    usable = geometry_guard(frames.join(whole, "burst", "left_semi"), "burst")
    per_burst, per_frame = bursts.burst_scalars(usable)
    shifts = None
    if aligned:
        others = per_frame.filter("NOT is_ref").select("burst", F.col("frame_id").alias("pair_id"))
        pairs = others.join(per_burst.select("burst", F.col("ref_frame").alias("ref_id")), "burst").select(
            "pair_id", "ref_id", F.col("pair_id").alias("mov_id"))
        found = bursts.align_frames(bursts.halve(pixels, "frame_id", w, h), pairs, w // 2, h // 2)
        shifts = found.withColumnRenamed("pair_id", "frame_id")
    merged = bursts.merge_brackets(pixels, usable, per_burst, per_frame, w, h, shifts, as_written)
    return bursts.quantize_merged(merged, per_burst)


def merge_shots(frames: DataFrame, pixels: DataFrame, w: int, h: int, **options) -> DataFrame:
    """From captured frames to merged pixels: session_id, run, burst, y, x, value, white.

    Runs of one base path are cut into bursts of the expected count (a run may hold several), and each
    complete one is merged.  ``frames``: session_id, arrival, base, expected and what ``merge_bursts`` needs
    of a frame besides its burst.
    """
    found = bursts.burst_islands(frames).withColumn("expected", F.col("run_expected"))
    # a row for each frame, read by every later step: written once
    named = cut_lineage(found.withColumn("burst", F.concat_ws(":", "session_id", "run", "burst")))
    merged = merge_bursts(named, pixels, w, h, **options)
    part = lambda i: F.split("burst", ":")[i].cast("long")
    return merged.select(part(0).alias("session_id"), part(1).alias("run"), part(2).alias("burst"), "y", "x", "value", "white")
