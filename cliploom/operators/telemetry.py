"""Frame timing, per-window statistics, counters and backlog from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.operators import segments
from cliploom.operators.segments import Scan

# Fixed values.
WINDOW_FRAMES = 60
DEFAULT_FPS = 30
MIN_TRUST = 0.5
THROTTLE = 15
STORE_CAP = 16


def frame_gaps(frames: DataFrame, **kw) -> DataFrame:
    """``gap_ns`` to the frame before (null for the first) and the frame's number ``idx``."""
    out = segments.scan(
        frames, ["clip_id"], ["arrival"],
        {"idx": Scan("position"), "__prev": Scan("last", F.col("ts_ns"), strict=True)}, **kw)
    return out.withColumn("gap_ns", F.col("ts_ns") - F.col("__prev")).drop("__prev")


def window_max_gap(frames: DataFrame, size: int = WINDOW_FRAMES, **kw) -> DataFrame:
    gaps = frame_gaps(frames, **kw).withColumn("window", F.floor(F.col("idx") / size))
    return gaps.groupBy("clip_id", "window").agg(F.max("gap_ns").alias("max_gap_ns"))


def frame_trust(frames: DataFrame, fps: Column, **kw) -> DataFrame:
    """Weight of the past at each frame: nominal interval over actual, within [0.5, 1]; 1 without a usable past."""
    gaps = segments.previous(frames, ["clip_id"], ["arrival"], {"__prev": F.col("ts_ns")}, **kw)
    nominal = 1e9 / F.when(fps > 0, fps).otherwise(DEFAULT_FPS)
    usable = (F.col("__prev") > 0) & (F.col("ts_ns") > F.col("__prev"))
    trust = F.least(F.lit(1.0), F.greatest(F.lit(MIN_TRUST), nominal / (F.col("ts_ns") - F.col("__prev"))))
    return gaps.withColumn("trust", F.when(usable, trust).otherwise(1.0)).drop("__prev")


def frame_history(frames: DataFrame, value: str = "frame_id", **kw) -> DataFrame:
    """``past0`` and ``past1``: the frames one and two back, clamped at the start of the clip."""
    one = segments.previous(frames, ["clip_id"], ["arrival"], {"__p1": F.col(value)}, **kw)
    two = segments.previous(one, ["clip_id"], ["arrival"], {"__p2": F.col("__p1")}, **kw)
    past0 = F.coalesce("__p1", value)
    return two.withColumn("past0", past0).withColumn("past1", F.coalesce(F.col("__p2"), F.col("past0"))).drop("__p1", "__p2")


def throttle(results: DataFrame, every: int = THROTTLE, **kw) -> DataFrame:
    """Keep results 0, ``every``, 2*``every``, ... of each clip."""
    ranked = segments.position(results, ["clip_id"], ["arrival"], "__n", **kw)
    return ranked.filter(F.col("__n") % every == 0).drop("__n")


def telemetry_windows(frames: DataFrame, size: int = WINDOW_FRAMES, **kw) -> DataFrame:
    """Statistics of every full window of ``size`` encoded frames; a remainder gives none.

    A dropped frame belongs to the window being filled when it arrives.  The wall time of a window
    runs from the last frame of the one before, so only the first window lacks a gap.
    ``frames``: clip_id, arrival, ts_ns, dropped, gpu_ns, wait_ns, copy_ns.
    """
    encoded = ~F.col("dropped")
    marked = segments.scan(
        frames, ["clip_id"], ["arrival"],
        {
            "__done": Scan("sum", encoded.cast("long"), strict=True),
            "__prev": Scan("last", F.col("ts_ns"), strict=True),
            "__prev_done": Scan("last", F.when(encoded, F.col("ts_ns")), strict=True),
        },
        **kw,
    )
    only = lambda c: F.when(encoded, F.col(c))
    rows = marked.withColumn("window", F.floor(F.coalesce("__done", F.lit(0)) / size))
    wall = F.sum(F.when(encoded, F.coalesce(F.col("ts_ns") - F.col("__prev_done"), F.lit(0))))
    out = rows.groupBy("clip_id", "window").agg(
        F.sum(encoded.cast("long")).alias("frames"),
        wall.alias("__wall"),
        *[F.avg(only(f"{n}_ns")).alias(f"{n}_mean_ns") for n in ("gpu", "wait", "copy")],
        *[F.max(only(f"{n}_ns")).alias(f"{n}_max_ns") for n in ("gpu", "wait", "copy")],
        F.max(F.col("ts_ns") - F.col("__prev")).alias("gap_max_ns"),
        F.sum(F.col("dropped").cast("long")).alias("drops"),
    )
    fps = F.when(F.col("__wall") > 0, 1e9 * F.col("frames") / F.col("__wall")).otherwise(0.0)
    return out.filter(F.col("frames") == size).withColumn("fps", fps).drop("__wall")


def recording_counters(frames: DataFrame, causes: list[str]) -> DataFrame:
    """Frames in, encoded and dropped, with one column per drop cause.  ``frames``: clip_id, cause (null = encoded)."""
    return frames.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("frames_in"),
        F.count_if(F.col("cause").isNull()).alias("encoded"),
        F.count("cause").alias("dropped"),
        *[F.count_if(F.col("cause") == c).alias(f"dropped_{c}") for c in causes],
    )


def backlog(log: DataFrame, **kw) -> DataFrame:
    """Depth of the frame store after each event.  ``log``: clip_id, arrival, action (``push`` | ``reject`` | ``pop``)."""
    step = F.when(F.col("action") == "push", 1).when(F.col("action") == "pop", -1).otherwise(0)
    return segments.scan(log, ["clip_id"], ["arrival"], {"depth": Scan("sum", step)}, **kw)


def backlog_summary(log: DataFrame, cap: int = STORE_CAP, **kw) -> DataFrame:
    """Pushed, popped, rejected and peak depth per clip, and rejections seen while the store was full."""
    return backlog(log, **kw).groupBy("clip_id").agg(
        F.count_if(F.col("action") == "push").alias("pushed"),
        F.count_if(F.col("action") == "pop").alias("popped"),
        F.count_if(F.col("action") == "reject").alias("rejected"),
        F.count_if((F.col("action") == "reject") & (F.col("depth") >= cap)).alias("rejected_full"),
        F.max("depth").alias("peak"),
    )


def signal_summary(samples: DataFrame, keys: list[str], value: str = "v", order: str = "n") -> DataFrame:
    """Count, rms (over all values, bad ones adding nothing), min, max and the number of NaN or infinite values.

    Min and max start from the first value: a first NaN stays, a first infinity bounds one side.
    """
    v = F.col(value)
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    good = F.when(~bad, v)
    out = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.sum(F.when(bad, 0.0).otherwise(v * v)) / F.count(F.lit(1))).alias("rms"),
        F.min_by(v, order).alias("__first"),
        F.min(good).alias("__low"),
        F.max(good).alias("__high"),
        F.count_if(bad).alias("bad"),
    )
    first = F.col("__first")
    pick = lambda f, c: F.when(F.isnan(first) | F.col(c).isNull(), first).otherwise(f(first, F.col(c)))
    return out.select(*keys, "n", "rms", pick(F.least, "__low").alias("min"), pick(F.greatest, "__high").alias("max"), "bad")


def quality_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Signal to noise of ``est`` and ``noisy`` against ``ref`` (all per sample), the gain, noise energy and largest change."""
    ref, noisy, est = F.col("ref"), F.col("noisy"), F.col("est")

    def snr(x):
        return 10 * F.log10(F.sum(ref * ref) / (F.sum((x - ref) * (x - ref)) + 1e-12))

    out = pairs.groupBy(*keys).agg(
        snr(noisy).alias("snr_in"), snr(est).alias("snr_out"),
        (10 * F.log10(F.avg((est - ref) * (est - ref)) + 1e-12)).alias("residual_db"),
        F.max(F.abs(est - noisy)).alias("max_abs_diff"))
    return out.withColumn("gain_db", F.col("snr_out") - F.col("snr_in"))
