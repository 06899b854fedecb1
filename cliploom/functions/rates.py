"""Bitrates, exposure ladders, progress, path names and packet types as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliploom.functions.rounding import round_half_away

from cliploom.functions.sound import idiv

# Fixed values.
BITS_PER_PIXEL = 0.80
RAW_BITRATE_CAP = 460_000_000
LEGACY_BITRATE_CAP = 200_000_000
DEFAULT_STEP_EV = 1.0 / 3.0
CLOCK_TOLERANCE_NS = 5_000_000_000
PARAMETER_SETS = {32: "VPS", 33: "SPS", 34: "PPS"}


def even(c: Column) -> Column:
    return c.bitwiseAND(F.lit(-2))


def raw_bitrate(w: Column, h: Column, fps: Column) -> Column:
    """Bits per pixel target, rounded half away from zero, under a cap; a bad rate reads as 30."""
    rate = F.when(fps > 0, fps).otherwise(30)
    target = round_half_away(BITS_PER_PIXEL * even(w) * even(h) * rate)
    return F.least(target, F.lit(RAW_BITRATE_CAP)).cast("long")


def legacy_bitrate(w: Column, h: Column, encoder_max: Column) -> Column:
    pixels = w.cast("long") * h * 30
    return F.least(encoder_max, F.lit(LEGACY_BITRATE_CAP), idiv(pixels, F.lit(2))).cast("long")


def ladder_step(step_ev: Column) -> Column:
    """Compensation units in two stops: floor(x + 0.5)."""
    step = F.coalesce(F.when(step_ev > 0, step_ev), F.lit(DEFAULT_STEP_EV))
    return F.floor(2.0 / step + 0.5).cast("int")


def exposure_ladder(step_ev: Column, shots: Column, low: Column, high: Column) -> Column:
    """Array of exposure compensations: one shot at 0, or minus/zero/plus two stops, in device range."""
    k = ladder_step(step_ev)
    zero = F.lit(0)
    raw = F.when(shots <= 1, F.array(zero)).otherwise(F.array(-k, zero, k))
    return F.transform(raw, lambda c: F.coalesce(F.greatest(low, F.least(high, c)), c))


def clock_offset(ts: Column, mono: Column, boot: Column) -> Column:
    """What to subtract so a first frame's stamp lies on the monotonic clock."""
    return (
        F.when(F.abs(ts - mono) < CLOCK_TOLERANCE_NS, 0)
        .when(F.abs(ts - boot) < CLOCK_TOLERANCE_NS, boot - mono)
        .otherwise(ts - mono)
    )


def finalize_percent(is_raw: Column, done: Column, total: Column) -> Column:
    return (
        F.when(~is_raw, 100)
        .when(total == 0, 0)
        .when(done >= total, 100)
        .otherwise(idiv(done * 100, F.greatest(total, F.lit(1))))
        .cast("int")
    )


def duration_ms(start_ns: Column, now_ns: Column) -> Column:
    return idiv(now_ns - start_ns, F.lit(1_000_000))


def burst_base(path: Column, index: Column) -> Column:
    """Path without its ``_<index>.dng`` ending; any other path is kept whole."""
    suffix = F.concat(F.lit("_"), index.cast("string"), F.lit(".dng"))
    kept = F.substring(path, F.lit(1), F.length(path) - F.length(suffix))
    return F.when(F.endswith(path, suffix), kept).otherwise(path)


def cut_at_last_dng(path: Column) -> Column:
    """Everything before the last ``.dng``; the whole path where there is none."""
    return F.regexp_replace(path, r"(?s)^(.*)\.dng.*$", "$1")


def sidecar_path(path: Column) -> Column:
    """``x.mkv`` to ``x_ai.flac``; other names just get the ending."""
    return F.concat(F.regexp_replace(path, r"\.mkv\z", ""), F.lit("_ai.flac"))


def stamped_name(prefix: str, ts: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(suffix))


def nal_type(first_byte: Column) -> Column:
    return F.shiftright(first_byte, 1).bitwiseAND(F.lit(63))
