"""Column functions for raw pixels: black level, exposedness, colour conversion, rotation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliploom.functions.rounding import round_half_away
from cliploom.functions.sound import idiv

# Fixed values.
CLIP_FRACTION = 0.98
WELL_EXPOSED_SIGMA = 0.2
WEIGHT_FLOOR = 1e-3


def black_at(black: Column, y: Column, x: Column) -> Column:
    """Black level of the 2x2 mosaic site."""
    return F.get(black, (y % 2 * 2 + x % 2).cast("int"))


def is_clipped(v: Column, white: Column) -> Column:
    return v >= CLIP_FRACTION * white


def linear_value(v: Column, black: Column) -> Column:
    return F.greatest(v - black, F.lit(0.0))


def exposedness(v: Column, black: Column, white: Column) -> Column:
    return F.when(white > black, (v - black) / (white - black)).otherwise(0.0)


def exposure_weight(v: Column, black: Column, white: Column) -> Column:
    """Gaussian around mid exposure, never quite zero."""
    off = exposedness(v, black, white) - 0.5
    return F.exp(-(off * off) / (2.0 * WELL_EXPOSED_SIGMA * WELL_EXPOSED_SIGMA)) + WEIGHT_FLOOR


def quantize_radiance(v: Column, out_white: Column) -> Column:
    return F.least(F.greatest(round_half_away(v), F.lit(0)), out_white.cast("long"))


def _byte(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(255)).cast("int")


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """BT.601 limited range in thousandths; the division drops the fraction."""
    luma, cb, cr = 1164 * (y - 16), u - 128, v - 128
    k = F.lit(1000)
    return (
        _byte(idiv(luma + 1596 * cr, k)),
        _byte(idiv(luma - 391 * cb - 813 * cr, k)),
        _byte(idiv(luma + 2018 * cb, k)),
    )


def rotate(y: Column, x: Column, h: Column, w: Column, degrees: Column) -> tuple[Column, Column]:
    """(y, x) after a clockwise turn by a multiple of 90 degrees."""
    deg = F.pmod(degrees, F.lit(360))
    return (
        F.when(deg == 90, x).when(deg == 180, h - 1 - y).when(deg == 270, w - 1 - x).otherwise(y),
        F.when(deg == 90, h - 1 - y).when(deg == 180, w - 1 - x).when(deg == 270, y).otherwise(x),
    )


def gain_from_neutral(n: Column) -> Column:
    return F.when(n > 1e-6, 1.0 / n).otherwise(1.0)
