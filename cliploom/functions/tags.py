"""Device tags: mosaic pattern, orientation, rectangles, rationals, colour matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mosaic patterns by code, in reading order of the 2x2 cell.
MOSAIC_PATTERNS = ["RGGB", "GRBG", "GBRG", "BGGR"]
# Orientation code by clockwise degrees.
ORIENTATION_CODES = {90: 6, 180: 3, 270: 8}
# XYZ at D50 to XYZ at D65 (Bradford), and XYZ at D65 to linear BT.2020.
BRADFORD_D50_TO_D65 = [
    0.9555766, -0.0230393, 0.0631636,
    -0.0282895, 1.0099416, 0.0210077,
    0.0122982, -0.0204830, 1.3299098,
]
XYZ_D65_TO_BT2020 = [
    1.7166512, -0.3556708, -0.2533663,
    -0.6666844, 1.6164812, 0.0157685,
    0.0176399, -0.0427706, 0.9421031,
]
ILLUMINANT_D65 = 21


def mosaic_pattern(code: Column) -> Column:
    """Pattern of a mosaic code; an unknown code reads as the first pattern."""
    names = F.array(*[F.lit(p) for p in MOSAIC_PATTERNS])
    return F.coalesce(F.when(code >= 0, F.get(names, code.cast("int"))), F.lit(MOSAIC_PATTERNS[0]))


def orientation_code(degrees: Column) -> Column:
    turn = F.pmod(degrees, F.lit(360))
    out = F.lit(1)
    for deg, code in ORIENTATION_CODES.items():
        out = F.when(turn == deg, code).otherwise(out)
    return out


def black_level(v: Column) -> Column:
    return F.when(v < 0, 0).otherwise((v + 0.5).cast("int"))


def rational(num: Column, den: Column, if_zero: float) -> Column:
    """``num/den``; static matrices read 0.0 for a zero denominator, neutrals read 1.0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(if_zero))


def rect_to_edges(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """(x, y, w, h) to (top, left, bottom, right)."""
    return y, x, y + h, x + w


def edges_to_rect(left: Column, top: Column, right: Column, bottom: Column):
    """(left, top, right, bottom) to (x, y, w, h)."""
    return left, top, right - left, bottom - top


def matrix_product(a: list[Column], b: list[Column]) -> list[Column]:
    """3x3 product of row-major column lists."""
    return [
        sum((a[3 * r + k] * b[3 * k + c] for k in range(1, 3)), a[3 * r] * b[c])
        for r in range(3)
        for c in range(3)
    ]


def _minor(m: list[Column], r: int, c: int) -> Column:
    rows = [i for i in range(3) if i != r]
    cols = [i for i in range(3) if i != c]
    return m[3 * rows[0] + cols[0]] * m[3 * rows[1] + cols[1]] - m[3 * rows[0] + cols[1]] * m[3 * rows[1] + cols[0]]


def cofactors(m: list[Column]) -> list[Column]:
    """Signed minors of a row-major 3x3 matrix."""
    return [(1.0 if (r + c) % 2 == 0 else -1.0) * _minor(m, r, c) for r in range(3) for c in range(3)]


# Fixed values of the public PQ transfer standard (ST 2084).
PQ_M1, PQ_M2 = 2610 / 16384, 2523 / 4096 * 128
PQ_C1, PQ_C2, PQ_C3 = 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
PQ_SCALE = 0.10


def pq_encode(linear: Column) -> Column:
    """PQ signal of a linear value where 1.0 is full range."""
    p = F.pow(F.greatest(linear, F.lit(0.0)), F.lit(PQ_M1))
    return F.pow((PQ_C1 + PQ_C2 * p) / (1.0 + PQ_C3 * p), F.lit(PQ_M2))
