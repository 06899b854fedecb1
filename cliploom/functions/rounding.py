"""Rounding that gives the same double in any IEEE engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 6) -> Column:
    """Half-up to ``digits`` places; adding 0.0 turns -0.0 into 0.0."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5).cast("double") / scale + 0.0


def rounded_sql(expr: str, digits: int = 6) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.5) / {scale} + 0.0)"


def round_half_away(c: Column) -> Column:
    """Nearest integer, halves away from zero, as a long; exact also just below a half."""
    return F.round(c).cast("long")
