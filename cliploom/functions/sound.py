"""Column functions for samples, clocks and spectral masks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BLOCK_FRAMES = 3840
INPUT_LATENCY_NS = 50_000_000
FFT_SIZE = 960
HOP = 480
BIN_COUNT = 481
BAND_WIDTHS = [
    2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 5, 5, 7,
    7, 8, 10, 12, 13, 15, 18, 20, 24, 28, 31, 37, 42, 50, 56, 67,
]
FILTER_BINS = 96
FILTER_TAPS = 5
LOOKAHEAD = 2
SMOOTHING = 0.99
CHUNK_FRAMES = 2000
WARMUP_FRAMES = 100
MASK_BETA = 0.02
MAX_CHANNELS = 8
SUBSET_RATE_LIMIT = 655_360


def pcm_normalize(ival: Column, bits: int) -> Column:
    """Integer sample to [-1, 1)."""
    return ival / F.lit(float(2 ** (bits - 1)))


def quantize_pcm24(v: Column) -> Column:
    """Clamp to [-1, 1], scale to 24 bits, drop the fraction."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)) * 8388607.0).cast("int")


def idiv(a: Column, b: Column) -> Column:
    """Integer division that drops the fraction (toward zero)."""
    return F.call_function("div", a, b)


def sample_time(base_ns: Column, n: Column, rate: Column) -> Column:
    """Nanosecond stamp of sample ``n``: base + floor(n * 1e9 / rate), split so long clips cannot overflow."""
    billion = F.lit(1_000_000_000).cast("long")
    return base_ns + idiv(n, rate) * billion + idiv(n % rate * billion, rate)


def post_filter_gain(g: Column, beta: float = MASK_BETA) -> Column:
    ratio = g / F.greatest(g * F.sin(F.lit(math.pi) * g * 0.5), F.lit(1e-12))
    return (1.0 + beta) * g / (1.0 + beta * ratio * ratio)


def analysis_window(i: Column, size: int = FFT_SIZE) -> Column:
    s = F.sin(F.lit(math.pi) * (i + 0.5) / float(size))
    return F.sin(F.lit(math.pi / 2) * s * s)


def decibels(power: Column) -> Column:
    return 10.0 * F.log10(power + 1e-10)


def valid_format(rate: Column, channels: Column, bits: Column) -> Column:
    return (rate > 0) & channels.between(1, MAX_CHANNELS) & bits.between(4, 32)


def streamable_subset(rate: Column) -> Column:
    return rate < SUBSET_RATE_LIMIT
