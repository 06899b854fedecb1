"""Pick one configuration per device by exact tie rules.

Each rule is a number: its parts, most important first, side by side in one decimal.  Selection is then
``max_by`` on that number for every output column: a hash aggregation with plain buffers, combined
map-side, without a sort or a window.  ``ord`` is the position in the device's list; "first wins" ties
use ``-ord``.  Rows with a null in a rule's columns are never picked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.operators import segments

DEFAULT_FPS = 30
TIME_BITS = 30  # about a second of nanoseconds
ASPECT_TOLERANCE = 0.02
INT = 2**32  # a signed 32-bit part, moved up to start at 0
WIDE = "decimal(38,0)"


def _area() -> Column:
    return F.col("w").cast("long") * F.col("h")


def _rank(first: Column, *parts: Column) -> Column:
    """``first`` (up to 60 bits, or a boolean), then 32-bit integers, as one number that sorts like the tuple."""
    rank = first.cast("long").cast(WIDE)
    for part in parts:
        rank = (rank * INT + (part.cast("long") + INT // 2)).cast(WIDE)
    return rank


def _pick(df: DataFrame, keys: list[str], value: list[str], rank: Column) -> DataFrame:
    ranked = df.select(*keys, *value, rank.alias("__rank"))
    return ranked.groupBy(*keys).agg(*[F.max_by(c, "__rank").alias(c) for c in value])


def best_resolution(configs: DataFrame) -> DataFrame:
    """Per device and format: largest output area, wider wins a tie, then first."""
    out = configs.filter("NOT is_input")
    return _pick(out, ["device", "fmt"], ["w", "h"], _rank(_area(), F.col("w"), -F.col("ord"))).filter("w > 0 AND h > 0")


def largest_size(sizes: DataFrame) -> DataFrame:
    """Largest area, first wins."""
    return _pick(sizes, ["device"], ["w", "h"], _rank(_area(), -F.col("ord")))


def fixed_fps(ranges: DataFrame) -> DataFrame:
    """Fixed ranges beat variable ones, then the highest maximum, then first."""
    rank = _rank(F.col("lo") == F.col("hi"), F.col("hi"), -F.col("ord"))
    return _pick(ranges, ["device"], ["lo", "hi"], rank).filter("hi > 0")


def exposure_fps(devices: DataFrame, ranges: DataFrame) -> DataFrame:
    """Upper bound 30 with the highest lower bound; else the highest upper bound; first wins; default 30-30."""
    is30 = F.col("hi") == DEFAULT_FPS
    rank = _rank(is30, F.when(is30, F.col("lo")).otherwise(F.col("hi")), -F.col("ord"))
    picked = _pick(ranges, ["device"], ["lo", "hi"], rank)
    return devices.select("device").join(picked, "device", "left").na.fill(DEFAULT_FPS, ["lo", "hi"])


def _same_aspect(aspect: Column) -> Column:
    return F.abs(F.col("w") / F.col("h") - aspect) < ASPECT_TOLERANCE


def largest_encodable(sizes: DataFrame, aspect: Column, max_width: int) -> DataFrame:
    """Largest encodable size at the aspect and width cap; else largest at the aspect; else the first."""
    tier = F.when(~_same_aspect(aspect), 0).when((F.col("w") <= max_width) & F.col("encodable"), 2).otherwise(1)
    # an area below 2**58: the tier stands above it
    area = F.when(tier > 0, _area()).otherwise(F.lit(0).cast("long"))
    return _pick(sizes, ["device"], ["w", "h"], _rank(tier.cast("long") * 2**58 + area, -F.col("ord")))


def nearest_width(sizes: DataFrame, aspect: Column, target_width: int) -> DataFrame:
    """At the aspect, the width nearest the target (first wins); else the last size."""
    same = _same_aspect(aspect)
    rank = _rank(
        same,
        F.when(same, -F.abs(F.col("w") - target_width)).otherwise(0),
        F.when(same, -F.col("ord")).otherwise(F.col("ord")),
    )
    return _pick(sizes, ["device"], ["w", "h"], rank)


def native_aspect(devices: DataFrame, sizes: DataFrame) -> DataFrame:
    """Active array, else pixel array, else the largest output.

    ``devices``: device, active_w, active_h, pixel_w, pixel_h (null when not reported).
    """
    largest = largest_size(sizes).select("device", (F.col("w") / F.col("h")).alias("__largest"))

    def ratio(kind):
        return F.when(F.col(f"{kind}_h") > 0, F.col(f"{kind}_w") / F.col(f"{kind}_h"))

    joined = devices.join(largest, "device", "left")
    return joined.select("device", F.coalesce(ratio("active"), ratio("pixel"), F.col("__largest")).alias("aspect"))


def back_camera(cameras: DataFrame) -> DataFrame:
    """First back-facing camera of each device."""
    back = cameras.filter(F.col("facing") == "BACK")
    first = back.groupBy("device").agg(F.min("ord").alias("ord"))  # numbers only: hash aggregation
    return back.join(first, ["device", "ord"]).select("device", "camera_id")


def time_order(packets: DataFrame, bits: int = TIME_BITS) -> DataFrame:
    """``packets`` with ``pos``: their place from 0 on in their clip's order of ``ts_ns``, equal stamps by ``arrival``.

    Segments are stretches of about a second, so no task sorts a clip; a consumer sorts by ``pos`` where it must.
    """
    return segments.position(packets, ["clip_id"], ["ts_ns", "arrival"], "pos", bits=bits)


def capture_maxima(formats: DataFrame, rate: int = 48000, depth: int = 32, channels: int = 2) -> DataFrame:
    """Highest rate, depth and channel count, each on its own; defaults where none is advertised."""
    return formats.groupBy("device").agg(
        F.coalesce(F.max("rate"), F.lit(rate)).alias("rate"),
        F.coalesce(F.max("depth"), F.lit(depth)).alias("depth"),
        F.coalesce(F.max("channels"), F.lit(channels)).alias("channels"),
    )
