"""Exposure bursts: completion, scalars, alignment and merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from cliploom.functions import pixel
from cliploom.functions.rounding import round_half_away
from cliploom.operators import segments
from cliploom.operators.segments import Scan

# Fixed values.
PYRAMID_FLOOR = 16
FALLBACK_EV_STEP = 2.0
MAX_SAMPLE = 65535
NO_OVERLAP = 2**63 - 1


def burst_islands(frames: DataFrame, **kw) -> DataFrame:
    """``run`` (arrival of the first frame with this base) and ``burst`` (number inside the run).

    A frame joins the current run while its base path stays the same; every ``expected`` frames
    complete a burst, ``expected`` being that of the run's first frame.  Single shots are ignored.
    ``frames``: session_id, arrival, base, expected.
    """
    keys = ["session_id"]
    shots = frames.filter("expected >= 2")
    marked = segments.scan(
        shots, keys, ["arrival"],
        {"__pos": Scan("position"), "__prev": Scan("last", F.struct("base"), strict=True)}, **kw,
    )
    opens = F.col("__prev").isNull() | ~F.col("__prev.base").eqNullSafe(F.col("base"))
    head = F.when(opens, F.struct("arrival", F.col("__pos").alias("pos"), "expected"))
    runs = segments.scan(marked, keys, ["arrival"], {"__head": Scan("last", head)}, **kw)
    return runs.select(
        *shots.columns,
        F.col("__head.arrival").alias("run"),
        F.floor((F.col("__pos") - F.col("__head.pos")) / F.col("__head.expected")).cast("long").alias("burst"),
        F.col("__head.expected").alias("run_expected"),
    )


def complete_bursts(frames: DataFrame, **kw) -> DataFrame:
    """Bursts that reached their expected count; a run cut short by another base gives none for the rest."""
    grouped = burst_islands(frames, **kw).groupBy("session_id", "run", "burst").agg(
        F.count(F.lit(1)).alias("n"), F.first("run_expected").alias("expected"), F.min("arrival").alias("first_arrival"),
        F.max("arrival").alias("last_arrival"), F.min_by("base", "arrival").alias("base"))
    return grouped.filter("n = expected").select("session_id", "base", "first_arrival", "last_arrival", "n")


def burst_scalars(frames: DataFrame, fallback_white: int = MAX_SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(per burst, per frame) scalars of a merge.

    Per burst: n, ref_frame, ref_idx, ref_white, ref_span, out_white.  Per frame: frame_id, burst, e_rel, is_ref.
    The reference is the frame whose index is nearest ``n div 2``, first by arrival (``frame_id``).
    Exposures count only if every frame of the burst has both values; otherwise two stops per index.

    ``frames``: burst, frame_id, idx, exposure_ns, iso, white, black ARRAY(4).
    """
    has = (F.col("exposure_ns") > 0) & (F.col("iso") > 0)
    burst = W.partitionBy("burst")  # a few frames; every step below shares this one shuffle
    light = F.col("exposure_ns").cast("double") * F.col("iso")
    sized = frames.select(
        "burst", "frame_id", "idx", "white", "black", light.alias("light"),
        F.count(F.lit(1)).over(burst).alias("n"), F.bool_and(has).over(burst).alias("have_exposure"))
    nearest = F.struct(F.abs(F.col("idx") - F.floor(F.col("n") / 2)), "frame_id", "idx", "light")
    with_ref = sized.filter("n >= 2").withColumn("ref", F.min(nearest).over(burst))
    rel = F.when(F.col("have_exposure"), F.col("light") / F.col("ref.light")).otherwise(
        F.pow(F.lit(2.0), FALLBACK_EV_STEP * (F.col("idx") - F.col("ref.idx"))))
    scaled = with_ref.withColumn("e_rel", F.when(rel > 0, rel).otherwise(1.0)).withColumn(
        "is_ref", F.col("frame_id") == F.col("ref.frame_id"))
    lowest = F.least(F.min("e_rel").over(burst), F.lit(1.0))
    white = F.when(F.col("white") > 0, F.col("white")).otherwise(fallback_white)
    mean_black = F.aggregate("black", F.lit(0.0), lambda a, b: a + b) * 0.25
    span = F.greatest(F.lit(1.0), white - mean_black)
    per_burst = scaled.withColumn("lowest", lowest).filter("is_ref").select(
        "burst", "n", F.col("frame_id").alias("ref_frame"), F.col("idx").alias("ref_idx"), white.alias("ref_white"),
        span.alias("ref_span"), F.least(F.lit(float(MAX_SAMPLE)), span * (1.0 / F.col("lowest"))).alias("out_white"))
    return per_burst, scaled.select("frame_id", "burst", "e_rel", "is_ref")


def merge_brackets(
    pixels: DataFrame, frames: DataFrame, per_burst: DataFrame, per_frame: DataFrame, w: int, h: int,
    shifts: DataFrame | None = None, as_written: bool = False,
) -> DataFrame:
    """Exposure-weighted radiance per (burst, y, x), in counts of the reference exposure.

    One hash aggregation: partial sums run before the shuffle and the reference pixel (the value
    used where every frame is clipped) rides along as a ``max``.

    ``pixels``: frame_id, y, x, v; ``frames``: frame_id, white, black; ``shifts``: frame_id, dx, dy
    in proxy pixels.  An aligned source lies at ``x + 2*dx``; ``as_written`` reads ``x - 2*dx`` instead,
    for results that must equal a merge made with the opposite sign.
    """
    info = per_frame.join(per_burst.select("burst", "ref_white"), "burst").join(
        frames.select("frame_id", "white", "black"), "frame_id")
    if shifts is not None:
        info = info.join(shifts, "frame_id", "left").na.fill(0, ["dx", "dy"])
    else:
        info = info.withColumn("dx", F.lit(0)).withColumn("dy", F.lit(0))
    sign = 2 if as_written else -2
    rows = segments.attach(pixels, info, ["frame_id"], F.struct("y", "x")).filter(F.col("burst").isNotNull())
    value = F.col("v").cast("double")
    white = F.when(F.col("white") > 0, F.col("white")).otherwise(F.col("ref_white"))
    black = pixel.black_at(F.col("black"), F.col("y"), F.col("x"))
    lin = pixel.linear_value(value, black)
    weighed = rows.select(
        "burst",
        (F.col("y") + sign * F.col("dy")).alias("y"),
        (F.col("x") + sign * F.col("dx")).alias("x"),
        lin.alias("lin"),
        F.when(~pixel.is_clipped(value, white), pixel.exposure_weight(value, black, white)).alias("weight"),
        "e_rel",
        "is_ref",
    ).filter(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    merged = weighed.groupBy("burst", "y", "x").agg(
        F.sum(F.col("weight") * F.col("lin") / F.col("e_rel")).alias("num"),
        F.sum("weight").alias("den"),
        F.max(F.when(F.col("is_ref"), F.col("lin"))).alias("ref_lin"),
    )
    return merged.filter(F.col("ref_lin").isNotNull()).select(
        "burst", "y", "x", F.coalesce(F.col("num") / F.col("den"), F.col("ref_lin")).alias("radiance"))


def quantize_merged(merged: DataFrame, per_burst: DataFrame) -> DataFrame:
    """Integer output samples and the white level they are written with (black is zero)."""
    limits = per_burst.select("burst", "out_white")
    rows = segments.attach(merged, limits, ["burst"], F.struct("y", "x"))
    return rows.select(
        "burst", "y", "x", pixel.quantize_radiance(F.col("radiance"), F.col("out_white")).alias("value"),
        round_half_away(F.col("out_white")).alias("white"))


def halve(pixels: DataFrame, key: str, w: int, h: int) -> DataFrame:
    """2x2 means; an odd last row or column is dropped."""
    half = lambda c: F.shiftright(c, 1)
    inside = (F.col("y") < h // 2 * 2) & (F.col("x") < w // 2 * 2)
    return pixels.filter(inside).groupBy(key, half("y").alias("y"), half("x").alias("x")).agg(F.avg("v").alias("v"))


def pyramid_sizes(w: int, h: int) -> list[tuple[int, int]]:
    sizes = [(w, h)]
    while sizes[-1][0] > PYRAMID_FLOOR and sizes[-1][1] > PYRAMID_FLOOR:
        sizes.append((sizes[-1][0] // 2, sizes[-1][1] // 2))
    return sizes


def pyramid(pixels: DataFrame, key: str, w: int, h: int) -> list[DataFrame]:
    """The image and its halvings while both sides exceed the floor; each level is a quarter of the one before."""
    levels = [pixels.select(key, "y", "x", F.col("v").cast("double").alias("v"))]
    for lw, lh in pyramid_sizes(w, h)[:-1]:
        levels.append(halve(levels[-1], key, lw, lh))
    return levels


def upper_median(values: DataFrame, keys: list[str]) -> DataFrame:
    """Element ``n div 2`` of the sorted values, from a histogram (one row per distinct value).

    The window runs over distinct values: 16-bit samples have at most 2**16, their 2x2 means 2**18,
    however many pixels an image has.
    """
    counts = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    by_value = W.partitionBy(*keys).orderBy("v")
    placed = counts.select(
        *keys, "v", F.sum("c").over(by_value).alias("upto"), F.sum("c").over(W.partitionBy(*keys)).alias("n"))
    return placed.filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*keys).agg(F.min("v").alias("median"))


@F.arrow_udf(ArrayType(LongType()))
def _packed(lines: pa.Array) -> pa.Array:
    """Bits of each line as words of 64, the first bit lowest; the last word is filled up with zeros."""
    widths = lines.value_lengths().to_numpy().astype(np.int64)
    words = -(-widths // 64)
    place = np.repeat(64 * (np.cumsum(words) - words) - (np.cumsum(widths) - widths), widths) + np.arange(widths.sum())
    flat = np.zeros(64 * int(words.sum()), bool)
    flat[place] = lines.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(words)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.packbits(flat, bitorder="little").view(np.int64)))


def bitmap_rows(values: DataFrame, key: str) -> DataFrame:
    """One row per image line: its above-median bits in x order as 64-bit ``words``, and its ``width``."""
    medians = upper_median(values.select(key, "v"), [key])
    marked = segments.attach(values, medians, [key], F.struct("y", "x"))
    lines = marked.groupBy(key, "y").agg(
        F.sort_array(F.collect_list(F.struct("x", (F.col("v") > F.col("median")).alias("b")))).alias("line"))
    return lines.select(key, "y", _packed(F.transform("line", lambda c: c["b"])).alias("words"), F.size("line").alias("width"))


def _rows_of_words(lines: pa.Array, least: int) -> np.ndarray:
    """Lines of words as rows of one length, ``least`` words at least."""
    sizes = lines.value_lengths().to_numpy()
    out = np.zeros((len(sizes), max([least, *sizes])), np.uint64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = (
        lines.flatten().to_numpy().view(np.uint64))
    return out


def _below(bits: np.ndarray) -> np.ndarray:
    """Words whose lowest ``bits`` bits are set: none below 0, all from 64 on."""
    inside = np.clip(bits, 0, 63).astype(np.uint64)
    return np.where(bits >= 64, np.uint64(2**64 - 1), (np.uint64(1) << inside) - np.uint64(1))


@F.arrow_udf(ArrayType(LongType()))
def _mismatches(ref: pa.Array, mov: pa.Array, ref_width: pa.Array, mov_width: pa.Array, shifts: pa.Array) -> pa.Array:
    """Differing places of each line against the other moved by each of its shifts: all lines and shifts at once."""
    counts = shifts.value_lengths().to_numpy()
    row, dx = np.repeat(np.arange(len(counts)), counts), shifts.flatten().to_numpy().astype(np.int64)
    a = _rows_of_words(ref, 0)
    b = _rows_of_words(mov, a.shape[1])
    a = np.pad(a, ((0, 0), (0, b.shape[1] - a.shape[1])))
    n = b.shape[1]
    # bit i of a moved line is bit i + dx of the line
    source = np.arange(n)[None, :] + (dx >> 6)[:, None]
    word = lambda at: np.where((at >= 0) & (at < n), b[row[:, None], np.clip(at, 0, max(n - 1, 0))], np.uint64(0))
    low = (dx & 63).astype(np.uint64)[:, None]
    moved = word(source) >> low
    moved |= np.where(low > 0, word(source + 1) << ((np.uint64(64) - low) & np.uint64(63)), np.uint64(0))
    start = np.maximum(0, -dx)
    end = np.maximum(start, np.minimum(ref_width.to_numpy()[row], mov_width.to_numpy()[row] - dx))
    first = 64 * np.arange(n)[None, :]
    mask = _below(end[:, None] - first) & ~_below(start[:, None] - first)
    errors = np.bitwise_count((a[row] ^ moved) & mask).sum(axis=1, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(errors))


def bitmap_error(ref: DataFrame, mov: DataFrame, candidates: DataFrame, key: str = "pair_id") -> DataFrame:
    """Mismatch in millionths (fraction dropped) per candidate shift; no overlap gives the largest long.

    ``ref``/``mov``: key, y, words, width; ``candidates``: key, dx, dy.  Lines meet on (key, y + dy), one row per
    line and vertical shift; the horizontal shifts are compared inside the row, 64 places at a time.
    """
    per_dy = candidates.groupBy(key, "dy").agg(F.collect_set("dx").alias("dxs"))
    want = ref.select(key, F.col("y").alias("ry"), F.col("words").alias("ref"), F.col("width").alias("ref_width")).join(per_dy, key)
    want = want.withColumn("y", F.col("ry") + F.col("dy"))
    met = want.join(mov.select(key, "y", F.col("words").alias("mov"), F.col("width").alias("mov_width")), [key, "y"])
    errors = _mismatches("ref", "mov", "ref_width", "mov_width", "dxs").alias("errs")
    compared = met.select(key, "dy", "ref_width", "mov_width", F.explode(F.arrays_zip("dxs", errors)).alias("m"))
    dx = F.col("m.dxs")
    both = F.least(F.col("ref_width"), F.col("mov_width") - dx) - F.greatest(F.lit(0), -dx)
    scored = compared.select(
        key, dx.alias("dx"), "dy", F.col("m.errs").alias("err"), F.greatest(F.lit(0), both).cast("long").alias("cnt"))
    total = scored.groupBy(key, "dx", "dy").agg(F.sum("err").alias("err"), F.sum("cnt").alias("cnt"))
    full = candidates.join(total, [key, "dx", "dy"], "left")
    ratio = F.when(F.col("cnt") > 0, (F.col("err") / F.col("cnt") * 1e6).cast("long"))
    return full.select(*candidates.columns, F.coalesce(ratio, F.lit(NO_OVERLAP)).alias("error"))


def _search(levels: list[tuple[DataFrame, DataFrame]], pairs: DataFrame, key: str) -> DataFrame:
    """Shift per pair from the bit lines of each pyramid level, coarsest first.

    Nine candidates per level, smallest error, first in scan order (dy outer, dx inner).  The loop runs
    over the few pyramid levels, never over pairs.
    """
    shifts = pairs.select(key, F.lit(0).alias("dx"), F.lit(0).alias("dy"))
    offsets = F.explode(F.array(*[
        F.struct(F.lit(oy).alias("oy"), F.lit(ox).alias("ox")) for oy in (-1, 0, 1) for ox in (-1, 0, 1)]))
    for ref_lines, mov_lines in levels:
        candidates = shifts.select(key, "dx", "dy", offsets.alias("o")).select(
            key, (F.col("dx") * 2 + F.col("o.ox")).alias("dx"), (F.col("dy") * 2 + F.col("o.oy")).alias("dy"),
            "o.oy", "o.ox")
        scored = bitmap_error(ref_lines, mov_lines, candidates, key)
        # with no overlap anywhere the doubled shift stays
        stay = (F.col("error") == NO_OVERLAP) & ~((F.col("oy") == 0) & (F.col("ox") == 0))
        # one number that sorts like (error, stay, oy, ox): plain buffers keep this a hash aggregation
        rank = ((F.col("error").cast("decimal(38,0)") * 2 + stay.cast("int")) * 9 + (F.col("oy") + 1) * 3 + F.col("ox") + 1).cast("decimal(38,0)")
        shifts = scored.groupBy(key).agg(F.min_by("dx", rank).alias("dx"), F.min_by("dy", rank).alias("dy"))
    return shifts


def align(ref: DataFrame, mov: DataFrame, w: int, h: int, key: str = "pair_id") -> DataFrame:
    """Coarse-to-fine shift of ``mov`` against ``ref`` (key, y, x, v) per pair."""
    levels = [
        (bitmap_rows(r, key), bitmap_rows(m, key))
        for r, m in zip(reversed(pyramid(ref, key, w, h)), reversed(pyramid(mov, key, w, h)), strict=True)]
    return _search(levels, ref.select(key).distinct(), key)


def align_frames(pixels: DataFrame, pairs: DataFrame, w: int, h: int) -> DataFrame:
    """Shift per pair of frames: ``pair_id, dx, dy``.

    Pyramid, medians and bit lines are made once for each frame, however many pairs it is in.
    ``pixels``: frame_id, y, x, v; ``pairs``: pair_id, ref_id, mov_id.
    """
    levels = []
    for level in reversed(pyramid(pixels, "frame_id", w, h)):
        lines = bitmap_rows(level, "frame_id")
        side = lambda name, lines=lines: lines.join(
            pairs.select("pair_id", F.col(name).alias("frame_id")), "frame_id").select("pair_id", "y", "words", "width")
        levels.append((side("ref_id"), side("mov_id")))
    return _search(levels, pairs, "pair_id")
