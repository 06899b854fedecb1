"""Neighbourhood operators on images, one bounded tile at a time.

Pixels near a tile edge are copied to the tiles that need them, so every image is cut into equal
work items whatever its size and each pixel is shuffled once (plus the edge copies).

For demosaicing, non-local means, temporal blending and chroma smoothing the known behaviour fixes
only parameters; the combination rules here are the published ones named in each docstring.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.operators import affine

TILE_BITS = 8  # 256 x 256 pixels to a work item

# Fixed values.
NOISE_SLOPE, NOISE_FLOOR = 0.04, 0.004
SEARCH_RADIUS, PATCH_RADIUS, NLM_STRENGTH = 2, 1, 1.25
STATIC_SIGMA, MOTION_SIGMA, RETENTION = 3.0, 6.0, 0.0
CHROMA_RADIUS, CHROMA_SIGMA_S, CHROMA_SIGMA_L = 3, 2.0, 20.0
# The linear demosaic filters of Malvar, He and Cutler (2004), in eighths, as (dy, dx): weight.
GREEN_TAPS = {(0, 0): 4, (-1, 0): 2, (1, 0): 2, (0, -1): 2, (0, 1): 2, (-2, 0): -1, (2, 0): -1, (0, -2): -1, (0, 2): -1}
ROW_TAPS = {(0, 0): 5, (0, -1): 4, (0, 1): 4, (-1, -1): -1, (-1, 1): -1, (1, -1): -1, (1, 1): -1,
            (0, -2): -1, (0, 2): -1, (-2, 0): 0.5, (2, 0): 0.5}
COLUMN_TAPS = {(dx, dy): w for (dy, dx), w in ROW_TAPS.items()}
DIAGONAL_TAPS = {(0, 0): 6, (-1, -1): 2, (-1, 1): 2, (1, -1): 2, (1, 1): 2, (-2, 0): -1.5, (2, 0): -1.5, (0, -2): -1.5, (0, 2): -1.5}


def taps_for(pattern: str, y: int, x: int, channel: str) -> dict:
    """Filter that gives ``channel`` at a mosaic site."""
    site = pattern[y % 2 * 2 + x % 2]
    if site == channel:
        return {(0, 0): 8}
    if channel == "G":
        return GREEN_TAPS
    if site == "G":
        return ROW_TAPS if pattern[y % 2 * 2 + 1 - x % 2] == channel else COLUMN_TAPS
    return DIAGONAL_TAPS


def by_tile(
    pixels: DataFrame, keys: Sequence[str], halo: int, w: int, h: int,
    fn: Callable[[pd.DataFrame, int, int, int, int], pd.DataFrame], schema: str,
) -> DataFrame:
    """Run ``fn(rows, y0, x0, y1, x1)`` for every tile; rows reach ``halo`` past its [y0, y1) x [x0, x1)."""
    bits = TILE_BITS
    span = lambda c, size: F.sequence(
        F.shiftright(F.greatest(F.col(c) - halo, F.lit(0)), bits),
        F.shiftright(F.least(F.col(c) + halo, F.lit(size - 1)), bits))
    placed = pixels.withColumn("__ty", F.explode(span("y", h))).withColumn("__tx", F.explode(span("x", w)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["__ty"].iloc[0]) << bits, int(pdf["__tx"].iloc[0]) << bits
        return fn(pdf, y0, x0, min(y0 + (1 << bits), h), min(x0 + (1 << bits), w))

    return placed.groupBy(*keys, "__ty", "__tx").applyInPandas(run, schema)


def _mirror(i: np.ndarray, size: int) -> np.ndarray:
    """Indices past an edge come back without repeating it, which keeps mosaic parity."""
    i = np.abs(i)
    return np.where(i >= size, 2 * (size - 1) - i, i)


def _plane(pdf: pd.DataFrame, value: str, y0: int, x0: int, y1: int, x1: int, halo: int, w: int, h: int) -> np.ndarray:
    """Tile and halo as an array, image edges mirrored."""
    ys, xs = _mirror(np.arange(y0 - halo, y1 + halo), h), _mirror(np.arange(x0 - halo, x1 + halo), w)
    oy, ox = ys.min(), xs.min()
    sparse = np.zeros((max(int(pdf["y"].max()), ys.max()) - oy + 1, max(int(pdf["x"].max()), xs.max()) - ox + 1))
    keep = (pdf["y"].to_numpy() >= oy) & (pdf["x"].to_numpy() >= ox)
    sparse[pdf["y"].to_numpy()[keep] - oy, pdf["x"].to_numpy()[keep] - ox] = pdf[value].to_numpy()[keep]
    return sparse[np.ix_(ys - oy, xs - ox)]


def _grid(pdf: pd.DataFrame, keys: Sequence[str], y0: int, x0: int, y1: int, x1: int, **columns) -> pd.DataFrame:
    ys, xs = np.mgrid[y0:y1, x0:x1]
    base = {k: pdf[k].iloc[0] for k in keys}
    return pd.DataFrame({**base, "y": ys.ravel().astype(np.int32), "x": xs.ravel().astype(np.int32),
                         **{k: v.ravel() for k, v in columns.items()}})


def demosaic(pixels: DataFrame, w: int, h: int, pattern: str = "RGGB", key: str = "image_id") -> DataFrame:
    """Linear 5x5 demosaic (Malvar, He and Cutler 2004): ``key, y, x, r, g, b`` from mosaic values ``v``."""
    halo = 2

    def run(pdf, y0, x0, y1, x1):
        plane = _plane(pdf, "v", y0, x0, y1, x1, halo, w, h)
        rows, cols = y1 - y0, x1 - x0
        out = {}
        for name in "RGB":
            value = np.zeros((rows, cols))
            for py in (0, 1):
                for px in (0, 1):
                    total = np.zeros((rows, cols))
                    for (dy, dx), weight in taps_for(pattern, py, px, name).items():
                        total += weight / 8 * plane[halo + dy:halo + dy + rows, halo + dx:halo + dx + cols]
                    sy, sx = (py - y0) % 2, (px - x0) % 2
                    value[sy::2, sx::2] = total[sy::2, sx::2]
            out[name.lower()] = value
        return _grid(pdf, [key], y0, x0, y1, x1, **out)

    return by_tile(pixels.select(key, "y", "x", F.col("v").cast("double").alias("v")), [key], halo, w, h, run,
                   f"{key} long, y int, x int, r double, g double, b double")


def noise_sigma(v: np.ndarray) -> np.ndarray:
    return NOISE_SLOPE * np.sqrt(np.maximum(v, 0)) + NOISE_FLOOR


def tiles(pixels: DataFrame, key: str, halo: int, w: int, h: int) -> DataFrame:
    """``key, ty, tx, plane``: every tile of an image with its halo as one binary of doubles, edges mirrored.

    Pixels are shuffled once, to their tiles; what follows joins tiles, never pixels.
    """

    bits = TILE_BITS

    def run(pdf, y0, x0, y1, x1):
        plane = _plane(pdf, "v", y0, x0, y1, x1, halo, w, h)
        return pd.DataFrame({key: pdf[key].iloc[:1], "ty": y0 >> bits, "tx": x0 >> bits, "plane": [plane.tobytes()]})

    rows = pixels.select(F.col(key).cast("long").alias(key), "y", "x", F.col("v").cast("double").alias("v"))
    return by_tile(rows, [key], halo, w, h, run, f"{key} long, ty int, tx int, plane binary")


def _corners(pdf: pd.DataFrame, bits: int, w: int, h: int) -> tuple[int, int, int, int]:
    y0, x0 = int(pdf["ty"].iloc[0]) << bits, int(pdf["tx"].iloc[0]) << bits
    return y0, x0, min(y0 + (1 << bits), h), min(x0 + (1 << bits), w)


def _spread_sums(a: np.ndarray, count: int, step: int, axis: int) -> np.ndarray:
    """Sums of ``count`` values ``step`` apart from every place on, by one running sum for each of the ``step`` grids."""
    moved = np.moveaxis(a, axis, 0)
    n = len(moved)
    rows = -(-n // step)
    grid = np.zeros((rows + 1, step, *moved.shape[1:]))
    grid[1:].reshape(rows * step, *moved.shape[1:])[:n] = moved
    sums = grid.cumsum(axis=0)
    out = (sums[count:] - sums[:-count]).reshape(-1, *moved.shape[1:])[: n - (count - 1) * step]
    return np.moveaxis(out, 0, axis)


def non_local_means(
    pixels: DataFrame, history: DataFrame, w: int, h: int, strength: float = NLM_STRENGTH, key: str = "frame_id",
    patch_radius: int = PATCH_RADIUS,
) -> DataFrame:
    """Same-colour non-local means (Buades, Coll and Morel 2005) over a frame and its past frames.

    A 5x5 search of 3x3 patches, both in same-colour steps of two pixels; weights
    ``exp(-max(d2 - 2*sigma^2, 0) / (strength*sigma)^2)`` with ``d2`` the mean squared patch difference.  The
    squared differences are made once for each place of the search, and patches are sums of running sums over
    the same-colour grids, so the time does not grow with the patch.
    ``pixels``: key, y, x, v (normalised); ``history``: key, past0, past1.
    """
    bits, step, reach = TILE_BITS, 2, 2 * patch_radius
    halo = 2 * (SEARCH_RADIUS + patch_radius)
    sources = history.select(
        F.col(key).cast("long").alias("target"), F.explode(F.array_distinct(F.array(*[F.col(c).cast("long") for c in (key, "past0", "past1")]))).alias(key))
    rows = tiles(pixels, key, halo, w, h).join(sources, key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0, y1, x1 = _corners(pdf, bits, w, h)
        n_y, n_x, target = y1 - y0, x1 - x0, pdf["target"].iloc[0]
        planes = {s: np.frombuffer(p).reshape(n_y + 2 * halo, n_x + 2 * halo) for s, p in zip(pdf[key], pdf["plane"])}
        if target not in planes:
            return pd.DataFrame({key: [], "y": [], "x": [], "v": []})

        def cut(a, dy, dx, more=0):
            return a[halo + dy - more:halo + dy + n_y + more, halo + dx - more:halo + dx + n_x + more]

        here = cut(planes[target], 0, 0, reach)
        sigma = noise_sigma(cut(planes[target], 0, 0))
        num, den = np.zeros((n_y, n_x)), np.zeros((n_y, n_x))
        search = [step * i for i in range(-SEARCH_RADIUS, SEARCH_RADIUS + 1)]
        count = 2 * patch_radius + 1
        for plane in planes.values():
            for oy in search:
                for ox in search:
                    square = (here - cut(plane, oy, ox, reach)) ** 2
                    d2 = _spread_sums(_spread_sums(square, count, step, 0), count, step, 1) / count**2
                    weight = np.exp(-np.maximum(d2 - 2 * sigma**2, 0) / (strength * sigma) ** 2)
                    num += weight * cut(plane, oy, ox)
                    den += weight
        return _grid(pdf.assign(**{key: target}), [key], y0, x0, y1, x1, v=num / den)

    return rows.groupBy("target", "ty", "tx").applyInPandas(run, f"{key} long, y int, x int, v double")


def temporal_blend(
    pixels: DataFrame, frames: DataFrame, w: int, h: int, retention: float = RETENTION
) -> DataFrame:
    """Recursive average over frames where nothing moves.

    Motion at a pixel is the largest change from the frame before within its 3x3 same-colour footprint;
    retention falls from the cap to zero by a smoothstep between 3 and 6 noise sigmas and is scaled by
    the frame's trust.  Motion is measured on the input frames, so the average is a linear recurrence per
    pixel and runs as an affine scan.  With the default cap of zero frames pass unchanged.

    ``pixels``: frame_id, y, x, v (normalised); ``frames``: clip_id, frame_id, idx (dense), past0, trust.
    """
    bits, halo = TILE_BITS, 2
    packed = tiles(pixels, "frame_id", halo, w, h)
    meta = frames.select("clip_id", F.col("frame_id").cast("long").alias("frame_id"), "idx", F.col("past0").cast("long").alias("past0"), "trust")
    now = packed.join(meta, "frame_id").withColumn("kind", F.lit(0))
    before = packed.withColumnRenamed("frame_id", "past0").join(meta.filter("past0 <> frame_id"), "past0").withColumn("kind", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0, y1, x1 = _corners(pdf, bits, w, h)
        n_y, n_x = y1 - y0, x1 - x0
        planes = {k: np.frombuffer(p).reshape(n_y + 2 * halo, n_x + 2 * halo) for k, p in zip(pdf["kind"], pdf["plane"])}
        if 0 not in planes:
            return pd.DataFrame({c: [] for c in ("clip_id", "frame_id", "idx", "y", "x", "a", "b")})
        cur = planes[0]
        value = cur[halo:halo + n_y, halo:halo + n_x]
        keep = np.zeros((n_y, n_x))
        if 1 in planes:
            change = np.abs(cur - planes[1])
            peak = np.max([change[halo + dy:halo + dy + n_y, halo + dx:halo + dx + n_x]
                           for dy in (-2, 0, 2) for dx in (-2, 0, 2)], axis=0)
            sigma = noise_sigma(value)
            u = np.clip((peak - STATIC_SIGMA * sigma) / ((MOTION_SIGMA - STATIC_SIGMA) * sigma), 0, 1)
            keep = retention * float(pdf["trust"].iloc[0]) * (1 - u * u * (3 - 2 * u))
        return _grid(pdf, ["clip_id", "frame_id", "idx"], y0, x0, y1, x1, a=keep, b=(1 - keep) * value)

    steps = now.unionByName(before).groupBy("clip_id", "frame_id", "ty", "tx").applyInPandas(
        run, "clip_id long, frame_id long, idx long, y int, x int, a double, b double")
    blended = affine.affine_scan(steps, ["clip_id", "y", "x"], "idx", F.col("a"), F.array("b"),
                                 F.array(F.lit(0.0)), carry=["frame_id"])
    return blended.select("clip_id", "frame_id", "y", "x", F.col("m")[0].alias("v"))


def smooth_chroma(sites: DataFrame, w: int, h: int, key: str = "image_id") -> DataFrame:
    """Luma-guided average of chroma over 7x7 sites; luma is untouched and places outside are left out.

    ``sites``: key, y, x, luma, cb, cr.
    """
    halo = CHROMA_RADIUS

    def run(pdf, y0, x0, y1, x1):
        n_y, n_x = y1 - y0, x1 - x0
        shape = (n_y + 2 * halo, n_x + 2 * halo)
        at = (pdf["y"].to_numpy() - y0 + halo, pdf["x"].to_numpy() - x0 + halo)
        planes = {}
        for name in ("luma", "cb", "cr"):
            planes[name] = np.zeros(shape)
            planes[name][at] = pdf[name].to_numpy()
        there = np.zeros(shape)
        there[at] = 1.0

        def cut(a, dy, dx):
            return a[halo + dy:halo + dy + n_y, halo + dx:halo + dx + n_x]

        luma = cut(planes["luma"], 0, 0)
        total, cb, cr = np.zeros((n_y, n_x)), np.zeros((n_y, n_x)), np.zeros((n_y, n_x))
        for dy in range(-halo, halo + 1):
            for dx in range(-halo, halo + 1):
                gap = cut(planes["luma"], dy, dx) - luma
                weight = cut(there, dy, dx) * np.exp(
                    -(dy * dy + dx * dx) / (2 * CHROMA_SIGMA_S**2) - gap * gap / (2 * CHROMA_SIGMA_L**2))
                total += weight
                cb += weight * cut(planes["cb"], dy, dx)
                cr += weight * cut(planes["cr"], dy, dx)
        return _grid(pdf, [key], y0, x0, y1, x1, luma=luma, cb=cb / total, cr=cr / total)

    typed = sites.select(key, "y", "x", *[F.col(c).cast("double").alias(c) for c in ("luma", "cb", "cr")])
    return by_tile(typed, [key], halo, w, h, run, f"{key} long, y int, x int, luma double, cb double, cr double")
