"""Mosaic frame to a display-ready frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cliploom.operators import frames, scalars, segments
from pyspark.sql import functions as F


def develop_frames(pixels: DataFrame, devices: DataFrame, image_device: DataFrame, w: int, h: int, pattern: str = "RGGB") -> DataFrame:
    """Demosaic, white balance, colour matrix, PQ: ``image_id, y, x, r_pq, g_pq, b_pq``.

    ``pixels``: image_id, y, x, v (linear, normalised); ``devices``: device, gains, ccm;
    ``image_device``: image_id, device.
    """
    rgb = frames.demosaic(pixels, w, h, pattern)
    tagged = segments.attach(rgb, image_device, ["image_id"], F.struct("y", "x"))
    return scalars.develop_colour(tagged, devices).drop("device")
