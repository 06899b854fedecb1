"""Audio feature extraction and re-synthesis, end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cliploom.functions import sound
from cliploom.operators import audio


def features(
    samples: DataFrame, size: int = sound.FFT_SIZE, hop: int = sound.HOP,
    widths: Sequence[int] = sound.BAND_WIDTHS, bins: int = sound.FILTER_BINS,
) -> DataFrame:
    """Look-ahead features per frame: ``clip_id, ch, t, erb, ure, uim``."""
    spec = audio.spectra(samples, size, hop)
    return audio.look_ahead(audio.spectral_features(spec, widths, bins), ["erb", "ure", "uim"])


def resynthesize(
    samples: DataFrame, controls: DataFrame, size: int = sound.FFT_SIZE, hop: int = sound.HOP,
    widths: Sequence[int] = sound.BAND_WIDTHS, filter_bins: int = sound.FILTER_BINS, post_filter: bool = True,
) -> DataFrame:
    """Apply given band gains and filter coefficients and return to samples: ``clip_id, ch, n, v``."""
    spec = audio.spectra(samples, size, hop)
    shaped = audio.filter_spectra(spec, controls, widths, filter_bins, post_filter)
    return audio.overlap_add(audio.inverse_frames(shaped, size), audio.clip_lengths(samples), size, hop)
