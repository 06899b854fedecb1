import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cliploom.operators import audio, scalars
from cliploom.plans import denoise
from cliploom.sources import binary


def clip_df(spark, signal, clip=1):
    pdf = pd.DataFrame({"clip_id": clip, "ch": 0, "n": np.arange(len(signal)), "v": signal})
    return spark.createDataFrame(pdf, "clip_id long, ch int, n long, v double")


def tone(n, seed=0):
    rng = np.random.default_rng(seed)
    return 0.3 * np.sin(np.arange(n) * 0.05) + 0.05 * rng.standard_normal(n)


def neutral_controls(spec, bands=32, bins=96):
    centre = F.transform(F.sequence(F.lit(0), F.lit(bins * 5 - 1)), lambda j: F.when(j % 5 == 2, 1.0).otherwise(0.0))
    return spec.select("clip_id", "ch", "t", F.array_repeat(F.lit(1.0), bands).alias("gain"), centre.alias("cre"),
                       F.array_repeat(F.lit(0.0), bins * 5).alias("cim"))


@pytest.mark.parametrize("n", [960, 4801, 7000])
def test_spectra_match_a_padded_clip(spark, n):
    x = tone(n)
    padded = np.concatenate([np.zeros(480), x, np.zeros(960)])
    count = (len(padded) - 960) // 480 + 1
    window = np.sin(np.pi / 2 * np.sin(np.pi * (np.arange(960) + 0.5) / 960) ** 2)
    got = {r.t: np.array(r.re) + 1j * np.array(r.im) for r in audio.spectra(clip_df(spark, x), frames_per_chunk=4).collect()}
    assert sorted(got) == list(range(count))
    for t in range(count):
        want = np.fft.rfft(window * padded[t * 480:t * 480 + 960]) / 960
        assert np.max(np.abs(got[t] - want)) < 1e-12


def test_neutral_controls_give_the_input_back(spark):
    x = tone(5000)
    clip = clip_df(spark, x)
    spec = audio.spectra(clip)
    out = denoise.resynthesize(clip, neutral_controls(spec), post_filter=False).toPandas().sort_values("n")
    assert len(out) == len(x)
    assert np.max(np.abs(out["v"].to_numpy() - x)) < 1e-9


def smoothed(rows, first, keep=0.99):
    """Closed form of ``m <- keep*m + (1-keep)*x``: a triangle of powers times the rows, plus the start's share."""
    n = len(rows)
    age = np.subtract.outer(np.arange(n), np.arange(n))
    weights = np.where(age >= 0, (1 - keep) * keep ** np.maximum(age, 0), 0)
    return weights @ rows + np.outer(keep ** np.arange(1, n + 1), first)


def test_features_by_definition(spark):
    x = tone(6000, 3)
    spec = np.array([np.array(r.re) + 1j * np.array(r.im) for r in audio.spectra(clip_df(spark, x)).orderBy("t").collect()])
    stops = [sum(audio.sound.BAND_WIDTHS[: b + 1]) for b in range(32)]
    power = [(np.abs(spec[:, s - w : s]) ** 2).mean(axis=1) for s, w in zip(stops, audio.sound.BAND_WIDTHS)]
    db = 10 * np.log10(np.stack(power, axis=1) + 1e-10)
    erb = (db - smoothed(db, np.linspace(-60, -90, 32))) / 40
    low = spec[:, :96] / np.sqrt(smoothed(np.abs(spec[:, :96]), np.linspace(0.001, 0.0001, 96)))
    got = sorted(denoise.features(clip_df(spark, x)).collect(), key=lambda r: r.t)
    ahead = lambda a: np.vstack([a[2:], np.zeros((2, a.shape[1]), a.dtype)])
    assert np.allclose([r.erb for r in got], ahead(erb), atol=1e-9)
    assert np.allclose(np.array([r.ure for r in got]) + 1j * np.array([r.uim for r in got]), ahead(low), atol=1e-9)


def test_chunked_scoring_equals_whole(spark):
    x = tone(1000)
    frames = clip_df(spark, x).withColumnRenamed("n", "t")
    got = audio.score_chunks(frames, lambda p: p["v"] * 3, chunk=128, warmup=16).toPandas().sort_values("t")
    assert np.allclose(got["v"], x * 3)

    def fails(p):
        if p["t"].max() > 900:
            raise RuntimeError
        return p["v"] * 3

    kept = audio.score_chunks(frames, fails, chunk=128, warmup=16).toPandas().sort_values("t")
    assert np.allclose(kept["v"], x)


@pytest.mark.parametrize("rate", [44100, 96000, 16000])
def test_band_limited_resample_keeps_a_tone(spark, rate):
    n, f = 4000, 1000.0
    x = 0.5 * np.sin(2 * np.pi * f * np.arange(n) / rate)
    out = audio.resample_band_limited(clip_df(spark, x), rate, outputs_per_chunk=700).toPandas().sort_values("n")
    count = math.ceil(n * 48000 / rate)
    assert out["n"].tolist() == list(range(count))
    want = 0.5 * np.sin(2 * np.pi * f * np.arange(count) / 48000)
    edge = 400
    assert np.max(np.abs(out["v"].to_numpy() - want)[edge:-edge]) < 2**-14


def test_linear_resample_matches_interp(spark):
    x = tone(321)
    for rate in (44100, 96000, 48000):
        out = audio.resample_linear(clip_df(spark, x), F.lit(rate)).toPandas().sort_values("n")
        n = int(len(x) * 48000 / rate)
        assert np.allclose(out["v"], np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x), atol=1e-9)


def test_pcm_widths_and_partial_block(spark):
    assert binary.decode_pcm(bytes.fromhex("ffff80ffff7f"), 3).tolist() == [-8323073, 8388607]
    data = np.arange(-50, 50, dtype="<i4").tobytes()
    df = spark.createDataFrame([(1, bytearray(data))], "clip_id long, payload binary")
    rows = binary.read_pcm(df, 32, 2, block=16, blocks_per_slice=2).orderBy("n", "ch").collect()
    assert [r.ival for r in rows] == list(range(-50, -50 + 96))


def test_audio_clock_is_never_reordered(spark):
    packets = spark.createDataFrame([(1, 0, 100), (1, 1, 50), (1, 2, 300)], "clip_id long, arrival long, ts_ns long")
    assert [r.rel_ns for r in scalars.relative_time(packets).orderBy("arrival").collect()] == [0, 0, 200]
