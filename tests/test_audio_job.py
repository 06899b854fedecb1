"""The audio job: one plan equals its parts, whatever the chunks."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.catalog.recordings import stand_in
from cliploom.functions import sound
from cliploom.operators import audio
from cliploom.plans import audio_job, denoise
from cliploom.sources import recordings

SMALL = dict(size=16, hop=8, widths=(1, 2, 2, 4), bins=4, zero_crossings=6)
SCHEMA = "clip_id long, ch int, n long, v double"


def clips(spark, lengths, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(c, ch, n, float(v)) for (c, ch), size in lengths.items() for n, v in enumerate(np.clip(rng.normal(0, 0.3, size), -1, 1))]
    return spark.createDataFrame(rows, SCHEMA)


def collected(df):
    return {(r["clip_id"], r["ch"], r["n"]): r["v"] for r in df.collect()}


def same(a, b, most=1e-9):
    assert a.keys() == b.keys()
    assert max(abs(a[k] - b[k]) for k in a) <= most


def parts(df, rate, g, model):
    """The same job out of the single operators, the model over whole channels."""
    line = audio.resample_band_limited(df, rate, g.target, g.zero_crossings, g.passband) if rate != g.target else df
    found = denoise.features(line, g.size, g.hop, g.widths, g.bins)

    def control(pdf):
        pdf = pdf.sort_values("t")
        unit = np.stack(pdf["ure"].to_numpy()) + 1j * np.stack(pdf["uim"].to_numpy())
        gain, taps = model(np.stack(pdf["erb"].to_numpy()), unit)
        flat = taps.reshape(len(pdf), -1)
        return pdf[["clip_id", "ch", "t"]].assign(gain=list(gain), cre=list(flat.real), cim=list(flat.imag))

    controls = found.groupBy("clip_id", "ch").applyInPandas(
        control, "clip_id long, ch int, t long, gain array<double>, cre array<double>, cim array<double>")
    return denoise.resynthesize(line, controls, g.size, g.hop, g.widths, g.bins, g.post_filter)


@pytest.mark.parametrize(("rate", "chunk", "warmup"), [(44100, 7, 2), (48000, 5, 3), (96000, 40, 2)])
def test_equals_its_parts(spark, rate, chunk, warmup):
    df = clips(spark, {(1, 0): 400, (1, 1): 400, (2, 0): 1, (3, 0): 37, (4, 0): 130})
    g = audio_job.Geometry(**SMALL, chunk=chunk, warmup=warmup)
    got = audio_job.denoise(df, rate, stand_in, g)
    assert got.where("NOT denoised").count() == 0
    same(collected(got), collected(parts(df, rate, g, stand_in)))


def remembering(erb, unit):
    """A model whose memory is four frames."""
    gain = np.stack([erb[max(0, t - 3) : t + 1].mean(0) for t in range(len(erb))])
    return stand_in(gain, unit)


def test_chunked_equals_whole_and_length_stays(spark):
    df = clips(spark, {(1, 0): 900, (2, 0): 333})
    whole = collected(audio_job.denoise(df, 48000, remembering, audio_job.Geometry(**SMALL, chunk=500, warmup=4)))
    chunked = collected(audio_job.denoise(df, 48000, remembering, audio_job.Geometry(**SMALL, chunk=9, warmup=4)))
    same(whole, chunked)
    assert len(whole) == 900 + 333
    short = collected(audio_job.denoise(df, 48000, remembering, audio_job.Geometry(**SMALL, chunk=9, warmup=2)))
    assert max(abs(short[k] - whole[k]) for k in whole) > 1e-6  # a warm-up shorter than the memory shows


def test_silence_noise_and_snr(spark):
    """At true sizes: a mask that closes all bands but the lowest keeps a tone and takes noise away."""
    rng = np.random.default_rng(0)
    n = np.arange(30_000)
    clean = 0.5 * np.sin(2 * np.pi * 440 * n / 48000) * (n > 6000)
    noise = rng.standard_normal(len(n)) * 0.1
    rows = [(c, 0, int(i), float(v)) for c, x in ((1, clean + noise), (2, noise), (3, clean * 0)) for i, v in zip(n, x)]

    def gate(erb, unit):
        gain = np.where(np.arange(erb.shape[1]) < 8, 1.0, 0.05) + 0 * erb
        taps = np.zeros((*unit.shape, 5), complex)
        taps[:, :, 2] = np.repeat(gain, sound.BAND_WIDTHS, axis=1)[:, : sound.FILTER_BINS]
        return gain, taps

    g = audio_job.Geometry(chunk=20, warmup=4)
    out = collected(audio_job.denoise(spark.createDataFrame(rows, SCHEMA), 48000, gate, g))
    get = lambda c: np.array([out[(c, 0, int(i))] for i in n])
    snr = lambda est: 10 * np.log10(np.sum(clean**2) / np.sum((est - clean) ** 2))
    assert snr(get(1)) > snr(clean + noise) + 3
    assert np.mean(get(2) ** 2) < 0.2 * np.mean(noise**2) and not get(3).any()


def test_failing_model_keeps_the_channel(spark):
    def refuses(erb, unit):
        if len(erb) < 12:
            raise ValueError("no")
        return stand_in(erb, unit)

    df = clips(spark, {(1, 0): 400, (1, 1): 400, (2, 0): 60, (3, 0): 240, (3, 1): 200})
    g = audio_job.Geometry(**SMALL, chunk=10, warmup=3)
    out = audio_job.denoise(df, 44100, refuses, g)
    plain = collected(audio.resample_band_limited(df, 44100, 48000, 6, 0.95))
    shared = -(-200 * 160 // 147)
    kept = {k: v for k, v in plain.items() if k[0] != 3 or k[2] < shared}
    assert {(r["clip_id"], r["ch"]) for r in out.where("denoised").select("clip_id", "ch").distinct().collect()} == set()
    same(collected(out), kept)


def test_shapes_are_checked_and_uneven_channels_are_cut(spark):
    df = clips(spark, {(1, 0): 300, (1, 1): 250, (2, 0): 120})
    g = audio_job.Geometry(**SMALL, chunk=10, warmup=3)
    out = audio_job.denoise(df, 48000, stand_in, g)
    sizes = {(r["clip_id"], r["ch"]): r["count"] for r in out.groupBy("clip_id", "ch").count().collect()}
    assert sizes == {(1, 0): 250, (1, 1): 250, (2, 0): 120} and out.where("denoised").count() == 620
    wrong = audio_job.denoise(df, 48000, lambda erb, unit: (erb[:, :2], unit), g)
    assert wrong.where("denoised").count() == 0 and wrong.count() == 620
    with pytest.raises(ValueError, match="warm-up"):
        audio_job.Geometry(**SMALL, chunk=3, warmup=3)


def test_samples_are_shuffled_at_most_four_times(spark):
    df = clips(spark, {(1, 0): 300})
    g = audio_job.Geometry(**SMALL, chunk=10, warmup=3)
    first = audio_job.chunk_lines(df, 44100, g)._jdf.queryExecution().executedPlan().toString()
    lines = spark.createDataFrame(first and audio_job.chunk_lines(df, 44100, g).collect(), audio_job.chunk_lines(df, 44100, g).schema)
    second = audio_job.replay(lines, audio_job.running_means(lines, g), stand_in, g)._jdf.queryExecution().executedPlan().toString()
    assert first.count("Exchange hashpartitioning(clip_id") <= 2 and "FlatMapGroupsInPandas" in second


def test_samples_take_little_room_between_steps(spark):
    """PCM waits in four bytes a sample, other values exactly in eight, and samples that are done are not joined where no channel needs it."""
    g = audio_job.Geometry(**SMALL, chunk=10, warmup=3)
    rows = [(clip, 0, n, v / 32768 if clip == 1 else v / 30000) for clip in (1, 2) for n, v in enumerate(range(-9000, 9000, 60))]
    df = spark.createDataFrame(rows, SCHEMA)
    lines = audio_job.chunk_lines(df, 44100, g).collect()
    assert {(r["clip_id"], r["width"]) for r in lines} == {(1, 4), (2, 8)}
    known = {(clip, n): v for clip, _, n, v in rows}
    for r in lines:
        values = np.frombuffer(r["line"], f"<f{r['width']}")
        assert values.tolist() == [known[(r["clip_id"], r["at"] + i)] for i in range(len(values))]
    out = audio_job.denoise(df, 44100, stand_in, g)
    assert out.count() == 2 * -(-300 * 160 // 147) and "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_side_car(spark):
    source, out = tempfile.mkdtemp(prefix="run-"), tempfile.mkdtemp(prefix="run-")
    rng = np.random.default_rng(1)
    rows = [(c, ch, n, int(v)) for c in (1, 2) for ch in range(2) for n, v in enumerate(rng.integers(-9000, 9000, 160))]
    recordings.write_pcm(spark.createDataFrame(rows, "clip_id long, ch int, n long, ival int"), source, 16)
    g = audio_job.Geometry(**SMALL, chunk=10, warmup=3)
    manifest = audio_job.side_car(spark, source, out, 48000, 16, 2, stand_in, g, block=16)
    assert {(r["key"], r["rows"]) for r in manifest.collect()} == {("1", 320), ("2", 320)}
    back = recordings.read_pcm_ranges(spark, out, 24, 2, block=1)
    df = spark.createDataFrame([(c, ch, n, v / 32768) for c, ch, n, v in rows], SCHEMA)
    want = audio_job.denoise(df, 48000, stand_in, g).select("clip_id", "ch", "n", sound.quantize_pcm24(F.col("v")).alias("v"))
    got = collected(back.withColumnRenamed("ival", "v"))
    same(got, collected(want), 1)


@pytest.mark.parametrize(("rate", "target"), [(44100, 48000), (48000, 44100), (65537, 48000), (48000, 480)])
def test_polyphase_equals_the_direct_sum(rate, target):
    bank = audio.Polyphase(rate, target, 16, 0.95)
    x = np.random.default_rng(1).normal(size=900)
    total = -(-len(x) * bank.up // bank.down)
    out = bank.resample(np.arange(len(x)), x, 0, total)
    i = np.arange(total)
    distance = np.arange(len(x))[None, :] - (i * bank.down / bank.up)[:, None]
    taps = audio.sinc_taps(distance, bank.cutoff, bank.half)
    steps = np.arange(-bank.reach, bank.reach + 2)[None, :] - ((i * bank.down % bank.up) / bank.up)[:, None]
    want = (taps @ x) / audio.sinc_taps(steps, bank.cutoff, bank.half).sum(1)
    assert np.abs(out - want).max() < 1e-12
    cut = sorted({0, total // 3, total // 2, total})
    assert np.abs(np.concatenate([bank.resample(np.arange(len(x)), x, a, b) for a, b in zip(cut, cut[1:])]) - out).max() < 1e-12
    assert len(bank.known) == min(bank.up, total)


def test_up_then_down_gives_the_input_back():
    x = np.sin(np.arange(4000) * 0.11) + 0.5 * np.cos(np.arange(4000) * 0.31)
    up, down = audio.Polyphase(44100, 192000, 64, 0.95), audio.Polyphase(192000, 44100, 64, 0.95)
    high = up.resample(np.arange(len(x)), x, 0, -(-len(x) * up.up // up.down))
    back = down.resample(np.arange(len(high)), high, 0, len(x))
    assert np.abs(back - x)[400:-400].max() < 1e-4
