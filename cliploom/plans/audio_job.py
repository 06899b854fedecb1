"""Recorded audio to its denoised side-car in one plan.

Samples are shuffled once, to chunks of frames with the halo that resampling, framing, look-ahead, filter taps and
the model's warm-up need.  A chunk is resampled and framed where it lies; the running means that go through a
whole channel leave it as one affine step, a row of band values.  The steps are scanned, every chunk gets
the means it starts from, and is replayed up to its samples.  Chunks are kept as the samples they came from, which take
a fraction of the room of resampled ones, and are resampled once more when they are replayed.  What two chunks add to the same samples, the
window's overlap at a border, comes out as a few rows of sums.  Chunks go to Python many at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.functions import sound
from cliploom.operators import affine, audio, grouped
from cliploom.session import cut_lineage
from cliploom.sources import recordings

KEYS = audio.KEYS
CALL_SAMPLES = 1 << 16  # of the chunks that a call replays, on average; a longer chunk is a call of its own

#: ``model(erb, unit)``: frames of a chunk in order, warm-up first, to band gains (frames, bands) and complex taps
#: (frames, bins, 5) of the low bins.
Model = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Geometry:
    """Sizes of frames, chunks and the resampler's filter."""

    size: int = sound.FFT_SIZE
    hop: int = sound.HOP
    widths: Sequence[int] = tuple(sound.BAND_WIDTHS)
    bins: int = sound.FILTER_BINS
    chunk: int = sound.CHUNK_FRAMES
    warmup: int = sound.WARMUP_FRAMES
    target: int = audio.MODEL_RATE
    zero_crossings: int = 64
    passband: float = 0.95
    post_filter: bool = True

    def __post_init__(self):
        if not self.hop <= self.size <= 2 * self.hop or self.warmup < sound.LOOKAHEAD or self.chunk <= self.warmup:
            raise ValueError("frames overlap by half at most, and a chunk is longer than its warm-up, which holds the filter's taps")

    @property
    def front(self) -> int:
        return self.size - self.hop

    def first_frame(self, chunk: int) -> int:
        """First frame that a chunk reads; the running means enter there."""
        return max(0, chunk * self.chunk - self.warmup)

    def frame_count(self, length: int) -> int:
        """Frames of a channel of ``length`` samples at the target rate."""
        return (length + self.front) // self.hop + 1


def _placed(samples: DataFrame, bank: audio.Polyphase, g: Geometry) -> DataFrame:
    """Samples copied to the one or two chunks that read them, and a row with the lengths in every chunk of a channel."""
    n, up, down = F.col("n"), bank.up, bank.down
    first, last = F.floor((n - bank.reach) * up / down), F.ceil((n + bank.reach) * up / down)
    ahead = sound.LOOKAHEAD
    low = F.floor((F.floor((first + g.front - g.size) / g.hop) - ahead) / g.chunk)
    high = F.floor((F.floor((last + g.front) / g.hop) + g.warmup) / g.chunk)
    rows = samples.select(*KEYS, F.explode(F.sequence(F.greatest(F.lit(0), low), F.greatest(F.lit(0), high))).alias("chunk"), "n", "v")
    ends = audio.clip_lengths(samples).withColumn("made", F.ceil(F.col("length") * up / down))
    chunks = F.floor(F.floor((F.col("made") + g.front) / g.hop) / g.chunk)
    marks = ends.select(*KEYS, F.explode(F.sequence(F.lit(0), chunks)).alias("chunk"), F.lit(-1).cast("long").alias("n"),
                        F.col("length").cast("double").alias("v"))
    return rows.unionByName(marks)


def _analyse(line: np.ndarray, begin: int, first: int, last: int, g: Geometry, window: np.ndarray) -> np.ndarray:
    """Spectra of the frames from ``first`` to before ``last``; ``line`` has the samples from ``begin`` on, zeros elsewhere."""
    low = first * g.hop - g.front
    whole = np.zeros((last - first - 1) * g.hop + g.size)
    a, b = max(low, begin), min(low + len(whole), begin + len(line))
    if b > a:
        whole[a - low : b - low] = line[a - begin : b - begin]
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(whole, g.size)[:: g.hop] * window, axis=1) / g.size


def _running_inputs(spec: np.ndarray, g: Geometry) -> np.ndarray:
    """What the running means average: band decibels and magnitudes of the low bins."""
    edges = np.cumsum([0, *g.widths[:-1]])
    power = np.add.reduceat(spec.real**2 + spec.imag**2, edges, axis=1) / np.array(g.widths)
    return np.concatenate([10 * np.log10(power + 1e-10), np.abs(spec[:, : g.bins])], axis=1)


def _stored(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes a sample and the samples: 4 where that loses nothing, as with PCM of 24 bits and less, else 8."""
    with np.errstate(over="ignore"):
        half = values.astype("<f4")
    return (4, half.tobytes()) if (half == values).all() else (8, values.astype("<f8").tobytes())


def _resampled(bank: audio.Polyphase, first: int, width: int, line: bytes, begin: int, end: int) -> np.ndarray:
    """Samples from ``begin`` to before ``end`` at the target rate, of a stored line that begins at ``first``."""
    values = np.frombuffer(line, f"<f{width}").astype(float)
    return bank.resample(first + np.arange(len(values)), values, begin, max(begin, end))


def _bank(rate: int, g: Geometry) -> audio.Polyphase:
    return audio.Polyphase(rate, g.target, g.zero_crossings, g.passband)


def chunk_lines(samples: DataFrame, rate: int, g: Geometry = Geometry()) -> DataFrame:
    """``clip_id, ch, chunk, made, begin, end, rate, at, width, line, steps, fold``: the samples that a chunk needs, stored
    from place ``at`` on, which outputs it makes of them, and the affine step of its running means.

    ``samples``: clip_id, ch, n, v at ``rate``.
    """
    bank = _bank(rate, g)
    window = audio._window(g.size)

    def build(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        chunks, n, v = (rows.column(c).to_numpy() for c in ("chunk", "n", "v"))
        out: list[tuple] = []
        for a, b in zip(ends, ends[1:]):
            marks = n[a:b] < 0
            if not marks.any():
                continue  # past the last frame of the channel
            length, chunk = int(v[a:b][marks][0]), int(chunks[a])
            made = -(-length * bank.up // bank.down)
            n_frames = g.frame_count(made)
            start, stop = g.first_frame(chunk), min((chunk + 1) * g.chunk + sound.LOOKAHEAD, n_frames)
            begin = min(made, max(0, start * g.hop - g.front))
            place, end = n[a:b][~marks], max(begin, min(made, stop * g.hop))
            first = int(place.min()) if len(place) else 0
            values = np.zeros(int(place.max()) + 1 - first if len(place) else 0)
            values[place - first] = v[a:b][~marks]
            width, kept = _stored(values)
            line = _resampled(bank, first, width, kept, begin, end)
            last = n_frames if (chunk + 1) * g.chunk >= n_frames else g.first_frame(chunk + 1)
            x = _running_inputs(_analyse(line, begin, start, last, g, window), g)
            weight = (1 - sound.SMOOTHING) * sound.SMOOTHING ** np.arange(len(x) - 1, -1, -1.0)
            out.append((a, chunk, made, begin, end, rate, first, width, kept, len(x), weight @ x))
        at, *columns, folds = zip(*out) if out else [()] * 11
        kinds = [pa.int64()] * 6 + [pa.int32(), pa.binary(), pa.int64()]
        row = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays(
            [rows.column(k).combine_chunks().take(row) for k in KEYS] + [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            + [grouped.lists(np.reshape(folds, (len(at), len(g.widths) + g.bins)))],
            names=[*KEYS, "chunk", "made", "begin", "end", "rate", "at", "width", "line", "steps", "fold"])

    return grouped.map_groups(_placed(samples, bank, g), [*KEYS, "chunk"], [], build,
                              "clip_id long, ch int, chunk long, made long, begin long, end long, rate long, at long, width int, line binary, steps long, "
                              "fold array<double>")


def running_means(lines: DataFrame, g: Geometry = Geometry()) -> DataFrame:
    """``clip_id, ch, chunk, m``: the running means going into every chunk."""
    bands = len(g.widths)
    init = [float(v) for v in audio.linspace(audio.BAND_START_DB, audio.BAND_END_DB, bands)
            + audio.linspace(audio.UNIT_START, audio.UNIT_END, g.bins)]
    starts = F.array(*[F.lit(v) for v in init])
    after = affine.affine_scan(lines.select(*KEYS, "chunk", "steps", "fold"), KEYS, "chunk",
                               F.pow(F.lit(sound.SMOOTHING), F.col("steps")), F.col("fold"), starts)
    first = lines.where("chunk = 0").select(*KEYS, "chunk", starts.alias("m"))
    return after.select(*KEYS, (F.col("chunk") + 1).alias("chunk"), "m").unionByName(first)


def _shape(spec: np.ndarray, first: int, own: tuple[int, int], gain: np.ndarray, taps: np.ndarray, g: Geometry) -> np.ndarray:
    """Own frames with the low bins filtered over five frames and the others scaled by the gain of their band."""
    a, b = own
    if g.post_filter:
        ratio = gain / np.maximum(gain * np.sin(np.pi * gain * 0.5), 1e-12)
        gain = (1 + sound.MASK_BETA) * gain / (1 + sound.MASK_BETA * ratio * ratio)
    out = spec[a - first : b - first] * np.repeat(gain, g.widths, axis=1)
    out[:, : g.bins] = 0
    for o in range(sound.FILTER_TAPS):
        at = np.arange(a, b) - sound.LOOKAHEAD + o
        inside = (at >= first) & (at - first < len(spec))  # frames outside the channel are left out
        out[inside, : g.bins] += spec[at[inside] - first, : g.bins] * taps[inside, :, o]
    return out


def replay(lines: DataFrame, means: DataFrame, model: Model, g: Geometry = Geometry()) -> DataFrame:
    """``clip_id, ch, chunk, ok, first, body, low, high``: samples of a chunk's own frames.

    ``body`` begins at sample ``first``; ``low`` and ``high`` are the sums at the borders with the chunks before and behind,
    null at an end of the channel.  ``ok`` is false where the model failed or gave other shapes.
    """
    window = audio._window(g.size)
    bands = len(g.widths)
    banks: dict[int, audio.Polyphase] = {}

    def one(key: tuple, made: int, begin: int, line: np.ndarray, m: np.ndarray) -> dict:
        chunk = key[-1]
        n_frames = g.frame_count(made)
        start = g.first_frame(chunk)
        own = chunk * g.chunk, min((chunk + 1) * g.chunk, n_frames)
        stop = min(own[1] + sound.LOOKAHEAD, n_frames)
        spec = _analyse(line, begin, start, stop, g, window)
        x = _running_inputs(spec, g)
        means = np.empty_like(x)
        for t in range(len(x)):
            m = sound.SMOOTHING * m + (1 - sound.SMOOTHING) * x[t]
            means[t] = m
        ahead = np.zeros((own[1] - start, bands)), np.zeros((own[1] - start, g.bins), complex)
        n = len(x) - sound.LOOKAHEAD if stop == n_frames else own[1] - start  # frames past the last one are zero
        n = max(0, min(n, own[1] - start))
        part = slice(sound.LOOKAHEAD, sound.LOOKAHEAD + n)
        ahead[0][:n] = (x[part, :bands] - means[part, :bands]) / audio.BAND_SCALE_DB
        ahead[1][:n] = spec[part, : g.bins] / np.sqrt(means[part, bands:])
        ok, count = True, own[1] - own[0]
        try:
            gain, taps = (np.asarray(v)[own[0] - start :] for v in model(*ahead))
            ok = gain.shape == (count, bands) and taps.shape == (count, g.bins, sound.FILTER_TAPS)
        except Exception:  # noqa: BLE001 - a failing model falls back, it does not fail the job
            ok = False
        out = {**dict(zip([*KEYS, "chunk"], key, strict=True)), "ok": ok, "first": 0, "body": None, "low": None, "high": None}
        if ok:
            frames = np.fft.irfft(_shape(spec, start, own, gain, taps, g) * g.size, n=g.size, axis=1) * window
            total, weight = (np.zeros((count - 1) * g.hop + g.size) for _ in range(2))
            for i in range(count):
                total[i * g.hop : i * g.hop + g.size] += frames[i]
                weight[i * g.hop : i * g.hop + g.size] += window * window
            begin = own[0] * g.hop - g.front
            a = g.front if own[0] else -begin
            b = len(total) - g.front if own[1] < n_frames else min(len(total), made - begin)
            if own[0]:  # a border may lie behind the last sample
                out["low"] = total[: max(0, min(g.front, made - begin))]
            if own[1] < n_frames:
                out["high"] = total[b : max(b, min(len(total), made - begin))]
            b = max(a, b)
            value = np.where(weight[a:b] > audio.QUIET_WEIGHT, total[a:b] / np.maximum(weight[a:b], audio.QUIET_WEIGHT), 0.0)
            out |= {"first": begin + a, "body": np.clip(value, -1.0, 1.0)}
        return out

    columns = [*KEYS, "chunk", "ok", "first", "body", "low", "high"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Chunks whose lines and means are both there."""
        key = list(zip(*(pdf[k].tolist() for k in [*KEYS, "chunk"]), strict=True))
        entered = {key[i]: np.array(pdf["m"].iat[i], float) for i in np.flatnonzero(pdf["line"].isna())}
        found = []
        for i in np.flatnonzero(pdf["line"].notna()):
            if key[i] in entered:
                made, begin, end, rate, at, width = (int(pdf[c].iat[i]) for c in ("made", "begin", "end", "rate", "at", "width"))
                bank = banks.setdefault(rate, banks.get(rate) or _bank(rate, g))
                found.append(one(key[i], made, begin, _resampled(bank, at, width, pdf["line"].iat[i], begin, end), entered[key[i]]))
        return pd.DataFrame(found, columns=columns)

    # one shuffle brings lines and means of a call together; what it holds is bounded by the size of chunks, not of channels
    steps = lines.agg(F.sum("steps")).first()[0] or 0
    both = lines.drop("steps", "fold").unionByName(means, allowMissingColumns=True).dropna(subset=KEYS)
    call = F.pmod(F.xxhash64(*KEYS, "chunk"), F.lit(max(1, -(-steps * g.hop // CALL_SAMPLES)))).alias("call")
    return both.groupBy(call).applyInPandas(
        run, "clip_id long, ch int, chunk long, ok boolean, first long, body array<double>, low array<double>, high array<double>")


def denoise(samples: DataFrame, rate: int, model: Model, g: Geometry = Geometry()) -> DataFrame:
    """``clip_id, ch, n, v, denoised`` at the target rate, up to the shortest channel of each clip.

    A channel in which the model fails for any chunk keeps its resampled samples, with ``denoised`` false.  Models
    whose memory is no longer than the warm-up give the same samples whatever the chunk.  Keys are not null and
    ``n`` is dense from 0 in every channel.
    """
    lines = cut_lineage(chunk_lines(samples, rate, g))
    done = cut_lineage(replay(lines, running_means(lines, g), model, g))
    failed = done.where("NOT ok").select(*KEYS).distinct()
    shortest = lines.groupBy("clip_id").agg(F.min("made").alias("shared"), F.max("made").alias("longest"))
    uneven = shortest.where("shared < longest").select("clip_id", "shared")
    # a join would write all samples to disk once more, so there is one only where channels fail or differ in length
    some_failed, some_uneven = (not found.isEmpty() for found in (failed, uneven))
    good = done.join(failed, KEYS, "left_anti") if some_failed else done
    window = audio._window(g.size)
    both = [float(a * a + b * b) for a, b in zip(window[: g.front], window[g.size - g.front :], strict=True)]
    body = good.select(*KEYS, "first", F.posexplode("body").alias("i", "v")).select(*KEYS, (F.col("first") + F.col("i")).alias("n"), "v")
    border = lambda at, side: good.where(F.col(side).isNotNull()).select(
        *KEYS, (F.col("chunk") + at).alias("chunk"), F.posexplode(side).alias("i", "v"))
    edges = border(0, "low").unionByName(border(1, "high")).groupBy(*KEYS, "chunk", "i").agg(F.sum("v").alias("v"))
    weight = F.array(*[F.lit(w) for w in both])[F.col("i")]
    n = F.col("chunk") * g.chunk * g.hop - g.front + F.col("i")
    value = F.when(weight > audio.QUIET_WEIGHT, F.col("v") / weight).otherwise(0.0)
    edges = edges.select(*KEYS, n.alias("n"), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), value)).alias("v"))
    new = body.unionByName(edges).withColumn("denoised", F.lit(True))

    bank = _bank(rate, g)

    @F.udf("array<double>")
    def own_part(at: int, width: int, line: bytes, chunk: int, made: int):
        """Samples from the chunk's first frame on to that of the next chunk."""
        return _resampled(bank, at, width, line, chunk * g.chunk * g.hop, min((chunk + 1) * g.chunk * g.hop, made)).tolist()

    every = new
    if some_failed:
        old = lines.join(failed, KEYS, "left_semi").select(
            *KEYS, F.col("chunk"), F.posexplode(own_part("at", "width", "line", "chunk", "made")).alias("i", "v"))
        every = new.unionByName(old.select(*KEYS, (F.col("chunk") * g.chunk * g.hop + F.col("i")).alias("n"), "v", F.lit(False).alias("denoised")))
    if not some_uneven:
        return every
    return every.join(uneven, "clip_id", "left").where(F.col("shared").isNull() | (F.col("n") < F.col("shared"))).drop("shared")


def side_car(spark: SparkSession, folder: str, out: str, rate: int, bits: int, channels: int, model: Model, g: Geometry = Geometry(),
             **read) -> DataFrame:
    """Recordings under ``folder`` to denoised 24-bit recordings under ``out``; returns the manifest of what was written.

    Reads PCM by range, normalises it, denoises it and writes it by commit, so a recording is listed only when
    all of its samples are there.
    """
    samples = recordings.read_pcm_ranges(spark, folder, bits, channels, **read)
    clean = denoise(samples.select(*KEYS, "n", sound.pcm_normalize(F.col("ival"), bits).alias("v")), rate, model, g)
    return recordings.write_pcm(clean.select(*KEYS, "n", sound.quantize_pcm24(F.col("v")).alias("ival")), out, 24)
