"""Sliding frames, spectra, features, filtering, overlap-add, resampling and chunked scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from cliploom.functions import sound
from cliploom.operators import affine, grouped, pairing, segments
from cliploom.session import cut_lineage

KEYS = ["clip_id", "ch"]
FRAMES_PER_CHUNK = 256
OUTPUTS_PER_CHUNK = 16384
NEIGHBOUR_BITS = 10

# Fixed values.
BAND_START_DB, BAND_END_DB, BAND_SCALE_DB = -60.0, -90.0, 40.0
UNIT_START, UNIT_END = 0.001, 0.0001
QUIET_WEIGHT = 1e-8
MODEL_RATE = 48000


def sliding_frames(samples: DataFrame, size: int = sound.FFT_SIZE, hop: int = sound.HOP) -> DataFrame:
    """Each sample in every frame that covers it: ``clip_id, ch, t, i, v``.

    The clip is padded in front by ``size - hop``; a sample's frames follow from its index alone, so
    this is a projection without a shuffle.
    """
    p = F.col("n") + (size - hop)
    first = F.greatest(F.lit(0), F.floor((p - size) / hop) + 1)
    return samples.withColumn("t", F.explode(F.sequence(first, F.floor(p / hop)))).select(
        *KEYS, "t", (p - F.col("t") * hop).alias("i"), "v")


def clip_lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*KEYS).agg((F.max("n") + 1).alias("length"))


def frame_numbers(samples: DataFrame, size: int = sound.FFT_SIZE, hop: int = sound.HOP) -> DataFrame:
    """``clip_id, ch, t``: the frames that :func:`spectra` makes of channels that are dense from 0, by their lengths alone."""
    last = F.floor((F.col("length") + (size - hop)) / hop)
    chunks = clip_lengths(samples).select(*KEYS, last.alias("last"), F.explode(F.sequence(
        F.lit(0).cast("long"), F.shiftright(last, NEIGHBOUR_BITS))).alias("chunk"))
    # a few clips make few rows: their chunks are spread before frames are made of them
    spread = chunks.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS, "chunk")
    first = F.shiftleft("chunk", NEIGHBOUR_BITS)
    return spread.select(*KEYS, F.explode(F.sequence(first, F.least("last", first + ((1 << NEIGHBOUR_BITS) - 1)))).alias("t"))


def _window(size: int) -> np.ndarray:
    s = np.sin(np.pi * (np.arange(size) + 0.5) / size)
    return np.sin(np.pi / 2 * s * s)


def spectra(
    samples: DataFrame, size: int = sound.FFT_SIZE, hop: int = sound.HOP, frames_per_chunk: int = FRAMES_PER_CHUNK
) -> DataFrame:
    """Windowed spectrum of every frame: ``clip_id, ch, t, re ARRAY, im ARRAY``, scaled by ``1/size``.

    Samples go once to the chunk of frames they belong to (a few to two chunks); a chunk is framed
    and transformed with one vectorised FFT.  One zero sample past the end of each clip makes a
    last, empty frame appear as it does in a zero-padded clip.
    """
    front = size - hop
    ends = clip_lengths(samples).select(*KEYS, F.col("length").alias("n"), F.lit(0.0).alias("v"))
    padded = samples.select(*KEYS, "n", "v").unionByName(ends)
    p = F.col("n") + front
    first = F.greatest(F.lit(0), F.floor((p - size) / hop) + 1)
    chunks = F.sequence(F.floor(first / frames_per_chunk), F.floor(F.floor(p / hop) / frames_per_chunk))
    placed = padded.select(*KEYS, p.alias("p"), "v", F.explode(chunks).alias("chunk"))
    window = _window(size)

    def transform(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        at, v, chunks = (rows.column(c).to_numpy() for c in ("p", "v", "chunk"))
        lines, numbers = [], []
        for a, b in zip(ends, ends[1:]):
            place, chunk = at[a:b], int(chunks[a])
            low = max(0, (int(place.min()) - size) // hop + 1)
            t0 = max(chunk * frames_per_chunk, low)
            t1 = min((chunk + 1) * frames_per_chunk - 1, int(place.max()) // hop)
            line = np.zeros((t1 - t0) * hop + size)
            offset = place - t0 * hop
            inside = (offset >= 0) & (offset < len(line))
            line[offset[inside]] = v[a:b][inside]
            lines.append(np.lib.stride_tricks.sliding_window_view(line, size)[::hop])
            numbers.append(np.arange(t0, t1 + 1))
        spec = np.fft.rfft(np.concatenate(lines) * window, axis=1) / size
        row = pa.array(np.repeat(ends[:-1], [len(t) for t in numbers]))
        return pa.RecordBatch.from_arrays(
            [rows.column(k).combine_chunks().take(row) for k in KEYS]
            + [pa.array(np.concatenate(numbers)), grouped.lists(spec.real), grouped.lists(spec.imag)], names=[*KEYS, "t", "re", "im"])

    return grouped.map_groups(
        placed, [*KEYS, "chunk"], [], transform, "clip_id long, ch int, t long, re array<double>, im array<double>")


def _band_edges(widths: Sequence[int]) -> list[int]:
    return [sum(widths[:b]) for b in range(len(widths))]


def band_decibels(re: Column, im: Column, widths: Sequence[int] = sound.BAND_WIDTHS) -> Column:
    """Array of mean power per band in dB."""
    power = F.zip_with(re, im, lambda a, b: a * a + b * b)
    edges = F.array(*[F.struct(F.lit(lo + 1).alias("lo"), F.lit(w).alias("w")) for lo, w in zip(_band_edges(widths), widths)])
    mean = lambda e: F.aggregate(F.slice(power, e["lo"], e["w"]), F.lit(0.0), lambda s, v: s + v) / e["w"]
    return F.transform(edges, lambda e: sound.decibels(mean(e)))


def magnitudes(re: Column, im: Column, bins: int = sound.FILTER_BINS) -> Column:
    return F.zip_with(F.slice(re, 1, bins), F.slice(im, 1, bins), lambda a, b: F.sqrt(a * a + b * b))


def linspace(start: float, stop: float, count: int) -> list[float]:
    return [start + (stop - start) * i / (count - 1) if count > 1 else start for i in range(count)]


def running_mean(
    rows: DataFrame, keys: Sequence[str], index: str, x: Column, init: Sequence[float],
    alpha: float = sound.SMOOTHING, carry: Sequence[str] = (), **kw,
) -> DataFrame:
    """``m <- alpha*m + (1-alpha)*x`` per element of the array ``x``; ``keys, index, m`` and ``carry``."""
    starts = F.array(*[F.lit(float(v)) for v in init])
    b = F.transform(x, lambda v: (1.0 - alpha) * v)
    return affine.affine_scan(rows, keys, index, F.lit(alpha), b, starts, carry, **kw)


def spectral_features(
    spec: DataFrame, widths: Sequence[int] = sound.BAND_WIDTHS, bins: int = sound.FILTER_BINS, **kw
) -> DataFrame:
    """``erb``: (dB - running mean) / 40 per band; ``ure``/``uim``: low bins over the root of the running
    mean of their magnitude.  Both means share their decay, so they run as one scan."""
    bands = len(widths)
    rows = spec.select(
        *KEYS, "t", band_decibels(F.col("re"), F.col("im"), widths).alias("db"),
        F.slice("re", 1, bins).alias("re"), F.slice("im", 1, bins).alias("im"))
    x = F.concat("db", magnitudes(F.col("re"), F.col("im"), bins))
    init = linspace(BAND_START_DB, BAND_END_DB, bands) + linspace(UNIT_START, UNIT_END, bins)
    out = running_mean(rows, KEYS, "t", x, init, carry=["db", "re", "im"], **kw)
    unit = F.slice("m", bands + 1, bins)
    over = lambda c: F.zip_with(c, unit, lambda v, m: v / F.sqrt(m))
    return out.select(
        *KEYS, "t", F.zip_with("db", F.slice("m", 1, bands), lambda v, m: (v - m) / BAND_SCALE_DB).alias("erb"),
        over("re").alias("ure"), over("im").alias("uim"))


def look_ahead(frames: DataFrame, columns: Sequence[str], by: int = sound.LOOKAHEAD) -> DataFrame:
    """Array columns ``by`` frames earlier, zeros at the tail.

    Frame numbers are dense, so a frame simply takes its new number; the last ``by`` frames also
    leave a row of zeros.  No ordering, no window.
    """
    ends = frames.groupBy(*KEYS).agg((F.max("t") + 1).alias("__count"))
    rows = segments.attach(frames.select(*KEYS, "t", *columns), ends, KEYS, F.col("t"))
    moved = F.struct((F.col("t") - by).alias("t"), *[F.col(c) for c in columns])
    zeros = F.struct(F.col("t"), *[F.transform(c, lambda _: F.lit(0.0)).alias(c) for c in columns])
    both = F.array(
        F.when(F.col("t") >= by, moved), F.when(F.col("t") >= F.col("__count") - by, zeros))
    return rows.select(*KEYS, F.explode(F.filter(both, lambda r: r.isNotNull())).alias("r")).select(*KEYS, "r.*")


def with_neighbours(
    rows: DataFrame, keys: Sequence[str], index: str, columns: Sequence[str], offsets: Sequence[int],
    bits: int = NEIGHBOUR_BITS,
) -> DataFrame:
    """``<column>_<j>`` for every offset j: the value ``offsets[j]`` places away on a dense index (null outside).

    Rows near a chunk edge are copied to the neighbouring chunk, so a window never spans more than
    one chunk and its edge copies.
    """
    low, high = min(offsets), max(offsets)
    own = F.shiftright(index, bits)
    chunks = F.sequence(F.shiftright(F.col(index) - max(high, 0), bits), F.shiftright(F.col(index) - min(low, 0), bits))
    spread = rows.withColumn("__chunk", F.explode(chunks))
    by = W.partitionBy(*keys, "__chunk").orderBy(index)
    looked = spread.select(
        "*", *[F.lag(c, -o).over(by).alias(f"{c}_{j}") for c in columns for j, o in enumerate(offsets)])
    return looked.filter(F.col("__chunk") == own).drop("__chunk")


def filter_spectra(
    spec: DataFrame, controls: DataFrame, widths: Sequence[int] = sound.BAND_WIDTHS,
    filter_bins: int = sound.FILTER_BINS, post_filter: bool = True,
) -> DataFrame:
    """Low bins: five-tap complex filter over frames t-2..t+2; other bins: the gain of their band.

    ``controls``: clip_id, ch, t, gain ARRAY(bands), cre/cim ARRAY(filter_bins * 5, bin-major).
    Taps outside the clip are left out.
    """
    gain = F.transform("gain", lambda g: sound.post_filter_gain(g)) if post_filter else F.col("gain")
    count, bins = sound.FILTER_TAPS, sum(widths)
    near = [o - sound.LOOKAHEAD for o in range(count)]
    at = [*KEYS, "t"]
    arrays = {"re": spec, "im": spec, "gain": controls.withColumn("gain", gain), "cre": controls, "cim": controls}
    kinds = {c: table.schema[c].dataType for c, table in arrays.items()}
    value = lambda c, there: (F.col(c) if there else F.lit(None).cast(kinds[c])).alias(c)
    # frames and controls of a chunk meet in one group: a side of a join would be sized without what an explode makes of it
    chunks = F.sequence(F.shiftright(F.col("t") - max(near), NEIGHBOUR_BITS), F.shiftright(F.col("t") - min(near), NEIGHBOUR_BITS))
    frames = spec.select(*at, F.explode(chunks).alias("chunk"), *[value(c, c in ("re", "im")) for c in kinds], F.lit(False).alias("control"))
    wanted = controls.withColumn("gain", gain).select(
        *[F.col(c).try_cast(spec.schema[c].dataType).alias(c) for c in at], *[value(c, c not in ("re", "im")) for c in kinds], F.lit(True).alias("control"))
    wanted = wanted.withColumn("chunk", F.shiftright("t", NEIGHBOUR_BITS).cast(frames.schema["chunk"].dataType))
    rows = frames.unionByName(wanted).dropna(subset=at)

    def shape(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        group, t, control = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), rows.column("t").to_numpy(), rows.column("control").to_numpy()
        place = np.cumsum(np.concatenate([[False], (t[1:] != t[:-1]) | (group[1:] != group[:-1])]))
        frame, chosen = np.flatnonzero(~control), np.flatnonzero(control)
        low, high = (np.searchsorted(place[frame], place[chosen], side) for side in ("left", "right"))
        pick = np.repeat(np.arange(len(chosen)), high - low)  # each control with every frame of its number
        here = np.repeat(low, high - low) + np.arange(len(pick)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        matrix = lambda c, which, width: _matrix(rows.column(c).combine_chunks().take(pa.array(which)), width)
        re, im = matrix("re", frame, bins), matrix("im", frame, bins)
        taps_re, taps_im = (matrix(c, chosen, filter_bins * count).reshape(-1, filter_bins, count)[pick] for c in ("cre", "cim"))
        scale = np.repeat(matrix("gain", chosen, len(widths)), widths, axis=1)[pick]
        out_re, out_im = re[here] * scale, im[here] * scale
        out_re[:, :filter_bins] = out_im[:, :filter_bins] = 0
        own = group[frame]
        for o, step in enumerate(near):
            there = np.clip(here + step, 0, max(0, len(frame) - 1))
            known = ((there == here + step) & (own[there] == own[here]))[:, None]
            a, b = (np.where(known, v[there, :filter_bins], 0.0) for v in (re, im))
            p, q = taps_re[:, :, o], taps_im[:, :, o]
            out_re[:, :filter_bins] += a * p - b * q
            out_im[:, :filter_bins] += a * q + b * p
        ends = pa.array(np.arange(len(here) + 1, dtype=np.int32) * bins)
        keys = [rows.column(c).combine_chunks().take(pa.array(frame[here])) for c in at]
        return pa.RecordBatch.from_arrays(
            [*keys, *[pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (out_re, out_im)]], names=[*at, "re", "im"])

    schema = StructType([spec.schema[c] for c in at]).add("re", ArrayType(DoubleType())).add("im", ArrayType(DoubleType()))
    return grouped.map_groups(rows, [*KEYS, "chunk"], ["t"], shape, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one width as rows; a null list is a row of zeros."""
    out = np.zeros((len(column), width))
    out[np.asarray(column.is_valid())] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def inverse_frames(spec: DataFrame, size: int = sound.FFT_SIZE) -> DataFrame:
    """Time-domain frames times the window: ``clip_id, ch, t, i, v``."""
    window = _window(size)

    @F.arrow_udf(ArrayType(DoubleType()))
    def back(re: pa.Array, im: pa.Array) -> pa.Array:
        full = _matrix(re, size // 2 + 1) + 1j * _matrix(im, size // 2 + 1)
        return grouped.lists(np.fft.irfft(full * size, n=size, axis=1) * window)

    return spec.select(*KEYS, "t", F.posexplode(back("re", "im")).alias("i", "v"))


def overlap_add(frames: DataFrame, lengths: DataFrame, size: int = sound.FFT_SIZE, hop: int = sound.HOP) -> DataFrame:
    """Sum of windowed frames over the sum of squared windows, clamped and trimmed to the clip.

    ``frames``: clip_id, ch, t, i, v with the window already applied.  Both sums are plain
    aggregates, so neighbouring frames combine before the shuffle.
    """
    front = size - hop
    win = F.col("__win")[F.col("i").cast("int")]
    rows = frames.withColumn("__win", F.array(*[F.lit(float(x)) for x in _window(size)]))
    added = rows.groupBy(*KEYS, (F.col("t") * hop + F.col("i") - front).alias("n")).agg(
        F.sum("v").alias("acc"), F.sum(win * win).alias("weight"))
    kept = segments.attach(added.filter("n >= 0"), lengths, KEYS, F.col("n")).filter(F.col("n") < F.col("length"))
    value = F.when(F.col("weight") > QUIET_WEIGHT, F.col("acc") / F.col("weight")).otherwise(0.0)
    return kept.select(*KEYS, "n", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), value)).alias("v"))


def shared_length(original: DataFrame, denoised: DataFrame) -> DataFrame:
    """Samples of every channel up to the shortest channel of its clip.

    A channel whose denoised length differs from the original falls back to the original.
    Both: clip_id, ch, n, v.
    """
    sizes = clip_lengths(original).join(
        clip_lengths(denoised).withColumnRenamed("length", "__got"), KEYS, "left"
    ).withColumn("ok", F.coalesce(F.col("__got") == F.col("length"), F.lit(False)))
    shortest = sizes.groupBy("clip_id").agg(F.min("length").alias("shared"))
    plan = sizes.select(*KEYS, "ok").join(shortest, "clip_id")
    use = lambda df, good: segments.attach(df, plan, KEYS, F.col("n")).filter(
        (F.col("ok") == good) & (F.col("n") < F.col("shared"))).select(*KEYS, "n", "v")
    return use(denoised, True).unionByName(use(original, False))


def mix_down(samples: DataFrame) -> DataFrame:
    """Mean over channels: clip_id, n, v."""
    return samples.groupBy("clip_id", "n").agg(F.avg("v").alias("v"))


def normalize_peak(mono: DataFrame, level: float = 0.5) -> DataFrame:
    """Scale so the largest magnitude of the clip becomes ``level``."""
    peaks = mono.groupBy("clip_id").agg(F.max(F.abs("v")).alias("__peak"))
    rows = segments.attach(mono, peaks, ["clip_id"], F.col("n"))
    return rows.withColumn("v", F.col("v") / (F.col("__peak") + 1e-9) * level).drop("__peak")


def resample_linear(samples: DataFrame, rate: Column, target: int = MODEL_RATE) -> DataFrame:
    """Linear resampling with both ends kept: output i lies at ``i*(len-1)/(count-1)``.

    Every input sample makes exactly the outputs that fall between it and the next sample, in whole
    numbers; the next sample comes from a bounded neighbour window, so nothing is joined.
    """
    sizes = clip_lengths(samples.withColumn("__rate", rate)).select(*KEYS, "length")
    near = with_neighbours(samples.select(*KEYS, "n", "v", rate.alias("__rate")), KEYS, "n", ["v"], [1])
    rows = segments.attach(near, sizes, KEYS, F.col("n"))
    count = sound.idiv(F.col("length") * target, F.col("__rate"))
    rows = rows.withColumn("__out", count).filter("__out > 0")
    gaps, steps = F.col("length") - 1, F.col("__out") - 1
    ceil_at = lambda j: sound.idiv(j * steps + gaps - 1, F.greatest(gaps, F.lit(1)))
    single = (gaps == 0) | (steps == 0)
    lo = F.when(single, F.when(F.col("n") == 0, 0).otherwise(1)).otherwise(ceil_at(F.col("n")))
    hi = F.when(single, F.when(F.col("n") == 0, steps).otherwise(0)).when(F.col("n") == gaps, steps).otherwise(
        ceil_at(F.col("n") + 1) - 1)
    spread = rows.withColumn("__lo", lo).withColumn("__hi", hi).filter("__lo <= __hi").withColumn(
        "i", F.explode(F.sequence("__lo", "__hi")))
    frac = F.when(single, 0.0).otherwise(F.col("i") * gaps % F.greatest(steps, F.lit(1)) / steps)
    blended = F.col("v") + frac * (F.coalesce("v_0", "v") - F.col("v"))
    return spread.select(*KEYS, F.col("i").alias("n"), blended.alias("v"))


def sinc_taps(distance: np.ndarray, cutoff: float, half: float) -> np.ndarray:
    """Low-pass taps at real distances (input samples): sinc under a four-term Blackman-Harris window."""
    u = (distance / half + 1) / 2
    shape = (0.35875 - 0.48829 * np.cos(2 * np.pi * u) + 0.14128 * np.cos(4 * np.pi * u) - 0.01168 * np.cos(6 * np.pi * u))
    return np.where(np.abs(distance) < half, cutoff * np.sinc(cutoff * distance) * shape, 0.0)


class Polyphase:
    """A windowed-sinc resampler whose taps are computed once for each phase.

    Output i lies at input position ``i*down/up``; its fraction repeats after ``up`` outputs.  The outputs of one phase
    are ``down`` input samples apart, so each phase is one matrix product over a strided view.
    """

    def __init__(self, rate: int, target: int, zero_crossings: int = 64, passband: float = 0.95):
        g = math.gcd(rate, target)
        self.up, self.down = target // g, rate // g
        self.cutoff = min(1.0, target / rate) * passband
        self.half = zero_crossings / self.cutoff
        self.reach = math.ceil(self.half) if rate != target else 0
        self.known: dict[int, np.ndarray] = {}

    def taps(self, phase: int) -> np.ndarray:
        if phase not in self.known:
            steps = np.arange(-self.reach, self.reach + 2)
            taps = sinc_taps(steps - (phase * self.down % self.up) / self.up, self.cutoff, self.half)
            self.known[phase] = taps / taps.sum()
        return self.known[phase]

    def resample(self, at: np.ndarray, values: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Outputs from ``begin`` to before ``end``, of input samples ``values`` at places ``at``; others are zero."""
        if end <= begin:
            return np.zeros(0)
        whole = lambda i: i * self.down // self.up
        base = whole(begin) - self.reach
        line = np.zeros(whole(end - 1) + self.reach + 2 - base)
        place = at - base
        inside = (place >= 0) & (place < len(line))
        line[place[inside]] = values[inside]
        if not self.reach:  # one rate
            return line[: end - begin]
        views = np.lib.stride_tricks.sliding_window_view(line, 2 * self.reach + 2)
        out = np.empty(end - begin)
        for first in range(begin, min(begin + self.up, end)):
            picked = views[whole(first) - self.reach - base :: self.down]
            n = len(range(first, end, self.up))
            out[first - begin :: self.up] = picked[:n] @ self.taps(first % self.up)
        return out


def resample_band_limited(
    samples: DataFrame, rate: int, target: int = MODEL_RATE, zero_crossings: int = 64, passband: float = 0.95,
    outputs_per_chunk: int = OUTPUTS_PER_CHUNK,
) -> DataFrame:
    """Band-limited resampling by a windowed-sinc polyphase filter.

    Output i lies at input position ``i*rate/target``; there are ``ceil(len*target/rate)`` outputs.
    An input sample goes to the output chunk(s) its taps reach, and a chunk is a matrix product for each phase.
    """
    bank = Polyphase(rate, target, zero_crossings, passband)
    up, down, reach = bank.up, bank.down, bank.reach
    ends = clip_lengths(samples).select(*KEYS, F.col("length"))
    last = lambda j: F.floor(j * up / down)
    rows = segments.attach(samples.select(*KEYS, "n", "v"), ends, KEYS, F.col("n"))
    total = F.ceil(F.col("length") * up / down)
    first_out = F.greatest(F.lit(0), last(F.col("n") - reach) - 1)
    last_out = F.least(total - 1, last(F.col("n") + reach) + 1)
    placed = rows.withColumn("__total", total).filter(first_out <= last_out).withColumn("chunk", F.explode(F.sequence(
        F.floor(first_out / outputs_per_chunk), F.floor(last_out / outputs_per_chunk)))).drop("length")

    def convolve(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        n, v, chunks, totals = (rows.column(c).to_numpy() for c in ("n", "v", "chunk", "__total"))
        places, values = [], []
        for a, b in zip(ends, ends[1:]):
            first = int(chunks[a]) * outputs_per_chunk
            i = np.arange(first, min(first + outputs_per_chunk, int(totals[a])), dtype=np.int64)
            places.append(i)
            values.append(bank.resample(n[a:b], v[a:b], int(i[0]), int(i[-1]) + 1))
        row = pa.array(np.repeat(ends[:-1], [len(i) for i in places]))
        return pa.RecordBatch.from_arrays(
            [rows.column(k).combine_chunks().take(row) for k in KEYS]
            + [pa.array(np.concatenate(places)), pa.array(np.concatenate(values), from_pandas=True)], names=[*KEYS, "n", "v"])

    return grouped.map_groups(placed, [*KEYS, "chunk"], [], convolve, "clip_id long, ch int, n long, v double")


def score_chunks(
    frames: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], value: str = "v",
    chunk: int = sound.CHUNK_FRAMES, warmup: int = sound.WARMUP_FRAMES, strict: bool = False,
) -> DataFrame:
    """Run ``fn`` over chunks with warm-up frames in front; keep only each chunk's own frames.

    ``fn`` gets one chunk ordered by ``t`` and returns one value per row.  If it fails for any chunk of a
    channel, the whole channel keeps its original values; ``failed_chunks`` says how many did, and with
    ``strict`` an error in ``fn`` ends the job instead.  Scores are written once to the checkpoint folder,
    so the model runs once per chunk.  ``frames``: clip_id, ch, t, value.
    """
    planned = pairing.chunk_with_warmup(frames.select(*KEYS, "t", F.col(value).cast("double").alias("v")), chunk, warmup)

    def run(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        whole = rows.to_pandas() if not any(rows.column(k).null_count for k in KEYS) else None
        own, v = (rows.column(c).to_numpy() for c in ("keep", "v"))
        scores, fine = np.array(v), np.zeros(len(v), bool)
        for a, b in zip(ends, ends[1:]):
            pdf = rows.slice(a, b - a).to_pandas() if whole is None else whole.iloc[a:b].reset_index(drop=True)
            try:
                got = np.asarray(pd.Series(np.asarray(fn(pdf), dtype=float)))
                if len(got) == b - a:
                    scores[a:b], fine[a:b] = got, True
            except Exception:  # noqa: BLE001 - a failing model falls back, it does not fail the job
                if strict:
                    raise
        kept = rows.filter(pa.array(own)).combine_chunks()
        column = lambda c: kept.column(c).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [column("clip_id"), column("ch"), column("t"), pa.array(v[own], from_pandas=True), pa.array(scores[own], from_pandas=True),
             pa.array(fine[own]), column("chunk")], names=["clip_id", "ch", "t", "v", "score", "ok", "chunk"])

    scored = cut_lineage(grouped.map_groups(
        planned, [*KEYS, "chunk"], ["t"], run, "clip_id long, ch int, t long, v double, score double, ok boolean, chunk long"))
    good = scored.groupBy(*KEYS).agg(
        F.bool_and("ok").alias("__good"), F.count_distinct(F.when(~F.col("ok"), F.col("chunk"))).alias("failed_chunks"))
    rows = segments.attach(scored, good, KEYS, F.col("t"))
    return rows.select(*KEYS, "t", F.when(F.col("__good"), F.col("score")).otherwise(F.col("v")).alias(value), "failed_chunks")
