"""Recordings as files and the audio job over them (S1, S3, 3.3): the driver's samples are written as PCM and read by range."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from cliploom.catalog.audio import PI, SHAPES, Shape, frames_sql, grid_sql
from cliploom.catalog.common import query, rounded, rounded_sql, views, with_views
from cliploom.functions import sound
from cliploom.operators import audio
from cliploom.plans import audio_job
from cliploom.session import durable_dir
from cliploom.sources import recordings


def _folder(spark, name: str) -> str:
    return f"{durable_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


FILE_FRAMES = 1 << 16  # a file holds so many frames, whatever the block, so files are as many as the clips and 64K of frames


def pcm_folder(spark, sf, view: str, bits: int, block: int) -> str:
    """The samples of a view as PCM recordings."""
    folder = _folder(spark, "pcm")
    recordings.write_pcm(getattr(views, view)(spark, sf).select("clip_id", "ch", "n", "ival"), folder, bits, block, blocks_per_file=-(-FILE_FRAMES // block))
    return folder


def _s1(suffix: str, view: str, bits: int, block: int) -> None:
    @query(f"s1_read_pcm_ranges{suffix}", with_views(view) + f"""
SELECT clip_id, ch, n, ival FROM (SELECT *, count(*) OVER (PARTITION BY clip_id) AS length FROM {view}) q WHERE n < length // {block} * {block}""")
    def _(spark, sf):
        folder = pcm_folder(spark, sf, view, bits, block)
        # ranges far below a file, so that every file is the work of several tasks
        return recordings.read_pcm_ranges(spark, folder, bits, 1, block, range_bytes=2 * block * bits // 8)


_s1("", "samples", 24, 16)
_s1("_full", "long_samples", 16, sound.BLOCK_FRAMES)


@query("s3_listed_write", with_views("packets") + """
SELECT CAST(clip_id AS VARCHAR) AS clip_id, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes FROM packets GROUP BY clip_id""")
def _(spark, sf):
    """Packets written by commit: rows by the manifest, bytes by the files that it lists."""
    folder, packets = _folder(spark, "packets"), views.packets(spark, sf)
    listed = recordings.write_listed(packets, folder).groupBy(F.col("key").alias("clip_id")).agg(F.sum("rows").alias("packets"))
    back = recordings.read_listed(spark, folder, packets.schema)
    sizes = back.groupBy(F.col("clip_id").cast("string").alias("clip_id")).agg(F.sum("size").alias("bytes"))
    return listed.join(sizes, "clip_id")


def stand_in(erb: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A model without state: gains and taps as continuous functions of a frame's features."""
    taps = np.zeros((*unit.shape, sound.FILTER_TAPS), complex)
    taps[:, :, 0], taps[:, :, 4] = 0.125, -0.0625j
    taps[:, :, 2] = np.clip(0.5 + 0.25 * unit.real, 0, 1) + 1j * np.clip(0.25 * unit.imag, -0.5, 0.5)
    return np.clip(0.6 + 0.5 * erb, 0.05, 1), taps


def job_sql(s: Shape, crossings: int) -> str:
    cut, half = 0.95, crossings / 0.95
    init = audio.linspace(audio.BAND_START_DB, audio.BAND_END_DB, len(s.widths))
    unit = audio.linspace(audio.UNIT_START, audio.UNIT_END, s.low)
    edges = [sum(s.widths[:b]) for b in range(len(s.widths))]
    decay = "pow(0.99::DOUBLE, b.t - a.t)"
    frames = frames_sql(s).split("win AS", 1)[1]  # behind the definitions of vals and len
    return with_views(s.view, more=f"""
raw AS MATERIALIZED (SELECT clip_id, ch, n, ival / 32768.0::DOUBLE AS v FROM {s.view}),
rawlen AS (SELECT clip_id, max(n) + 1 AS length FROM raw GROUP BY clip_id),
o AS (SELECT clip_id, unnest(generate_series(0, (length * 160 + 146) // 147 - 1)) AS i FROM rawlen),
tp AS (SELECT clip_id, i, i * 147 // 160 + s AS j, s - (i * 147 % 160) / 160.0::DOUBLE AS d FROM o, (SELECT unnest(generate_series(-{math.ceil(half)}, {math.ceil(half)} + 1)) AS s) q),
h AS (SELECT clip_id, i, j, (d / {half!r}::DOUBLE + 1) / 2 AS u, {cut} * CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE sin({PI} * {cut}::DOUBLE * d) / ({PI} * {cut}::DOUBLE * d) END AS c FROM tp WHERE abs(d) < {half!r}::DOUBLE),
w AS (SELECT clip_id, i, j, c * (0.35875::DOUBLE - 0.48829::DOUBLE * cos(2 * {PI} * u) + 0.14128::DOUBLE * cos(4 * {PI} * u) - 0.01168::DOUBLE * cos(6 * {PI} * u)) AS h FROM h),
vals AS MATERIALIZED (SELECT w.clip_id, 0 AS ch, w.i AS n, sum(h * coalesce(v, 0)) / sum(h) AS v FROM w LEFT JOIN raw s ON s.clip_id = w.clip_id AND s.n = w.j GROUP BY w.clip_id, w.i),
len AS MATERIALIZED (SELECT clip_id, max(n) + 1 AS length FROM vals GROUP BY clip_id),
win AS{frames}, {grid_sql(s)},
bw AS (SELECT * FROM (VALUES {", ".join(f"({b}, {e}, {e + n - 1}, {m!r}::DOUBLE)" for b, (e, n, m) in enumerate(zip(edges, s.widths, init)))}) t(band, lo, hi, m0)),
iu AS (SELECT * FROM (VALUES {", ".join(f"({b}, {u!r}::DOUBLE)" for b, u in enumerate(unit))}) t(k, u0)),
bp AS MATERIALIZED (SELECT clip_id, t, band, 10 * log10(avg(re * re + im * im) + 1e-10::DOUBLE) AS db FROM spec JOIN bw ON k BETWEEN lo AND hi GROUP BY clip_id, t, band),
f1 AS MATERIALIZED (SELECT b.clip_id, b.t, b.band, (b.db - (pow(0.99::DOUBLE, b.t + 1) * m0 + sum(0.01::DOUBLE * {decay} * a.db))) / 40 AS erb
       FROM bp b JOIN bp a ON a.clip_id = b.clip_id AND a.band = b.band AND a.t <= b.t JOIN bw ON bw.band = b.band GROUP BY b.clip_id, b.t, b.band, b.db, m0),
mg AS MATERIALIZED (SELECT clip_id, t, k, re, im, sqrt(re * re + im * im) AS m FROM spec WHERE k < {s.low}),
f2 AS MATERIALIZED (SELECT b.clip_id, b.t, b.k, b.re / sqrt(pow(0.99::DOUBLE, b.t + 1) * u0 + sum(0.01::DOUBLE * {decay} * a.m)) AS ure,
         b.im / sqrt(pow(0.99::DOUBLE, b.t + 1) * u0 + sum(0.01::DOUBLE * {decay} * a.m)) AS uim
       FROM mg b JOIN mg a ON a.clip_id = b.clip_id AND a.k = b.k AND a.t <= b.t JOIN iu ON iu.k = b.k GROUP BY b.clip_id, b.t, b.k, b.re, b.im, u0),
tap AS (SELECT g.clip_id, g.t, iu.k, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + 0.25::DOUBLE * coalesce(ure, 0))) AS cr,
         greatest(-0.5::DOUBLE, least(0.5::DOUBLE, 0.25::DOUBLE * coalesce(uim, 0))) AS ci
       FROM grid g CROSS JOIN iu LEFT JOIN f2 ON f2.clip_id = g.clip_id AND f2.t = g.t + 2 AND f2.k = iu.k),
low AS MATERIALIZED (SELECT m.clip_id, m.t, m.k,
         m.re * cr - m.im * ci + 0.125::DOUBLE * coalesce(p.re, 0) + 0.0625::DOUBLE * coalesce(q.im, 0) AS re,
         m.re * ci + m.im * cr + 0.125::DOUBLE * coalesce(p.im, 0) - 0.0625::DOUBLE * coalesce(q.re, 0) AS im
       FROM mg m JOIN tap USING (clip_id, t, k)
       LEFT JOIN mg p ON p.clip_id = m.clip_id AND p.k = m.k AND p.t = m.t - 2 LEFT JOIN mg q ON q.clip_id = m.clip_id AND q.k = m.k AND q.t = m.t + 2),
gains AS (SELECT s.clip_id, s.t, s.k, s.re, s.im, greatest(0.05::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE + 0.5::DOUBLE * coalesce(erb, 0))) AS g
       FROM spec s JOIN bw ON s.k BETWEEN lo AND hi LEFT JOIN f1 ON f1.clip_id = s.clip_id AND f1.t = s.t + 2 AND f1.band = bw.band WHERE s.k >= {s.low}),
shaped AS MATERIALIZED (SELECT * FROM low UNION ALL SELECT clip_id, t, k, re * pg, im * pg FROM (
   SELECT *, (1.02::DOUBLE * g) / (1 + 0.02::DOUBLE * pow(g / greatest(g * sin({PI} * g * 0.5::DOUBLE), 1e-12::DOUBLE), 2)) AS pg FROM gains) q),
inv AS (SELECT clip_id, t, i, sum(CASE WHEN k = 0 THEN re WHEN k = {s.bins - 1} THEN re * c ELSE 2 * (re * c - im * s) END) AS x FROM shaped JOIN tw USING (k) GROUP BY clip_id, t, i),
ola AS (SELECT clip_id, t * {s.hop} + i - {s.size - s.hop} AS n, sum(x * w) AS acc, sum(w * w) AS wt FROM inv JOIN win USING (i) GROUP BY 1, 2)""") + f"""
SELECT o.clip_id, o.n, {rounded_sql('CASE WHEN wt > 1e-8 THEN least(1.0::DOUBLE, greatest(-1.0::DOUBLE, acc / wt)) ELSE 0 END', 5)} AS v
FROM ola o JOIN len l ON l.clip_id = o.clip_id AND o.n >= 0 AND o.n < l.length"""


def _job(s: Shape, crossings: int, chunk: int, warmup: int) -> None:
    @query(f"job_denoise_recordings{s.suffix}", job_sql(s, crossings))
    def _(spark, sf):
        folder = pcm_folder(spark, sf, s.view, 16, 1)
        g = audio_job.Geometry(s.size, s.hop, s.widths, s.low, chunk, warmup, zero_crossings=crossings)
        samples = recordings.read_pcm_ranges(spark, folder, 16, 1, block=1, range_bytes=1 << 20)
        clips = samples.select("clip_id", "ch", "n", sound.pcm_normalize(F.col("ival"), 16).alias("v"))
        return audio_job.denoise(clips, 44100, stand_in, g).select("clip_id", "n", rounded(F.col("v"), 5).alias("v"))


_job(SHAPES[0], 8, 20, 4)
_job(SHAPES[1], 16, 60, 10)
