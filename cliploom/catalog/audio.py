"""Signal operators (W4-W7, A12, A16, A19, A20, M1-M6). Small frames keep the checking SQL exact and whole-table."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import functions as F

from cliploom.catalog.common import query, rounded, rounded_sql, views, with_views
from cliploom.functions import sound
from cliploom.operators import audio
from cliploom.plans import denoise
from cliploom.session import written


@dataclass(frozen=True)
class Shape:
    """Frame geometry of a set of signal queries and the view their samples come from."""

    suffix: str
    size: int
    widths: tuple[int, ...]
    low: int
    view: str

    @property
    def hop(self) -> int:
        return self.size // 2

    @property
    def bins(self) -> int:
        return self.hop + 1

    def values(self, spark, sf):
        rows = getattr(views, self.view)(spark, sf)
        return rows.select("clip_id", "ch", "n", (F.col("ival") / 32768.0).alias("v"))

    def clips(self, spark, sf):
        """``values`` ranked once: samples are read for their frames, for the lengths of clips and for the frames' numbers."""
        return written(self.values(spark, sf), "clips")

    def sql(self, more: str) -> str:
        """``more`` over a view named samples."""
        text = with_views(self.view, more=more)
        return text if self.view == "samples" else text.replace("FROM samples)", f"FROM {self.view})", 1)


# small frames over many short clips, and the sizes recordings really have over few long ones
SHAPES = (
    Shape("", 16, (1, 2, 2, 4), 4, "samples"),
    Shape("_full", sound.FFT_SIZE, tuple(sound.BAND_WIDTHS), sound.FILTER_BINS, "long_samples"),
)
PI = "3.141592653589793::DOUBLE"

VALUES_SQL = "vals AS (SELECT clip_id, ch, n, ival / 32768.0::DOUBLE AS v FROM samples)"
LENGTH_SQL = "len AS (SELECT clip_id, max(n) + 1 AS length FROM vals GROUP BY clip_id)"


def values(spark, sf):
    return views.samples(spark, sf).select("clip_id", "ch", "n", (F.col("ival") / 32768.0).alias("v"))


def frames_sql(s: Shape) -> str:
    window = f"""win AS (SELECT i, sin({PI} / 2 * sin({PI} * (i + 0.5::DOUBLE) / {s.size}) * sin({PI} * (i + 0.5::DOUBLE) / {s.size})) AS w FROM (SELECT unnest(generate_series(0, {s.size - 1})) AS i) q)"""
    return f"""
{VALUES_SQL}, {LENGTH_SQL}, {window},
fr AS (SELECT clip_id, ch, t, n + {s.size - s.hop} - t * {s.hop} AS i, v FROM (
   SELECT clip_id, ch, n, v, (n + {s.size - s.hop}) // {s.hop} - d AS t FROM vals, (VALUES (0), (1)) o(d)) q WHERE t >= 0)"""


# every frame number a clip has, also a last one that holds no sample
def grid_sql(s: Shape) -> str:
    return f"""
grid AS (SELECT clip_id, unnest(generate_series(0, ({s.size - s.hop} + length) // {s.hop})) AS t FROM len),
tw AS (SELECT k, i, cos(2 * {PI} * ((k * i) % {s.size}) / {s.size}) AS c, sin(2 * {PI} * ((k * i) % {s.size}) / {s.size}) AS s
       FROM (SELECT unnest(generate_series(0, {s.bins - 1})) AS k) a, (SELECT unnest(generate_series(0, {s.size - 1})) AS i) b),
ks AS (SELECT DISTINCT k FROM tw),
dft AS MATERIALIZED (SELECT clip_id, t, k, sum(v * w * c) / {s.size} AS re, -sum(v * w * s) / {s.size} AS im
        FROM fr JOIN win USING (i) JOIN tw USING (i) GROUP BY clip_id, t, k),
spec AS MATERIALIZED (SELECT g.clip_id, g.t, ks.k, coalesce(re, 0.0::DOUBLE) AS re, coalesce(im, 0.0::DOUBLE) AS im
         FROM grid g CROSS JOIN ks LEFT JOIN dft d ON d.clip_id = g.clip_id AND d.t = g.t AND d.k = ks.k)"""


def bands_sql(s: Shape) -> str:
    edges = [sum(s.widths[:b]) for b in range(len(s.widths))]
    return f"""
bw AS (SELECT * FROM (VALUES {", ".join(f"({b}, {e}, {e + w - 1})" for b, (e, w) in enumerate(zip(edges, s.widths)))}) t(band, lo, hi)),
bp AS (SELECT clip_id, t, band, 10 * log10(avg(re * re + im * im) + 1e-10::DOUBLE) AS db FROM spec JOIN bw ON k BETWEEN lo AND hi GROUP BY clip_id, t, band)"""


@query("w6_running_mean", with_views("samples", more=f"{VALUES_SQL}") + f"""
SELECT b.clip_id, b.n, {rounded_sql("(b.v * 100 - (pow(0.99::DOUBLE, b.n + 1) * -60.0::DOUBLE + sum(0.01::DOUBLE * pow(0.99::DOUBLE, b.n - a.n) * a.v * 100))) / 40", 4)} AS feature
FROM vals a JOIN vals b ON a.clip_id = b.clip_id AND a.n <= b.n GROUP BY b.clip_id, b.n, b.v""")
def _(spark, sf):
    x = values(spark, sf).select("clip_id", "ch", "n", (F.col("v") * 100).alias("x"))
    out = audio.running_mean(x, ["clip_id", "ch"], "n", F.array("x"), [-60.0], carry=["x"])
    return out.select("clip_id", "n", rounded((F.col("x") - F.col("m")[0]) / 40, 4).alias("feature"))


@query("w4_look_ahead", with_views("samples", more=VALUES_SQL) + """
SELECT clip_id, n AS t, lead(v, 2, 0.0::DOUBLE) OVER (PARTITION BY clip_id ORDER BY n) AS v FROM vals""")
def _(spark, sf):
    frames = values(spark, sf).select("clip_id", "ch", F.col("n").alias("t"), F.array("v").alias("x"))
    return audio.look_ahead(frames, ["x"]).select("clip_id", "t", F.col("x")[0].alias("v"))


def controls(spec, s: Shape):
    """Made-up gains and coefficients as functions of clip, frame, bin and tap."""
    t, c = F.col("t"), F.col("clip_id")
    gain = F.transform(F.sequence(F.lit(0), F.lit(len(s.widths) - 1)), lambda b: (1 + (t + c + b) % 10) / 10.0)
    at = F.sequence(F.lit(0), F.lit(s.low * 5 - 1))
    cre = F.transform(at, lambda j: ((t + j * 3) % 7 - 3) / 5.0)
    cim = F.transform(at, lambda j: ((c + t * 2 + j) % 5 - 2) / 8.0)
    return spec.select("clip_id", "ch", "t", gain.alias("gain"), cre.alias("cre"), cim.alias("cim"))


def control_sql(s: Shape) -> str:
    return f"""
taps AS (SELECT unnest(generate_series(0, 4)) AS o),
reached AS MATERIALIZED (
   SELECT clip_id, k, o, t + 2 - o AS t, re, im FROM spec, taps WHERE k < {s.low}),
coef AS MATERIALIZED (
   SELECT r.clip_id, r.t, r.k, r.re, r.im, ((r.t + (r.k * 5 + o) * 3) % 7 - 3) / 5.0::DOUBLE AS cr,
          ((r.clip_id + r.t * 2 + r.k * 5 + o) % 5 - 2) / 8.0::DOUBLE AS ci
   FROM reached r SEMI JOIN spec s ON s.clip_id = r.clip_id AND s.k = r.k AND s.t = r.t),
lowbins AS MATERIALIZED (SELECT clip_id, t, k, sum(re * cr - im * ci) AS re, sum(re * ci + im * cr) AS im FROM coef GROUP BY 1, 2, 3),
gains AS (SELECT clip_id, t, k, re, im, (1 + (t + clip_id + band) % 10) / 10.0::DOUBLE AS g FROM spec JOIN bw ON k BETWEEN lo AND hi WHERE k >= {s.low}),
shaped AS (SELECT * FROM lowbins UNION ALL SELECT clip_id, t, k, re * pg, im * pg FROM (
   SELECT *, (1.02::DOUBLE * g) / (1 + 0.02::DOUBLE * pow(g / greatest(g * sin({PI} * g * 0.5::DOUBLE), 1e-12::DOUBLE), 2)) AS pg FROM gains) q)"""


@query("a19_shared_length", with_views("samples", more=f"""{VALUES_SQL},
o AS (SELECT clip_id, CAST(n % 2 AS INT) AS ch, n // 2 AS n, v FROM vals),
l AS (SELECT clip_id, min(c) AS shared FROM (SELECT clip_id, ch, count(*) AS c FROM o GROUP BY 1, 2) q GROUP BY 1)""") + """
SELECT clip_id, ch, n, CASE WHEN clip_id % 3 = 0 AND ch = 1 THEN v ELSE v / 2 END AS v FROM o JOIN l USING (clip_id) WHERE n < shared""")
def _(spark, sf):
    n = F.col("n")
    original = values(spark, sf).select("clip_id", (n % 2).cast("int").alias("ch"), F.floor(n / 2).alias("n"), "v")
    failed = (F.col("clip_id") % 3 == 0) & (F.col("ch") == 1)
    denoised = original.filter(~failed | (F.col("n") % 2 == 0)).filter(~failed | (F.col("n") < 50)).withColumn("v", F.col("v") / 2)
    return audio.shared_length(original, denoised)


@query("a20_mix_and_normalize", with_views("samples", more=f"""{VALUES_SQL},
m AS (SELECT clip_id, n // 2 AS n, avg(v) AS v FROM vals GROUP BY clip_id, n // 2),
p AS (SELECT clip_id, max(abs(v)) AS peak FROM m GROUP BY clip_id)""") + f"""
SELECT clip_id, n, {rounded_sql('v / (peak + 1e-9::DOUBLE) * 0.5::DOUBLE')} AS v FROM m JOIN p USING (clip_id)""")
def _(spark, sf):
    n = F.col("n")
    stereo = values(spark, sf).select("clip_id", (n % 2).cast("int").alias("ch"), F.floor(n / 2).alias("n"), "v")
    return audio.normalize_peak(audio.mix_down(stereo)).select("clip_id", "n", rounded(F.col("v")).alias("v"))


@query("m1_resample_linear", with_views("samples", more=f"""{VALUES_SQL}, {LENGTH_SQL},
r AS (SELECT clip_id, length, length * 48000 // CASE WHEN clip_id % 2 = 0 THEN 44100 ELSE 96000 END AS cnt FROM len),
o AS (SELECT clip_id, length, cnt, unnest(generate_series(0, cnt - 1)) AS i FROM r),
x AS (SELECT *, i * (length - 1) // (cnt - 1) AS j, (i * (length - 1) % (cnt - 1)) / CAST(cnt - 1 AS DOUBLE) AS f FROM o)""") + f"""
SELECT x.clip_id, x.i AS n, {rounded_sql('a.v + f * (coalesce(b.v, a.v) - a.v)')} AS v FROM x
JOIN vals a ON a.clip_id = x.clip_id AND a.n = x.j LEFT JOIN vals b ON b.clip_id = x.clip_id AND b.n = x.j + 1""")
def _(spark, sf):
    rate = F.when(F.col("clip_id") % 2 == 0, 44100).otherwise(96000)
    return audio.resample_linear(values(spark, sf), rate).select("clip_id", "n", rounded(F.col("v")).alias("v"))


_CUT = 0.95


def _m2(crossings: int, suffix: str) -> None:
    half = crossings / _CUT

    @query(f"m2_resample_band_limited{suffix}", with_views("samples", more=f"""{VALUES_SQL}, {LENGTH_SQL},
o AS (SELECT clip_id, unnest(generate_series(0, (length * 160 + 146) // 147 - 1)) AS i FROM len),
tp AS (SELECT clip_id, i, i * 147 // 160 + s AS j, s - (i * 147 % 160) / 160.0::DOUBLE AS d FROM o, (SELECT unnest(generate_series(-{math.ceil(half)}, {math.ceil(half)} + 1)) AS s) q),
h AS (SELECT clip_id, i, j, (d / {half!r}::DOUBLE + 1) / 2 AS u, {_CUT} * CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE sin({PI} * {_CUT}::DOUBLE * d) / ({PI} * {_CUT}::DOUBLE * d) END AS c FROM tp WHERE abs(d) < {half!r}::DOUBLE),
w AS (SELECT clip_id, i, j, c * (0.35875::DOUBLE - 0.48829::DOUBLE * cos(2 * {PI} * u) + 0.14128::DOUBLE * cos(4 * {PI} * u) - 0.01168::DOUBLE * cos(6 * {PI} * u)) AS h FROM h)""") + f"""
SELECT w.clip_id, w.i AS n, {rounded_sql('sum(h * coalesce(v, 0)) / sum(h)')} AS v FROM w LEFT JOIN vals s ON s.clip_id = w.clip_id AND s.n = w.j GROUP BY w.clip_id, w.i""")
    def _(spark, sf):
        out = audio.resample_band_limited(values(spark, sf), 44100, zero_crossings=crossings, passband=_CUT)
        return out.select("clip_id", "n", rounded(F.col("v")).alias("v"))


_m2(8, "")
_m2(64, "_full")


def _halve(chunk):
    """A stand-in model without state; it refuses some clips."""
    if (chunk["clip_id"].iloc[0] % 7 == 3) and chunk["t"].max() > 300:
        raise ValueError("model refused")
    return chunk["v"] * 0.5


def _m6(chunk: int, warmup: int, suffix: str, view: str) -> None:
    sql = with_views(view, more=f"{VALUES_SQL}, {LENGTH_SQL}").replace("FROM samples)", f"FROM {view})", 1)

    @query(f"m6_score_chunks{suffix}", sql + """
SELECT clip_id, n AS t, CASE WHEN clip_id % 7 = 3 AND length > 301 THEN v ELSE v * 0.5::DOUBLE END AS v FROM vals JOIN len USING (clip_id)""")
    def _(spark, sf):
        frames = getattr(views, view)(spark, sf).select("clip_id", "ch", F.col("n").alias("t"), (F.col("ival") / 32768.0).alias("v"))
        return audio.score_chunks(written(frames, "clips"), _halve, chunk=chunk, warmup=warmup).select("clip_id", "t", "v")


_m6(200, 10, "", "samples")
_m6(sound.CHUNK_FRAMES, sound.WARMUP_FRAMES, "_full", "long_samples")


def _features_sql(s: Shape) -> str:
    init = audio.linspace(audio.BAND_START_DB, audio.BAND_END_DB, len(s.widths))
    unit = audio.linspace(audio.UNIT_START, audio.UNIT_END, s.low)
    value = lambda a, b: f"{a[b]!r}::DOUBLE" if b < len(a) else "NULL::DOUBLE"
    starts = ", ".join(f"({b}, {value(init, b)}, {value(unit, b)})" for b in range(max(len(init), len(unit))))
    erb, ure, uim = (rounded_sql(f"coalesce({c}, 0)", 4) for c in ("f", "ure", "uim"))
    return s.sql(frames_sql(s) + "," + grid_sql(s) + "," + bands_sql(s) + f""",
i0 AS (SELECT * FROM (VALUES {starts}) t(band, m0, u0)),
f1 AS (SELECT b.clip_id, b.t, b.band, (b.db - (pow(0.99::DOUBLE, b.t + 1) * m0 + sum(0.01::DOUBLE * pow(0.99::DOUBLE, b.t - a.t) * a.db))) / 40 AS f
       FROM bp b JOIN bp a ON a.clip_id = b.clip_id AND a.band = b.band AND a.t <= b.t JOIN i0 ON i0.band = b.band GROUP BY b.clip_id, b.t, b.band, b.db, m0),
f2 AS (SELECT b.clip_id, b.t, b.k AS band, b.re / sqrt(pow(0.99::DOUBLE, b.t + 1) * u0 + sum(0.01::DOUBLE * pow(0.99::DOUBLE, b.t - a.t) * sqrt(a.re * a.re + a.im * a.im))) AS ure,
         b.im / sqrt(pow(0.99::DOUBLE, b.t + 1) * u0 + sum(0.01::DOUBLE * pow(0.99::DOUBLE, b.t - a.t) * sqrt(a.re * a.re + a.im * a.im))) AS uim
       FROM spec b JOIN spec a ON a.clip_id = b.clip_id AND a.k = b.k AND a.t <= b.t JOIN i0 ON i0.band = b.k WHERE b.k < {s.low} GROUP BY b.clip_id, b.t, b.k, b.re, b.im, u0)""") + f"""
SELECT g.clip_id, g.t, CAST(i0.band AS INT) AS band, CASE WHEN m0 IS NOT NULL THEN {erb} END AS erb,
  CASE WHEN u0 IS NOT NULL THEN {ure} END AS ure, CASE WHEN u0 IS NOT NULL THEN {uim} END AS uim
FROM grid g CROSS JOIN i0 LEFT JOIN f1 ON f1.clip_id = g.clip_id AND f1.t = g.t + 2 AND f1.band = i0.band
LEFT JOIN f2 ON f2.clip_id = g.clip_id AND f2.t = g.t + 2 AND f2.band = i0.band"""


def _signal_queries(s: Shape) -> None:
    """W7, M3, A12, W5, A16, M4 and M5 at one frame geometry."""
    spectrum = frames_sql(s) + "," + grid_sql(s)
    shaped = spectrum + "," + bands_sql(s) + "," + control_sql(s)

    def bins_of(out):
        rows = out.select("clip_id", "t", F.posexplode(F.arrays_zip("re", "im")).alias("k", "c"))
        return rows.select("clip_id", "t", "k", rounded(F.col("c.re")).alias("re"), rounded(F.col("c.im")).alias("im"))

    def spectra(spark, sf):
        return audio.spectra(s.clips(spark, sf), s.size, s.hop)

    @query(f"w7_sliding_frames{s.suffix}", s.sql(frames_sql(s)) + "SELECT clip_id, t, i, v FROM fr")
    def _(spark, sf):
        return audio.sliding_frames(s.values(spark, sf), s.size, s.hop).select("clip_id", "t", "i", "v")

    @query(f"m3_spectra{s.suffix}", s.sql(spectrum) + f"""
SELECT clip_id, t, CAST(k AS INT) AS k, {rounded_sql('re')} AS re, {rounded_sql('im')} AS im FROM spec""")
    def _(spark, sf):
        return bins_of(spectra(spark, sf))

    @query(f"a12_band_decibels{s.suffix}", s.sql(spectrum + "," + bands_sql(s)) + f"""
SELECT clip_id, t, CAST(band AS INT) AS band, {rounded_sql('db', 4)} AS db FROM bp""")
    def _(spark, sf):
        db = audio.band_decibels(F.col("re"), F.col("im"), s.widths)
        rows = spectra(spark, sf).select("clip_id", "t", F.posexplode(db).alias("band", "db"))
        return rows.select("clip_id", "t", "band", rounded(F.col("db"), 4).alias("db"))

    @query(f"w5_filter_spectra{s.suffix}", s.sql(shaped) + f"""
SELECT clip_id, t, CAST(k AS INT) AS k, {rounded_sql('re')} AS re, {rounded_sql('im')} AS im FROM shaped""")
    def _(spark, sf):
        clip = s.clips(spark, sf)
        frames, spec = audio.frame_numbers(clip, s.size, s.hop), audio.spectra(clip, s.size, s.hop)
        return bins_of(audio.filter_spectra(spec, controls(frames, s), s.widths, s.low))

    @query(f"a16_overlap_add{s.suffix}", s.sql(VALUES_SQL) + f"""
SELECT clip_id, n, {rounded_sql('least(1.0::DOUBLE, greatest(-1.0::DOUBLE, v * 2))')} AS v FROM vals""")
    def _(spark, sf):
        clip = s.values(spark, sf)
        frames = audio.sliding_frames(clip, s.size, s.hop)
        # windowed twice, so the sum over the squared window gives the doubled input back
        win = F.array(*[F.lit(float(x)) for x in audio._window(s.size)])[F.col("i").cast("int")]
        twice = frames.withColumn("v", F.col("v") * 2 * win * win)
        out = audio.overlap_add(twice, audio.clip_lengths(clip), s.size, s.hop)
        return out.select("clip_id", "n", rounded(F.col("v")).alias("v"))

    @query(f"m4_features{s.suffix}", _features_sql(s))
    def _(spark, sf):
        out = denoise.features(s.clips(spark, sf), s.size, s.hop, s.widths, s.low)
        rows = out.select("clip_id", "t", F.posexplode(F.arrays_zip("erb", "ure", "uim")).alias("band", "f"))
        return rows.select("clip_id", "t", "band", *[rounded(F.col(f"f.{c}"), 4).alias(c) for c in ("erb", "ure", "uim")])

    @query(f"m5_resynthesize{s.suffix}", s.sql(shaped + f""",
inv AS (SELECT clip_id, t, i, sum(CASE WHEN k = 0 THEN re WHEN k = {s.bins - 1} THEN re * c ELSE 2 * (re * c - im * s) END) AS x FROM shaped JOIN tw USING (k) GROUP BY clip_id, t, i),
ola AS (SELECT clip_id, t * {s.hop} + i - {s.size - s.hop} AS n, sum(x * w) AS acc, sum(w * w) AS wt FROM inv JOIN win USING (i) GROUP BY 1, 2)""") + f"""
SELECT o.clip_id, o.n, {rounded_sql('CASE WHEN wt > 1e-8 THEN least(1.0::DOUBLE, greatest(-1.0::DOUBLE, acc / wt)) ELSE 0 END', 5)} AS v
FROM ola o JOIN len l ON l.clip_id = o.clip_id AND o.n >= 0 AND o.n < l.length""")
    def _(spark, sf):
        clip = s.clips(spark, sf)
        frames = audio.frame_numbers(clip, s.size, s.hop)
        out = denoise.resynthesize(clip, controls(frames, s), s.size, s.hop, s.widths, s.low)
        return out.select("clip_id", "n", rounded(F.col("v"), 5).alias("v"))


for _shape in SHAPES:
    _signal_queries(_shape)
