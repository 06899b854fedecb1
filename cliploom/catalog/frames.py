"""Image neighbourhood operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.catalog.common import query, rounded, rounded_sql, views, with_views
from cliploom.catalog.scalars import _ccm_sql, _pq_sql, device_matrices
from cliploom.functions import pixel
from cliploom.operators import frames, scalars
from cliploom.plans import develop

MIRROR = "CASE WHEN abs({0}) > 31 THEN 62 - abs({0}) ELSE abs({0}) END"


def _taps_sql() -> str:
    rows = []
    for py in (0, 1):
        for px in (0, 1):
            for c in "RGB":
                for (dy, dx), weight in frames.taps_for("RGGB", py, px, c).items():
                    rows.append(f"({py}, {px}, '{c}', {dy}, {dx}, {weight / 8})")
    return f"taps AS (SELECT * FROM (VALUES {', '.join(rows)}) t(py, px, c, dy, dx, wt))"


NORM_SQL = "norm AS (SELECT image_id, y, x, greatest((v + 1500) / 3000.0::DOUBLE, 0.0::DOUBLE) AS v FROM images)"


def normalized(spark, sf):
    v = F.greatest((F.col("v") + 1500) / 3000.0, F.lit(0.0))
    return views.images(spark, sf).select("image_id", "y", "x", v.alias("v"))


DEMOSAIC_SQL = f"""{NORM_SQL}, {_taps_sql()},
st AS (SELECT n.image_id, n.y, n.x, c, sum(wt * m.v) AS s FROM norm n JOIN taps ON py = n.y % 2 AND px = n.x % 2
  JOIN norm m ON m.image_id = n.image_id AND m.y = {MIRROR.format("(n.y + dy)")} AND m.x = {MIRROR.format("(n.x + dx)")} GROUP BY ALL),
rgb AS (SELECT image_id, y, x, max(s) FILTER (WHERE c = 'R') AS r, max(s) FILTER (WHERE c = 'G') AS g, max(s) FILTER (WHERE c = 'B') AS b FROM st GROUP BY image_id, y, x)"""


@query("m8_demosaic", with_views("images", more=DEMOSAIC_SQL) + f"""
SELECT image_id, y, x, {rounded_sql('r', 9)} AS r, {rounded_sql('g', 9)} AS g, {rounded_sql('b', 9)} AS b FROM rgb""")
def _(spark, sf):
    out = frames.demosaic(normalized(spark, sf), 32, 32)
    return out.select("image_id", "y", "x", *[rounded(F.col(c), 9).alias(c) for c in "rgb"])


@query("m8_develop_frames", with_views("images", more=DEMOSAIC_SQL + "," + _ccm_sql()) + "SELECT image_id, y, x, "
       + ", ".join(rounded_sql(_pq_sql(f"0.1::DOUBLE * (c{3 * i} * r * 1.25::DOUBLE + c{3 * i + 1} * g + c{3 * i + 2} * b * 2)"), 4) + f" AS {n}"
                   for i, n in enumerate(("r_pq", "g_pq", "b_pq"))) + " FROM rgb JOIN ccm ON p_partkey = image_id % 200")
def _(spark, sf):
    devices = scalars.derive_colour_matrix(device_matrices(spark, sf)).withColumn(
        "gains", F.array(*[pixel.gain_from_neutral(F.lit(n)) for n in (0.8, 1.0, 0.5)]))
    im = normalized(spark, sf)
    owner = im.select("image_id").distinct().withColumn("device", F.col("image_id") % 200)
    out = develop.develop_frames(im, devices, owner, 32, 32)
    return out.select("image_id", "y", "x", *[rounded(F.col(c), 4).alias(c) for c in ("r_pq", "g_pq", "b_pq")])


def clip_frames(spark, sf):
    """Eight images in a row make a clip."""
    i = F.col("image_id")
    ids = views.images(spark, sf).select("image_id").distinct()
    idx = i % 8
    return ids.select(
        F.floor(i / 8).cast("long").alias("clip_id"), i.alias("frame_id"), idx.alias("idx"),
        F.when(idx >= 1, i - 1).otherwise(i).alias("past0"),
        F.when(idx >= 2, i - 2).when(idx >= 1, i - 1).otherwise(i).alias("past1"),
        F.when(idx % 3 == 2, 0.5).otherwise(1.0).alias("trust"))


PATCH = "(VALUES (-2), (0), (2))"


# squared differences once per source and offset, on two more rows and columns at each side; patches are
# sums of three in steps of two along either axis
@query("m9_non_local_means", with_views("images", more=f"""{NORM_SQL},
hist AS (SELECT image_id, unnest(list_distinct([image_id, CASE WHEN image_id % 8 >= 1 THEN image_id - 1 ELSE image_id END,
           CASE WHEN image_id % 8 >= 2 THEN image_id - 2 WHEN image_id % 8 >= 1 THEN image_id - 1 ELSE image_id END])) AS src
         FROM (SELECT DISTINCT image_id FROM images) q),
axis AS (SELECT unnest(generate_series(-2, 33)) AS p),
offs AS (SELECT unnest(generate_series(-4, 4, 2)) AS o),
here AS MATERIALIZED (SELECT image_id, ay.p AS ey, ax.p AS ex, v FROM axis ay, axis ax JOIN norm
         ON y = {MIRROR.format("ay.p")} AND x = {MIRROR.format("ax.p")}),
there AS MATERIALIZED (SELECT image_id AS src, ay.p AS ey, ax.p AS ex, oy.o AS oy, ox.o AS ox, v FROM axis ay, axis ax, offs oy, offs ox JOIN norm
         ON y = {MIRROR.format("(ay.p + oy.o)")} AND x = {MIRROR.format("(ax.p + ox.o)")}),
d AS MATERIALIZED (SELECT a.image_id, b.src, oy, ox, ey, ex, a.v, b.v AS w, (a.v - b.v) * (a.v - b.v) AS e
         FROM hist h JOIN here a ON a.image_id = h.image_id JOIN there b USING (src, ey, ex)),
dy AS (SELECT *, sum(e) OVER (PARTITION BY image_id, src, oy, ox, ex, ey & 1 ORDER BY ey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e1 FROM d),
dx AS (SELECT *, sum(e1) OVER (PARTITION BY image_id, src, oy, ox, ey, ex & 1 ORDER BY ex ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 9 AS d2 FROM dy),
wt AS (SELECT *, exp(-greatest(d2 - 2 * sg * sg, 0.0::DOUBLE) / (1.25::DOUBLE * sg * 1.25::DOUBLE * sg)) AS k
       FROM (SELECT *, 0.04::DOUBLE * sqrt(v) + 0.004::DOUBLE AS sg FROM dx WHERE ey BETWEEN 0 AND 31 AND ex BETWEEN 0 AND 31) q)""") + f"""
SELECT image_id AS frame_id, CAST(ey AS INT) AS y, CAST(ex AS INT) AS x, {rounded_sql('sum(k * w) / sum(k)')} AS v FROM wt GROUP BY 1, 2, 3""")
def _(spark, sf):
    pixels = normalized(spark, sf).withColumnRenamed("image_id", "frame_id")
    out = frames.non_local_means(pixels, clip_frames(spark, sf), 32, 32)
    return out.select("frame_id", "y", "x", rounded(F.col("v")).alias("v"))


@query("m10_temporal_blend", with_views("images", more=f"""{NORM_SQL},
ch AS (SELECT n.image_id, n.y, n.x, n.v, abs(n.v - p.v) AS c FROM norm n JOIN norm p ON p.image_id = n.image_id - 1 AND p.y = n.y AND p.x = n.x WHERE n.image_id % 8 > 0),
pk AS (SELECT n.image_id, n.y, n.x, max(c.c) AS peak FROM ch n, {PATCH} a(qy), {PATCH} b(qx), ch c WHERE c.image_id = n.image_id
   AND c.y = {MIRROR.format("(n.y + qy)")} AND c.x = {MIRROR.format("(n.x + qx)")} GROUP BY ALL),
sm AS (SELECT n.*, 0.04::DOUBLE * sqrt(n.v) + 0.004::DOUBLE AS sg, peak FROM norm n LEFT JOIN pk USING (image_id, y, x)),
uu AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (peak - 3 * sg) / (3 * sg))) AS u FROM sm),
k AS (SELECT image_id, y, x, v, CASE WHEN peak IS NULL THEN 0.0::DOUBLE ELSE 0.8::DOUBLE * CASE WHEN image_id % 8 % 3 = 2 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * (1 - u * u * (3 - 2 * u)) END AS a FROM uu),
walk AS (SELECT image_id, y, x, v FROM k WHERE image_id % 8 = 0
  UNION ALL SELECT k.image_id, k.y, k.x, k.a * w.v + (1 - k.a) * k.v FROM walk w JOIN k ON k.image_id = w.image_id + 1 AND k.y = w.y AND k.x = w.x WHERE k.image_id % 8 > 0)""", recursive=True) + f"""
SELECT image_id // 8 AS clip_id, image_id AS frame_id, y, x, {rounded_sql('v')} AS v FROM walk""")
def _(spark, sf):
    pixels = normalized(spark, sf).withColumnRenamed("image_id", "frame_id")
    out = frames.temporal_blend(pixels, clip_frames(spark, sf), 32, 32, retention=0.8)
    return out.select("clip_id", "frame_id", "y", "x", rounded(F.col("v")).alias("v"))


@query("m11_smooth_chroma", with_views("images", more="""
s AS (SELECT image_id, y, x, CAST(abs(v) % 1024 AS DOUBLE) AS luma, CAST((v * 3) % 512 AS DOUBLE) AS cb, CAST((v * 7) % 512 AS DOUBLE) AS cr FROM images),
o AS (SELECT unnest(generate_series(-3, 3)) AS d),
w AS (SELECT a.image_id, a.y, a.x, a.luma, b.cb, b.cr, exp(-(dy.d * dy.d + dx.d * dx.d) / 8.0::DOUBLE - (b.luma - a.luma) * (b.luma - a.luma) / 800.0::DOUBLE) AS wt
   FROM s a, o dy, o dx, s b WHERE b.image_id = a.image_id AND b.y = a.y + dy.d AND b.x = a.x + dx.d)""") + f"""
SELECT image_id, y, x, luma, {rounded_sql('sum(wt * cb) / sum(wt)', 4)} AS cb, {rounded_sql('sum(wt * cr) / sum(wt)', 4)} AS cr FROM w GROUP BY image_id, y, x, luma""")
def _(spark, sf):
    v = F.col("v")
    sites = views.images(spark, sf).select(
        "image_id", "y", "x", (F.abs(v) % 1024).alias("luma"), (v * 3 % 512).alias("cb"), (v * 7 % 512).alias("cr"))
    out = frames.smooth_chroma(sites, 32, 32)
    return out.select("image_id", "y", "x", "luma", rounded(F.col("cb"), 4).alias("cb"), rounded(F.col("cr"), 4).alias("cr"))
