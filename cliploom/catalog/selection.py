"""Device configuration choices (T, A18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.catalog.common import query, rounded, rounded_sql, views, with_views
from cliploom.operators import selection


def ranked(order: str, value: str, keys: str = "device", where: str = "TRUE") -> str:
    return (with_views("configs") + f"SELECT {keys}, {value} FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY {keys} ORDER BY {order}) AS rn FROM configs WHERE {where}) q WHERE rn = 1")


AREA = "CAST(w AS BIGINT) * h"
SAME = "abs(w / CAST(h AS DOUBLE) - 4.0::DOUBLE / 3) < 0.02::DOUBLE"


@query("t1_best_resolution", ranked(f"{AREA} DESC, w DESC, ord", "w, h", "device, fmt", "NOT is_input"))
def _(spark, sf):
    return selection.best_resolution(views.configs(spark, sf))


@query("t2_largest_size", ranked(f"{AREA} DESC, ord", "w, h"))
def _(spark, sf):
    return selection.largest_size(views.configs(spark, sf))


@query("t3_fixed_fps", ranked("CASE WHEN lo = hi THEN 0 ELSE 1 END, hi DESC, ord", "lo, hi"))
def _(spark, sf):
    return selection.fixed_fps(views.configs(spark, sf))


@query("t4_exposure_fps", with_views("configs") + """
SELECT d.device, coalesce(lo, 30) AS lo, coalesce(hi, 30) AS hi FROM (SELECT DISTINCT device FROM configs) d
LEFT JOIN (SELECT device, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY
   CASE WHEN hi = 30 THEN 0 ELSE 1 END, CASE WHEN hi = 30 THEN lo ELSE hi END DESC, ord) AS rn
   FROM configs WHERE device <> 'Brand#3') q WHERE rn = 1) r ON d.device = r.device""")
def _(spark, sf):
    c = views.configs(spark, sf)
    return selection.exposure_fps(c.select("device").distinct(), c.filter("device <> 'Brand#3'"))


@query("t5_largest_encodable", ranked(
    f"CASE WHEN {SAME} AND w <= 640 AND ord % 3 <> 0 THEN 0 WHEN {SAME} THEN 1 ELSE 2 END, "
    f"CASE WHEN {SAME} THEN {AREA} ELSE 0 END DESC, ord", "w, h"))
def _(spark, sf):
    sizes = views.configs(spark, sf).withColumn("encodable", F.col("ord") % 3 != 0)
    return selection.largest_encodable(sizes, F.lit(4.0) / 3, 640)


@query("t6_nearest_width", ranked(
    f"CASE WHEN {SAME} THEN 0 ELSE 1 END, CASE WHEN {SAME} THEN abs(w - 300) ELSE 0 END, "
    f"CASE WHEN {SAME} THEN ord ELSE -ord END", "w, h"))
def _(spark, sf):
    return selection.nearest_width(views.configs(spark, sf), F.lit(4.0) / 3, 300)


@query("t7_native_aspect", with_views("configs", more="""
d AS (SELECT device, min(ord) AS k FROM configs GROUP BY device),
l AS (SELECT device, w / CAST(h AS DOUBLE) AS a FROM (SELECT *, row_number() OVER (PARTITION BY device
      ORDER BY CAST(w AS BIGINT) * h DESC, ord) AS rn FROM configs) q WHERE rn = 1)""") + f"""
SELECT device, {rounded_sql('''CASE WHEN k % 3 = 0 AND k % 2 > 0 THEN 4000 / CAST(k % 2 * 3000 AS DOUBLE)
   WHEN k % 3 = 1 THEN 1920 / 1080.0::DOUBLE ELSE a END''')} AS aspect FROM d JOIN l USING (device)""")
def _(spark, sf):
    c = views.configs(spark, sf)
    k = F.col("k")
    devices = c.groupBy("device").agg(F.min("ord").alias("k")).select(
        "device",
        F.when(k % 3 == 0, 4000).alias("active_w"), F.when(k % 3 == 0, k % 2 * 3000).alias("active_h"),
        F.when(k % 3 == 1, 1920).alias("pixel_w"), F.when(k % 3 == 1, 1080).alias("pixel_h"),
    )
    return selection.native_aspect(devices, c).select("device", rounded(F.col("aspect")).alias("aspect"))


@query("t8_back_camera", with_views("configs") + """
SELECT device, 'cam' || min(ord) AS camera_id FROM configs WHERE ord % 3 = 1 GROUP BY device""")
def _(spark, sf):
    cameras = views.configs(spark, sf).select(
        "device", "ord", F.concat(F.lit("cam"), F.col("ord")).alias("camera_id"),
        F.when(F.col("ord") % 3 == 1, "BACK").otherwise("FRONT").alias("facing"))
    return selection.back_camera(cameras)


@query("t9_time_order", with_views("packets") + """
SELECT clip_id, arrival, ts_ns, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY ts_ns, arrival) - 1 AS BIGINT) AS pos FROM packets""")
def _(spark, sf):
    p = views.packets(spark, sf).select("clip_id", "arrival", "ts_ns")
    return selection.time_order(p)


@query("a18_capture_maxima", """
SELECT p_brand AS device, coalesce(max(CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 100 END), 48000) AS rate,
  coalesce(max(CASE WHEN p_size % 2 = 0 THEN p_size % 32 END), 32) AS depth,
  coalesce(max(CASE WHEN p_brand <> 'Brand#2' THEN CAST(p_partkey % 8 AS INT) END), 2) AS channels FROM part GROUP BY p_brand""")
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    formats = spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_brand").alias("device"), F.when(k % 3 == 0, k * 100).alias("rate"),
        F.when(s % 2 == 0, s % 32).alias("depth"),
        F.when(F.col("p_brand") != "Brand#2", (k % 8).cast("int")).alias("channels"))
    return selection.capture_maxima(formats)
