"""Sources, row-level transforms and unions (S, P, U)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cliploom.catalog.common import query, rounded, rounded_sql, table, views, with_views
from cliploom.functions import pixel, rates, sound, tags
from cliploom.operators import scalars
from cliploom.session import durable_dir
from cliploom.sources import binary, manifest


def line(spark, sf, *columns):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", *columns)


IVAL = "CAST(round((l_quantity - 25.5) * 1000) AS INT)"
LINE_KEYS = "l_suppkey, l_orderkey, l_linenumber, l_partkey"


def ival():
    return F.round((F.col("l_quantity") - 25.5) * 1000).cast("int")


PAIRS_SQL = """
pairs AS (SELECT doc_id, bytes, unnest(u) AS e, generate_subscripts(u, 1) - 1 AS i FROM (
  SELECT doc_id, octet_length(encode(text)) AS bytes, regexp_extract_all(hex(encode(text)), '.{4}') AS u FROM documents) q),
words AS (SELECT doc_id, bytes, i, CAST('0x' || substr(e, 3, 2) || substr(e, 1, 2) AS INT) AS raw FROM pairs)"""


@query("s1_read_pcm", f"""WITH {PAIRS_SQL}
SELECT doc_id AS clip_id, CAST(i % 2 AS INT) AS ch, CAST(i // 2 AS BIGINT) AS n,
       CAST(CASE WHEN raw >= 32768 THEN raw - 65536 ELSE raw END AS INT) AS ival FROM words WHERE i < bytes // 256 * 128""")
def _(spark, sf):
    clips = table(spark, sf, "documents").select(
        F.col("doc_id").alias("clip_id"), F.col("text").cast("binary").alias("payload")
    )
    return binary.read_pcm(clips, bits=16, channels=2, block=64, blocks_per_slice=16)


@query("s2_explode_raw16", f"""WITH {PAIRS_SQL}
SELECT doc_id AS frame_id, CAST(i // 10 AS INT) AS y, CAST(i % 10 AS INT) AS x, raw AS v
FROM words WHERE i % 10 < 7 AND i // 10 < bytes // 20""")
def _(spark, sf):
    data = F.col("text").cast("binary")
    frames = table(spark, sf, "documents").select(
        F.col("doc_id").alias("frame_id"),
        F.lit(7).alias("w"),
        F.floor(F.octet_length("text") / 20).cast("int").alias("h"),
        F.lit(20).alias("stride"),
        data.alias("data"),
    )
    return binary.explode_raw16(frames)


@query("s3_write_with_manifest", with_views("packets") + """
SELECT clip_id, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS total_size, true AS in_place FROM packets GROUP BY clip_id""")
def _(spark, sf):
    folder = f"{durable_dir(spark)}/packets-{uuid.uuid4().hex}"
    written = manifest.write_with_manifest(views.packets(spark, sf), folder)
    sizes = spark.read.parquet(folder).groupBy("clip_id").agg(F.sum("size").alias("total_size"))
    return (
        written.groupBy("clip_id").agg(
            F.sum("rows").alias("n_rows"),
            F.bool_and(F.contains("path", F.concat(F.lit("/clip_id="), F.col("clip_id"), F.lit("/part-")))).alias("in_place"))
        .join(sizes, "clip_id").select(F.col("clip_id").cast("long"), "n_rows", "total_size", "in_place")
    )


@query("s3_session_manifest", """
SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS ord,
       'out/' || event_id AS path,
       CASE event_type WHEN 'view' THEN 'video' WHEN 'click' THEN 'sidecar' ELSE 'still' END AS kind
FROM events WHERE event_type = 'view' OR event_id % 3 <> 0""")
def _(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("arrival"),
        F.when(F.col("event_type") == "view", "video").when(F.col("event_type") == "click", "sidecar")
        .otherwise("still").alias("kind"),
        F.concat(F.lit("out/"), F.col("event_id")).alias("path"),
        (F.col("event_id") % 3 != 0).alias("complete"),
    )
    return manifest.session_manifest(log)


@query("p1_pcm_normalize", f"SELECT {LINE_KEYS}, {IVAL} / 32768.0::DOUBLE AS v16, "
       f"{IVAL} / 8388608.0::DOUBLE AS v24, {IVAL} / 2147483648.0::DOUBLE AS v32 FROM lineitem")
def _(spark, sf):
    return line(spark, sf, *[sound.pcm_normalize(ival(), b).alias(f"v{b}") for b in (16, 24, 32)])


@query("p2_quantize_pcm24", f"SELECT {LINE_KEYS}, CAST(trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, "
       "(l_quantity - 25.5) / 20.0::DOUBLE)) * 8388607.0::DOUBLE) AS INT) AS pcm FROM lineitem")
def _(spark, sf):
    return line(spark, sf, sound.quantize_pcm24((F.col("l_quantity") - 25.5) / 20.0).alias("pcm"))


@query("p3_sample_time", f"SELECT {LINE_KEYS}, l_partkey * 1000 + (l_orderkey * 3840 * 1000000000) // "
       "(44100 + 3900 * (l_suppkey % 2)) AS ts_ns FROM lineitem")
def _(spark, sf):
    n, rate = F.col("l_orderkey") * 3840, 44100 + 3900 * (F.col("l_suppkey") % 2)
    return line(spark, sf, sound.sample_time(F.col("l_partkey") * 1000, n, rate).alias("ts_ns"))


@query("p4_anchor_audio", with_views("packets") + """
SELECT clip_id, arg_min(ts_ns, arrival) - 50000000 AS base_ns FROM packets WHERE is_audio GROUP BY clip_id""")
def _(spark, sf):
    reads = views.packets(spark, sf).filter("is_audio").withColumnRenamed("ts_ns", "read_ns")
    return scalars.anchor_audio(reads)


@query("p5_valid_audio_format", """
WITH f AS (SELECT p_partkey, CAST(p_partkey % 23 * 48000 - 48000 AS BIGINT) AS sample_rate,
                  CAST(p_partkey % 10 AS INT) AS channels, p_size AS bit_depth FROM part)
SELECT *, sample_rate < 655360 AS subset FROM f
WHERE sample_rate > 0 AND channels >= 1 AND channels <= 8 AND bit_depth >= 4 AND bit_depth <= 32""")
def _(spark, sf):
    k = F.col("p_partkey")
    formats = table(spark, sf, "part").select(
        "p_partkey", (k % 23 * 48000 - 48000).alias("sample_rate"), (k % 10).cast("int").alias("channels"),
        F.col("p_size").alias("bit_depth"),
    )
    return scalars.valid_audio_format(formats)


@query("p6_rebase_clock", with_views("packets", more="""
f AS (SELECT clip_id, arrival, arrival * 2000000 + 900000000 AS mono_ns, arrival * 2000000 + 77000900000000 AS boot_ns,
        ts_ns + CASE clip_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 77000000000000 ELSE 5000000000000000 END AS ts_ns FROM packets),
o AS (SELECT clip_id, CASE WHEN abs(ts_ns - mono_ns) < 5000000000 THEN 0
        WHEN abs(ts_ns - boot_ns) < 5000000000 THEN boot_ns - mono_ns ELSE ts_ns - mono_ns END AS off
      FROM f WHERE (clip_id, arrival) IN (SELECT (clip_id, min(arrival)) FROM f GROUP BY clip_id))""") + """
SELECT f.clip_id, f.arrival, f.ts_ns - o.off AS ts_ns FROM f JOIN o USING (clip_id)""")
def _(spark, sf):
    p = views.packets(spark, sf)
    domain = F.when(F.col("clip_id") % 3 == 0, 0).when(F.col("clip_id") % 3 == 1, 77000000000000).otherwise(
        5000000000000000)
    frames = p.select(
        "clip_id", "arrival", (F.col("ts_ns") + domain).alias("ts_ns"),
        (F.col("arrival") * 2000000 + 900000000).alias("mono_ns"),
        (F.col("arrival") * 2000000 + 77000900000000).alias("boot_ns"),
    )
    return scalars.rebase_clock(frames).select("clip_id", "arrival", "ts_ns")


GEOMETRY_SQL = """
g AS (SELECT l_orderkey AS burst, l_suppkey * 100 + l_linenumber AS frame_id,
        CAST(64 + CASE WHEN l_partkey % 31 = 0 THEN 2 ELSE 0 END AS INT) AS w, CAST(48 AS INT) AS h,
        CAST(CASE WHEN l_suppkey % 37 = 0 THEN 6000 ELSE 6336 END AS BIGINT) AS bytes FROM lineitem)"""


def geometry(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("burst"),
        (F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("frame_id"),
        (64 + F.when(F.col("l_partkey") % 31 == 0, 2).otherwise(0)).cast("int").alias("w"),
        F.lit(48).alias("h"),
        F.when(F.col("l_suppkey") % 37 == 0, 6000).otherwise(6336).cast("long").alias("bytes"),
    )


@query("p7_geometry_guard_row", f"WITH {GEOMETRY_SQL} SELECT * FROM g WHERE w = 64 AND h = 48")
def _(spark, sf):
    return scalars.geometry_guard(geometry(spark, sf), "row", 64, 48)


@query("p7_geometry_guard_burst", f"""WITH {GEOMETRY_SQL}
SELECT * FROM g WHERE burst NOT IN (
  SELECT a.burst FROM g a GROUP BY a.burst HAVING count(DISTINCT w) > 1 OR count(DISTINCT h) > 1)
  AND burst NOT IN (SELECT burst FROM g WHERE bytes < 2 * w * h)""")
def _(spark, sf):
    return scalars.geometry_guard(geometry(spark, sf), "burst")


@query("p8_relative_time", with_views("packets") + """
SELECT clip_id, arrival, greatest(ts_ns - first_value(ts_ns) OVER (PARTITION BY clip_id ORDER BY arrival), 0) AS rel_ns
FROM packets""")
def _(spark, sf):
    return scalars.relative_time(views.packets(spark, sf)).select("clip_id", "arrival", "rel_ns")


@query("p9_target_bitrate", with_views("configs") + """
SELECT ord, CAST(least(floor(0.8::DOUBLE * (w & -2) * (h & -2) * hi + 0.5::DOUBLE), 460000000) AS BIGINT) AS raw_rate,
       CAST(least(150000000, 200000000, CAST(w AS BIGINT) * h * 30 // 2) AS BIGINT) AS legacy_rate,
       w & -2 AS out_w, h & -2 AS out_h FROM configs""")
def _(spark, sf):
    w, h = F.col("w"), F.col("h")
    return views.configs(spark, sf).select(
        "ord",
        rates.raw_bitrate(w, h, F.col("hi")).alias("raw_rate"),
        rates.legacy_bitrate(w, h, F.lit(150000000)).alias("legacy_rate"),
        rates.even(w).alias("out_w"),
        rates.even(h).alias("out_h"),
    )


@query("p10_exposure_ladder", """
WITH d AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0::DOUBLE / 3 WHEN 2 THEN 0.5 ELSE 1.0::DOUBLE / 6 END AS step,
             CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 3 END AS shots, -(p_size % 13) AS low, p_size % 11 AS high FROM part),
k AS (SELECT *, CAST(floor(2.0::DOUBLE / CASE WHEN step > 0 THEN step ELSE 1.0::DOUBLE / 3 END + 0.5::DOUBLE) AS INT) AS k FROM d),
s AS (SELECT *, unnest([0, 1, 2]) AS shot FROM k)
SELECT p_partkey, CAST(shot AS INT) AS shot,
       CAST(greatest(low, least(high, CASE WHEN shots = 1 THEN 0 ELSE (shot - 1) * k END)) AS INT) AS ev
FROM s WHERE shot < shots""")
def _(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    step = F.when(k % 4 == 0, 0.0).when(k % 4 == 1, 1.0 / 3).when(k % 4 == 2, 0.5).otherwise(1.0 / 6)
    ladder = rates.exposure_ladder(step, F.when(k % 5 == 0, 1).otherwise(3), -(size % 13), size % 11)
    return table(spark, sf, "part").select("p_partkey", F.posexplode(ladder).alias("shot", "ev"))


@query("p11_wb_gains", """
SELECT event_id, """ + ", ".join(
    f"CASE WHEN event_id % {7 + k} / 20.0::DOUBLE > 1e-6 THEN 1.0 / (event_id % {7 + k} / 20.0::DOUBLE) ELSE 1.0::DOUBLE END AS g{k}"
    for k in range(3)) + " FROM events")
def _(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", *[pixel.gain_from_neutral(i % (7 + k) / 20.0).alias(f"g{k}") for k in range(3)]
    )


def sensor_pixels(spark, sf):
    black = F.array(*[F.lit(float(b)) for b in (60, 62, 64, 66)])
    return views.pixels(spark, sf).withColumn("black", black).withColumn(
        "white", F.when(F.col("frame_id") % 9 == 0, 0).otherwise(800))


@query("p12_linearize", with_views("pixels", more="""
b AS (SELECT *, CAST(60 + 2 * ((y % 2) * 2 + x % 2) AS DOUBLE) AS bl, 800.0::DOUBLE AS wh FROM pixels)""") + f"""
SELECT frame_id, y, x, greatest(v - bl, 0.0::DOUBLE) AS lin,
  {rounded_sql("exp(-(((v - bl) / (wh - bl) - 0.5::DOUBLE) * ((v - bl) / (wh - bl) - 0.5::DOUBLE)) / (2.0::DOUBLE * 0.2::DOUBLE * 0.2::DOUBLE)) + 1e-3::DOUBLE")} AS weight
FROM b WHERE NOT (v >= 0.98::DOUBLE * wh)""")
def _(spark, sf):
    lin = scalars.linearize(sensor_pixels(spark, sf), F.lit(800))
    return lin.select("frame_id", "y", "x", "lin", rounded(F.col("weight")).alias("weight"))


@query("p13_quantize_radiance", f"""
SELECT {LINE_KEYS}, CAST(least(greatest(round(l_extendedprice - 20000.0::DOUBLE), 0), trunc(l_quantity * 1500.5::DOUBLE)) AS BIGINT) AS q FROM lineitem""")
def _(spark, sf):
    return line(spark, sf, pixel.quantize_radiance(
        F.col("l_extendedprice") - 20000.0, F.col("l_quantity") * 1500.5).alias("q"))


@query("p14_map_tags", """
SELECT p_partkey,
  CASE p_partkey % 6 - 1 WHEN 1 THEN 'GRBG' WHEN 2 THEN 'GBRG' WHEN 3 THEN 'BGGR' ELSE 'RGGB' END AS pattern,
  CASE ((p_partkey % 9 - 4) * 90 % 360 + 360) % 360 WHEN 90 THEN 6 WHEN 180 THEN 3 WHEN 270 THEN 8 ELSE 1 END AS orientation,
  p_size + 2 AS top, p_size AS left_edge, p_size + 2 + 300 AS bottom, p_size + 400 AS right_edge,
  p_partkey - 3 AS rect_x, p_partkey - 7 AS rect_y, CAST(3 AS BIGINT) AS rect_w, CAST(9 AS BIGINT) AS rect_h,
  CAST(CASE WHEN (p_retailprice - 1000) / 4 < 0 THEN 0 ELSE trunc((p_retailprice - 1000) / 4 + 0.5::DOUBLE) END AS INT) AS black,
  CASE WHEN p_partkey % 5 = 0 THEN 0.0::DOUBLE ELSE p_size / CAST(p_partkey % 5 AS DOUBLE) END AS matrix_value,
  CASE WHEN p_partkey % 5 = 0 THEN 1.0::DOUBLE ELSE p_size / CAST(p_partkey % 5 AS DOUBLE) END AS neutral_value
FROM part""")
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    top, left, bottom, right = tags.rect_to_edges(s, s + 2, F.lit(400), F.lit(300))
    x, y, w, h = tags.edges_to_rect(k - 3, k - 7, k, k + 2)
    return table(spark, sf, "part").select(
        "p_partkey",
        tags.mosaic_pattern(k % 6 - 1).alias("pattern"),
        tags.orientation_code((k % 9 - 4) * 90).alias("orientation"),
        top.alias("top"), left.alias("left_edge"), bottom.alias("bottom"), right.alias("right_edge"),
        x.alias("rect_x"), y.alias("rect_y"), w.alias("rect_w"), h.alias("rect_h"),
        tags.black_level((F.col("p_retailprice") - 1000) / 4).alias("black"),
        tags.rational(s, k % 5, 0.0).alias("matrix_value"),
        tags.rational(s, k % 5, 1.0).alias("neutral_value"),
    )


@query("p15_yuv_to_rgb", with_views("images", more="""
j AS (SELECT l.image_id, l.y, l.x, 1164 * (abs(l.v) % 256 - 16) AS c, abs(c.v * 3) % 256 - 128 AS u, abs(c.v * 7) % 256 - 128 AS w
      FROM images l JOIN images c ON l.image_id = c.image_id AND c.y = l.y // 2 * 2 AND c.x = l.x // 2 * 2)""") + """
SELECT image_id, y, x, CAST(least(greatest((c + 1596 * w) // 1000, 0), 255) AS INT) AS r,
  CAST(least(greatest((c - 391 * u - 813 * w) // 1000, 0), 255) AS INT) AS g,
  CAST(least(greatest((c + 2018 * u) // 1000, 0), 255) AS INT) AS b FROM j""")
def _(spark, sf):
    im = views.images(spark, sf)
    luma = im.select("image_id", "y", "x", (F.abs("v") % 256).alias("luma"))
    half = lambda c: F.shiftright(c, 1).alias(c)
    chroma = im.filter("y % 2 = 0 AND x % 2 = 0").select(
        "image_id", half("y"), half("x"), (F.abs(F.col("v") * 3) % 256).alias("u"), (F.abs(F.col("v") * 7) % 256).alias("v"))
    return scalars.yuv_frames_to_rgb(luma, chroma)


@query("p16_rotate", with_views("images") + """
SELECT image_id, CAST(CASE image_id % 4 WHEN 1 THEN x WHEN 2 THEN 31 - y WHEN 3 THEN 31 - x ELSE y END AS INT) AS y,
  CAST(CASE image_id % 4 WHEN 1 THEN 31 - y WHEN 2 THEN 31 - x WHEN 3 THEN y ELSE x END AS INT) AS x, v FROM images""")
def _(spark, sf):
    y, x = pixel.rotate(F.col("y"), F.col("x"), F.lit(32), F.lit(32), F.col("image_id") % 4 * 90 - 360)
    return views.images(spark, sf).select("image_id", y.alias("y"), x.alias("x"), "v")


@query("p17_post_filter_gain", f"""
WITH g AS (SELECT {LINE_KEYS}, l_quantity / 50.0::DOUBLE AS g FROM lineitem),
r AS (SELECT *, g / greatest(g * sin(3.141592653589793::DOUBLE * g * 0.5::DOUBLE), 1e-12::DOUBLE) AS r FROM g)
SELECT {LINE_KEYS}, {rounded_sql("(1.0::DOUBLE + 0.02::DOUBLE) * g / (1.0::DOUBLE + 0.02::DOUBLE * r * r)")} AS gain FROM r""")
def _(spark, sf):
    return line(spark, sf, rounded(sound.post_filter_gain(F.col("l_quantity") / 50.0)).alias("gain"))


# Device matrices made from the part key; some devices report none, one is singular.
def _matrix(seed: int):
    return [f"(CASE WHEN {i} % 4 = 0 THEN 1.0 ELSE 0.0 END + ((p_partkey * {seed + i}) % 17 - 8) / 40.0)" for i in range(9)]


def device_matrices(spark, sf):
    k = F.col("p_partkey")

    def matrix(seed, present):
        return F.when(
            present, F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) + (k * (seed + i) % 17 - 8) / 40.0 for i in range(9)])
        )

    flat = F.array(*[F.lit(0.5)] * 9)
    return table(spark, sf, "part").select(
        k.alias("device"),
        matrix(3, k % 3 == 0).alias("forward2"),
        F.when(k % 2 == 0, 21).otherwise(17).alias("illuminant2"),
        matrix(7, k % 5 == 1).alias("forward1"),
        F.when(k % 11 == 3, F.when(k % 5 != 4, flat)).otherwise(matrix(13, k % 5 != 4)).alias("colour1"),
    )


def _ccm_sql() -> str:
    fm2, fm1, cm1 = _matrix(3), _matrix(7), _matrix(13)
    a, b = tags.XYZ_D65_TO_BT2020, tags.BRADFORD_D50_TO_D65
    cast = lambda e: f"CAST({e} AS DOUBLE)"
    m = [f"m{i}" for i in range(9)]
    # entry (r, c) of the inverse: the cofactor of (c, r), indices taken modulo 3, over the determinant
    at = lambda i, j: m[3 * (i % 3) + j % 3]
    cofactor = lambda i, j: f"({at(i + 1, j + 1)}*{at(i + 2, j + 2)}-{at(i + 1, j + 2)}*{at(i + 2, j + 1)})"
    det = "(" + "+".join(f"{at(0, j)}*{cofactor(0, j)}" for j in range(3)) + ")"
    adj = [cofactor(c, r) for r in range(3) for c in range(3)]
    sel_cm1 = ", ".join(
        f"CASE WHEN p_partkey % 11 = 3 THEN 0.5::DOUBLE ELSE {cast(c)} END AS {n}" for c, n in zip(cm1, m))
    chosen = ", ".join(
        f"CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN {cast(fm2[i])} "
        f"WHEN p_partkey % 5 = 1 THEN {cast(fm1[i])} "
        f"WHEN p_partkey % 5 <> 4 AND abs({det}) >= 1e-12 THEN ({adj[i]}) / {det} "
        f"ELSE {1.0 if i % 4 == 0 else 0.0}::DOUBLE END AS k{i}" for i in range(9))
    adapt = [sum(a[3 * r + k] * b[3 * k + c] for k in range(3)) for r in range(3) for c in range(3)]
    full = ", ".join(
        " + ".join(f"({adapt[3 * r + k]!r})::DOUBLE * k{3 * k + c}" for k in range(3)) + f" AS f{3 * r + c}"
        for r in range(3) for c in range(3))
    norm = ", ".join(
        f"f{3 * r + c} / CASE WHEN abs(f{3 * r}+f{3 * r + 1}+f{3 * r + 2}) < 1e-9 THEN 1.0 ELSE f{3 * r}+f{3 * r + 1}+f{3 * r + 2} END AS c{3 * r + c}"
        for r in range(3) for c in range(3))
    return (f"cm AS (SELECT p_partkey, {sel_cm1} FROM part), ch AS (SELECT p_partkey, {chosen} FROM cm), "
            f"fu AS (SELECT p_partkey, {full} FROM ch), ccm AS (SELECT p_partkey, {norm} FROM fu)")


@query("p18_colour_matrix", f"WITH {_ccm_sql()} SELECT p_partkey, "
       + ", ".join(rounded_sql(f"c{i}", 4) + f" AS c{i}" for i in range(9)) + " FROM ccm")
def _(spark, sf):
    ccm = scalars.derive_colour_matrix(device_matrices(spark, sf))
    return ccm.select(F.col("device").alias("p_partkey"), *[rounded(F.col("ccm")[i], 4).alias(f"c{i}") for i in range(9)])


def _pq_sql(x: str) -> str:
    p = f"pow(greatest({x}, 0.0::DOUBLE), {tags.PQ_M1!r}::DOUBLE)"
    return f"pow(({tags.PQ_C1!r}::DOUBLE + {tags.PQ_C2!r}::DOUBLE * {p}) / (1.0::DOUBLE + {tags.PQ_C3!r}::DOUBLE * {p}), {tags.PQ_M2!r}::DOUBLE)"


@query("p19_develop_colour", f"WITH {_ccm_sql()}, "
       "rgb AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity / 50.0::DOUBLE / 0.8::DOUBLE AS r, "
       "l_discount * 10.0::DOUBLE AS g, l_tax * 12.0::DOUBLE / 0.5::DOUBLE AS b FROM lineitem) "
       f"SELECT {LINE_KEYS}, " + ", ".join(
           rounded_sql(_pq_sql(f"0.1::DOUBLE * (c{3 * i} * r + c{3 * i + 1} * g + c{3 * i + 2} * b)"), 4) + f" AS {n}"
           for i, n in enumerate(("r_pq", "g_pq", "b_pq")))
       + " FROM rgb JOIN ccm ON l_partkey = p_partkey")
def _(spark, sf):
    devices = scalars.derive_colour_matrix(device_matrices(spark, sf)).withColumn(
        "gains", F.array(*[pixel.gain_from_neutral(F.lit(n)) for n in (0.8, 1.0, 0.5)]))
    rgb = line(spark, sf, F.col("l_partkey").alias("device"), (F.col("l_quantity") / 50.0).alias("r"),
               (F.col("l_discount") * 10.0).alias("g"), (F.col("l_tax") * 12.0).alias("b"))
    out = scalars.develop_colour(rgb, devices)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey",
                      *[rounded(F.col(n), 4).alias(n) for n in ("r_pq", "g_pq", "b_pq")])


@query("p20_finalize_percent", """
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 100 WHEN o_custkey % 97 = 0 THEN 0
  WHEN o_orderkey % 300 >= o_custkey % 97 THEN 100 ELSE (o_orderkey % 300) * 100 // (o_custkey % 97) END AS INT) AS pct,
  CAST(o_totalprice * 100 AS BIGINT) * 7919 // 1000000 AS duration_ms FROM orders""")
def _(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    now = F.round(F.col("o_totalprice") * 100).cast("long") * 7919
    return table(spark, sf, "orders").select(
        "o_orderkey",
        rates.finalize_percent(o % 5 != 0, o % 300, c % 97).alias("pct"),
        rates.duration_ms(F.lit(0), now).alias("duration_ms"),
    )


@query("p21_derive_paths", """
WITH p AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'd/IMG_' || event_id || '_' || event_id % 3 || '.dng'
   WHEN 1 THEN 'd/IMG_' || event_id || '_9.dng' WHEN 2 THEN 'd/x.dng.' || event_id || '.dng' ELSE 'd/VID_' || event_id || '.mkv' END AS path FROM events)
SELECT event_id,
  CASE WHEN ends_with(path, '_' || event_id % 3 || '.dng') THEN left(path, length(path) - length('_' || event_id % 3 || '.dng')) ELSE path END AS base,
  CASE WHEN contains(path, '.dng') THEN left(path, length(path) - strpos(reverse(path), 'gnd.') - 3) ELSE path END AS cut,
  CASE WHEN ends_with(path, '.mkv') THEN left(path, length(path) - 4) ELSE path END || '_ai.flac' AS sidecar,
  'VID_' || strftime(ts, '%Y%m%d_%H%M%S') || '.mkv' AS video, 'IMG_' || strftime(ts, '%Y%m%d_%H%M%S') AS still FROM p""")
def _(spark, sf):
    i = F.col("event_id")
    idx = i % 3
    path = (
        F.when(i % 4 == 0, F.concat(F.lit("d/IMG_"), i, F.lit("_"), idx, F.lit(".dng")))
        .when(i % 4 == 1, F.concat(F.lit("d/IMG_"), i, F.lit("_9.dng")))
        .when(i % 4 == 2, F.concat(F.lit("d/x.dng."), i, F.lit(".dng")))
        .otherwise(F.concat(F.lit("d/VID_"), i, F.lit(".mkv")))
    )
    e = table(spark, sf, "events").withColumn("path", path)
    p = F.col("path")
    return e.select(
        "event_id",
        rates.burst_base(p, idx).alias("base"),
        rates.cut_at_last_dng(p).alias("cut"),
        rates.sidecar_path(p).alias("sidecar"),
        rates.stamped_name("VID_", F.col("ts"), ".mkv").alias("video"),
        rates.stamped_name("IMG_", F.col("ts")).alias("still"),
    )


@query("p23_select_modes", """
SELECT p_partkey AS device,
  CASE WHEN p_partkey % 4 > 0 AND p_partkey % 3 = 0 THEN 'USB' WHEN p_partkey % 5 <> 0 THEN 'INTERNAL' ELSE 'NONE' END AS audio,
  CASE WHEN p_size > 10 AND p_partkey % 7 <> 0 THEN 'RAW_PQ' ELSE 'LEGACY_HLG' END AS video,
  CASE WHEN p_partkey % 11 <> 0 THEN 'HEVC' ELSE 'AVC' END AS codec,
  CASE WHEN p_size > 25 THEN 'RAW' WHEN p_size <= 10 AND p_partkey % 2 = 0 THEN 'YUV' ELSE 'NONE' END AS still FROM part""")
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    devices = table(spark, sf, "part").select(
        k.alias("device"), (k % 4 - 0).alias("usb_fd"), (k % 3 == 0).alias("usb_capture"),
        (k % 5 != 0).alias("has_mic"), (s - 10).alias("raw_w"), (s - 10).alias("raw_h"),
        (k % 7 != 0).alias("encoder_ok"), (k % 11 != 0).alias("has_hevc"), (s > 25).alias("has_raw_reader"),
        (s > 10).alias("raw_video_mode"), (k % 2 == 0).alias("has_yuv_reader"),
    )
    return scalars.select_modes(devices)


@query("p24_plan_outputs", """
WITH r AS (SELECT o_orderkey AS request_id, CAST(o_orderkey % 3 AS INT) AS mode, 'IMG_' || o_orderkey AS base FROM orders)
SELECT request_id, mode, base || '.dng' AS path FROM r
UNION ALL SELECT request_id, mode, base || '_' || i || '.dng' FROM r, (VALUES (0), (1), (2)) t(i) WHERE mode = 2""")
def _(spark, sf):
    k = F.col("o_orderkey")
    requests = table(spark, sf, "orders").select(
        k.alias("request_id"), (k % 3).cast("int").alias("mode"), F.concat(F.lit("IMG_"), k).alias("base"))
    return scalars.plan_outputs(requests)


@query("u1_merge_tracks", """
SELECT user_id % 20 AS clip_id, event_id AS arrival, event_type IN ('click', 'view') AS is_audio,
  CASE WHEN event_type IN ('click', 'view') THEN event_id * 2000000 + 17 ELSE event_id * 2000 * 1000 END AS ts_ns,
  CAST(round(value * 100) AS BIGINT) AS size FROM events""")
def _(spark, sf):
    p = views.packets(spark, sf)
    audio = p.filter("is_audio").withColumn("ts", F.col("arrival") * 2000000 + 17)
    video = p.filter("NOT is_audio").withColumn("ts", F.col("arrival") * 2000)
    return scalars.merge_tracks(audio, video)


@query("u2_all_sizes", with_views("configs") + """
SELECT device, w, h FROM configs WHERE fmt = 0 UNION ALL SELECT device, w, h FROM configs WHERE fmt < 2""")
def _(spark, sf):
    c = views.configs(spark, sf)
    return c.filter("fmt = 0").select("device", "w", "h").unionAll(c.filter("fmt < 2").select("device", "w", "h"))
