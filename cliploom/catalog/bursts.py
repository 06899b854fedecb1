"""Burst operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.catalog.common import query, rounded, rounded_sql, table, views, with_views
from cliploom.catalog.pairing import image_pairs
from cliploom.operators import bursts, pairing
from cliploom.plans import hdr

RUNS_SQL = """
f AS (SELECT user_id % 20 AS session_id, event_id AS arrival, 'IMG_' || event_id // 150 AS base,
        CAST(1 + event_id // 150 % 4 AS INT) AS expected FROM events),
m AS (SELECT *, CASE WHEN lag(base) OVER w IS DISTINCT FROM base THEN 1 ELSE 0 END AS opens FROM f WHERE expected >= 2
      WINDOW w AS (PARTITION BY session_id ORDER BY arrival)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY arrival) AS run_no FROM m),
islands AS (SELECT session_id, arrival, base, expected, min(arrival) OVER r AS run,
       CAST((row_number() OVER (PARTITION BY session_id, run_no ORDER BY arrival) - 1) // first_value(expected) OVER
         (PARTITION BY session_id, run_no ORDER BY arrival) AS BIGINT) AS burst FROM g WINDOW r AS (PARTITION BY session_id, run_no))"""


def burst_frames(spark, sf):
    return burst_frames_of(table(spark, sf, "events"))


def burst_frames_of(events):
    part = F.floor(F.col("event_id") / 150)
    return events.select(
        (F.col("user_id") % 20).alias("session_id"), F.col("event_id").alias("arrival"),
        F.concat(F.lit("IMG_"), part).alias("base"), (1 + part % 4).cast("int").alias("expected"))


@query("w10_burst_islands", f"WITH {RUNS_SQL} SELECT session_id, arrival, run, burst FROM islands")
def _(spark, sf):
    return bursts.burst_islands(burst_frames(spark, sf)).select("session_id", "arrival", "run", "burst")


@query("a3_complete_bursts", f"""WITH {RUNS_SQL}
SELECT session_id, min(base) AS base, min(arrival) AS first_arrival, max(arrival) AS last_arrival, count(*) AS n
FROM islands GROUP BY session_id, run, burst HAVING count(*) = min(expected)""")
def _(spark, sf):
    return bursts.complete_bursts(burst_frames(spark, sf))


def shot_frames(spark, sf):
    black = F.array(*[F.lit(float(b)) for b in (60, 62, 64, 66)])
    return views.shots(spark, sf).withColumn("black", black).withColumn("bytes", F.lit(128).cast("long"))


SCALARS_SQL = """
n AS (SELECT burst, count(*) AS n, bool_and(exposure_ns > 0 AND iso > 0) AS have FROM shots GROUP BY burst),
ref AS (SELECT * FROM (SELECT s.burst, s.frame_id, s.idx, s.exposure_ns * s.iso AS light, n, have,
   row_number() OVER (PARTITION BY s.burst ORDER BY abs(s.idx - n // 2), s.frame_id) AS rn FROM shots s JOIN n USING (burst)) q
   WHERE rn = 1 AND n >= 2),
rel AS (SELECT s.frame_id, s.burst, s.frame_id = r.frame_id AS is_ref,
   CASE WHEN r.have THEN (s.exposure_ns * s.iso) / CAST(r.light AS DOUBLE) ELSE pow(2.0::DOUBLE, 2.0::DOUBLE * (s.idx - r.idx)) END AS e_rel
   FROM shots s JOIN ref r USING (burst)),
scal AS (SELECT r.burst, r.n, r.frame_id AS ref_frame, 737.0::DOUBLE AS ref_span,
   least(65535.0::DOUBLE, 737.0::DOUBLE * (1.0::DOUBLE / least(1.0::DOUBLE, m))) AS out_white
   FROM ref r JOIN (SELECT burst, min(e_rel) AS m FROM rel GROUP BY burst) q USING (burst))"""


@query("a2_burst_scalars", with_views("shots", more=SCALARS_SQL) + f"""
SELECT rel.frame_id, rel.burst, is_ref, e_rel, n, ref_frame, ref_span, {rounded_sql('out_white')} AS out_white
FROM rel JOIN scal ON rel.burst = scal.burst""")
def _(spark, sf):
    per_burst, per_frame = bursts.burst_scalars(shot_frames(spark, sf))
    return per_frame.join(per_burst, "burst").select(
        "frame_id", "burst", "is_ref", "e_rel", "n", "ref_frame", "ref_span", rounded(F.col("out_white")).alias("out_white"))


def merged_sql(shifted: bool) -> str:
    """Merge CTEs; ``px`` gives each pixel its output place."""
    place = ("p.y - 2 * coalesce(a.dy, 0) AS y, p.x - 2 * coalesce(a.dx, 0) AS x" if shifted else "p.y, p.x")
    joins = " LEFT JOIN best a ON a.frame_id = p.frame_id" if shifted else ""
    return f"""
px AS (SELECT r.burst, {place}, r.is_ref, r.e_rel, CAST(p.v AS DOUBLE) AS v, CAST(60 + 2 * ((p.y % 2) * 2 + p.x % 2) AS DOUBLE) AS bl
       FROM pixels p JOIN rel r ON r.frame_id = p.frame_id{joins}),
wt AS (SELECT *, greatest(v - bl, 0.0::DOUBLE) AS lin, CASE WHEN v < 0.98::DOUBLE * 800 THEN
         exp(-((v - bl) / (800 - bl) - 0.5::DOUBLE) * ((v - bl) / (800 - bl) - 0.5::DOUBLE) / (2.0::DOUBLE * 0.2::DOUBLE * 0.2::DOUBLE)) + 1e-3::DOUBLE END AS w
       FROM px WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7),
merged AS (SELECT burst, y, x, coalesce(sum(w * lin / e_rel) / sum(w), max(CASE WHEN is_ref THEN lin END)) AS radiance
       FROM wt GROUP BY burst, y, x HAVING max(CASE WHEN is_ref THEN lin END) IS NOT NULL)"""


@query("a1_bracket_merge", with_views("shots", "pixels", more=SCALARS_SQL + "," + merged_sql(False)) + f"""
SELECT burst, y, x, {rounded_sql('radiance', 4)} AS radiance FROM merged""")
def _(spark, sf):
    frames = shot_frames(spark, sf)
    per_burst, per_frame = bursts.burst_scalars(frames)
    merged = bursts.merge_brackets(views.pixels(spark, sf), frames, per_burst, per_frame, 8, 8)
    return merged.select("burst", "y", "x", rounded(F.col("radiance"), 4).alias("radiance"))


@query("a4_cfa_bin", with_views("pixels") + """
SELECT frame_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, avg(v) AS v FROM pixels WHERE y < 6 GROUP BY 1, y // 2, x // 2""")
def _(spark, sf):
    return bursts.halve(views.pixels(spark, sf), "frame_id", 8, 7)


@query("a5_pyramid", with_views("images") + """
SELECT image_id, 0 AS level, y, x, CAST(v AS DOUBLE) AS v FROM images
UNION ALL SELECT image_id, 1, CAST(y // 2 AS INT), CAST(x // 2 AS INT), avg(v) FROM images GROUP BY image_id, y // 2, x // 2""")
def _(spark, sf):
    levels = bursts.pyramid(views.images(spark, sf), "image_id", 32, 32)
    out = None
    for i, level in enumerate(levels):
        tagged = level.withColumn("level", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    return out


@query("a6_upper_median", with_views("images") + """
SELECT image_id, v AS median FROM (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY v) AS rn,
  count(*) OVER (PARTITION BY image_id) AS n FROM images) q WHERE rn = n // 2 + 1""")
def _(spark, sf):
    return bursts.upper_median(views.images(spark, sf), ["image_id"])


MEDIANS_SQL = """
med AS (SELECT image_id, v AS median FROM (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY v) AS rn,
  count(*) OVER (PARTITION BY image_id) AS n FROM images) q WHERE rn = n // 2 + 1),
bits AS (SELECT image_id, y, x, v > median AS b FROM images JOIN med USING (image_id))"""


@query("a7_bitmap_error", with_views("images", more=MEDIANS_SQL + """,
c AS (SELECT dx, dy FROM (VALUES (-1), (0), (2), (40)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
e AS (SELECT r.image_id // 2 AS pair_id, dx, dy, sum(CASE WHEN r.b <> m.b THEN 1 ELSE 0 END) AS err, count(*) AS cnt
      FROM bits r, c, bits m WHERE r.image_id % 2 = 0 AND m.image_id = r.image_id + 1 AND m.x = r.x + dx AND m.y = r.y + dy GROUP BY 1, 2, 3)""") + """
SELECT p.pair_id, c.dx, c.dy, coalesce(CAST(trunc(err / CAST(cnt AS DOUBLE) * 1e6::DOUBLE) AS BIGINT), 9223372036854775807) AS error
FROM (SELECT DISTINCT image_id // 2 AS pair_id FROM images WHERE image_id % 2 = 0 AND image_id + 1 IN (SELECT image_id FROM images)) p, c
LEFT JOIN e ON e.pair_id = p.pair_id AND e.dx = c.dx AND e.dy = c.dy""")
def _(spark, sf):
    ref, mov = image_pairs(spark, sf)
    both = ref.select("pair_id").distinct().join(mov.select("pair_id").distinct(), "pair_id")
    shifts = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 2, 40) for y in (-1, 0, 1)]))
    candidates = both.select("pair_id", shifts.alias("s")).select("pair_id", "s.dx", "s.dy")
    return bursts.bitmap_error(bursts.bitmap_rows(ref, "pair_id"), bursts.bitmap_rows(mov, "pair_id"), candidates)


def align_sql(ref: str, mov: str, levels: int) -> str:
    """Coarse-to-fine search over ``ref``/``mov`` (pair_id, y, x, v)."""
    out = [f"s{levels} AS (SELECT DISTINCT pair_id, 0 AS dx, 0 AS dy FROM {ref})"]
    for i in reversed(range(levels)):
        for side, src in (("r", ref), ("m", mov)):
            out.append(f"{side}l{i} AS (SELECT pair_id, y // {2**i} AS y, x // {2**i} AS x, avg(v) AS v FROM {src} GROUP BY 1, 2, 3)")
            out.append(f"{side}b{i} AS (SELECT l.pair_id, y, x, v > md AS b FROM {side}l{i} l JOIN (SELECT pair_id, v AS md FROM "
                       f"(SELECT pair_id, v, row_number() OVER (PARTITION BY pair_id ORDER BY v) AS rn, count(*) OVER (PARTITION BY pair_id) AS n "
                       f"FROM {side}l{i}) q WHERE rn = n // 2 + 1) d ON d.pair_id = l.pair_id)")
        out.append(f"c{i} AS (SELECT pair_id, dx * 2 + ox AS dx, dy * 2 + oy AS dy, ox, oy FROM s{i + 1}, (VALUES (-1), (0), (1)) a(ox), (VALUES (-1), (0), (1)) b(oy))")
        out.append(f"e{i} AS (SELECT c.pair_id, c.dx, c.dy, ox, oy, CAST(trunc(sum(CASE WHEN r.b <> m.b THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) * 1e6::DOUBLE) AS BIGINT) AS e "
                   f"FROM c{i} c JOIN rb{i} r ON r.pair_id = c.pair_id JOIN mb{i} m ON m.pair_id = c.pair_id AND m.x = r.x + c.dx AND m.y = r.y + c.dy GROUP BY ALL)")
        out.append(f"s{i} AS (SELECT pair_id, dx, dy FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY e, oy, ox) AS rn FROM e{i}) q WHERE rn = 1)")
    return ",\n".join(out)


@query("a8_align", with_views("images", more="""
ref AS (SELECT image_id AS pair_id, y, x, v FROM images),
mov AS (SELECT a.image_id AS pair_id, a.y, a.x, coalesce(b.v, a.v) AS v FROM images a
  LEFT JOIN images b ON b.image_id = a.image_id AND b.y = a.y - 1 AND b.x = a.x - 2),""" + align_sql("ref", "mov", 2)) + """
SELECT pair_id, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy FROM s0""")
def _(spark, sf):
    ref = views.images(spark, sf).withColumnRenamed("image_id", "pair_id")
    moved = ref.select("pair_id", (F.col("y") + 1).alias("y"), (F.col("x") + 2).alias("x"), F.col("v").alias("mv"))
    mov = ref.join(moved, ["pair_id", "y", "x"], "left").select("pair_id", "y", "x", F.coalesce("mv", "v").alias("v"))
    return bursts.align(ref, mov, 32, 32)


MERGE_SQL = with_views("shots", "pixels", more=SCALARS_SQL + """,
proxy AS (SELECT frame_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, avg(v) AS v FROM pixels GROUP BY 1, y // 2, x // 2),
ref1 AS (SELECT r.frame_id AS pair_id, y, x, v FROM rel r JOIN scal s ON s.burst = r.burst AND NOT r.is_ref JOIN proxy p ON p.frame_id = s.ref_frame),
mov1 AS (SELECT r.frame_id AS pair_id, y, x, v FROM rel r JOIN proxy p ON p.frame_id = r.frame_id AND NOT r.is_ref),
""" + align_sql("ref1", "mov1", 1) + ", best AS (SELECT pair_id AS frame_id, dx, dy FROM s0)," + merged_sql(True))
MERGED_COLUMNS = """CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(least(greatest(round(radiance), 0), trunc(out_white)) AS BIGINT) AS value, CAST(round(out_white) AS BIGINT) AS white
FROM merged m JOIN scal s ON s.burst = m.burst WHERE s.n = 3"""


@query("m7_burst_merge", MERGE_SQL + f"SELECT m.burst, {MERGED_COLUMNS}")
def _(spark, sf):
    return hdr.merge_bursts(shot_frames(spark, sf), views.pixels(spark, sf), 8, 8)


# two bursts to a run, runs of five sessions in turn
@query("m7_shots_to_merge", MERGE_SQL + f"""
SELECT m.burst // 2 % 5 AS session_id, m.burst // 2 * 6 AS run, m.burst % 2 AS burst, {MERGED_COLUMNS}""")
def _(spark, sf):
    pair = F.floor(F.col("burst") / 2)
    frames = shot_frames(spark, sf).select(
        "*", (pair % 5).alias("session_id"), F.col("frame_id").alias("arrival"), F.concat(F.lit("IMG_"), pair).alias("base")).drop("burst")
    return hdr.merge_shots(frames, views.pixels(spark, sf), 8, 8)
