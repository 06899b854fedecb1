"""Stream joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.catalog.common import query, rounded, rounded_sql, table, views, with_views
from cliploom.operators import pairing


def halves(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    images = orders.select(F.col("o_orderkey").alias("ts_ns"), F.col("o_custkey").alias("session_id"))
    results = lines.groupBy(F.col("l_orderkey").alias("ts_ns")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("exposure"), F.max("l_linenumber").alias("iso"))
    indexes = lines.groupBy(F.col("l_orderkey").alias("ts_ns")).agg(F.min("l_linenumber").alias("idx"))
    return images, results, indexes


@query("j1_pair_captures", """
SELECT o_orderkey AS ts_ns, o_custkey AS session_id, exposure, iso, idx FROM orders JOIN (
  SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS exposure, max(l_linenumber) AS iso, min(l_linenumber) AS idx
  FROM lineitem GROUP BY l_orderkey) r ON o_orderkey = l_orderkey""")
def _(spark, sf):
    return pairing.pair_captures(*halves(spark, sf))


@query("j2_stray_captures", """
WITH r AS (SELECT o_orderkey AS ts_ns, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
l AS (SELECT DISTINCT l_orderkey AS ts_ns FROM lineitem)
SELECT ts_ns, 'beyond' AS reason FROM r WHERE rn > 8
UNION ALL SELECT ts_ns, 'no_result' FROM r WHERE rn <= 8 AND ts_ns NOT IN (SELECT ts_ns FROM l)
UNION ALL SELECT ts_ns, 'no_image' FROM l WHERE ts_ns NOT IN (SELECT ts_ns FROM r WHERE rn <= 8)""")
def _(spark, sf):
    images, results, _ = halves(spark, sf)
    return pairing.stray_captures(images, results.select("ts_ns"), wanted=8)


SHOTS_SQL = """
WITH log AS (SELECT user_id % 20 AS session_id, event_id AS arrival, CASE event_type WHEN 'purchase' THEN 'arm' WHEN 'click' THEN 'image' ELSE 'result' END AS kind,
               event_id // 60 AS ts_ns, 2 + event_id % 5 AS wanted FROM events),
shots AS (SELECT *, CAST(sum(CASE WHEN kind = 'arm' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS shot, max(CASE WHEN kind = 'arm' THEN arrival END) OVER w AS armed
          FROM log WINDOW w AS (PARTITION BY session_id ORDER BY arrival)),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.session_id, s.shot ORDER BY s.arrival) AS rn, a.wanted AS lim
        FROM shots s JOIN log a ON a.session_id = s.session_id AND a.arrival = s.armed WHERE s.kind = 'image'),
img AS (SELECT * FROM ranked WHERE rn <= lim), res AS (SELECT * FROM shots WHERE kind = 'result' AND shot > 0)"""


def shot_log(events):
    """Armings, images and results of an events table or stream."""
    i, kind = F.col("event_id"), F.col("event_type")
    return events.select(
        (F.col("user_id") % 20).alias("session_id"), i.alias("arrival"),
        F.when(kind == "purchase", "arm").when(kind == "click", "image").otherwise("result").alias("kind"),
        F.floor(i / 60).alias("ts_ns"), (2 + i % 5).alias("wanted"))


@query("j2_pair_shots", SHOTS_SQL + """
SELECT i.session_id, i.shot, i.ts_ns, i.arrival AS image_arrival, r.arrival AS result_arrival
FROM img i JOIN res r ON r.session_id = i.session_id AND r.shot = i.shot AND r.ts_ns = i.ts_ns""")
def _(spark, sf):
    return pairing.pair_shots(shot_log(table(spark, sf, "events")))


@query("j3_enrich_frames", """
SELECT event_id AS frame_id, user_id % 90 AS device,
  CASE WHEN event_id % 3 = 0 THEN event_id % 70 ELSE s_suppkey % 64 END AS black0,
  CASE WHEN event_id % 4 = 0 THEN (event_id % 9) / 8.0::DOUBLE ELSE s_nationkey / 32.0::DOUBLE END AS neutral0,
  CASE WHEN event_id % 5 > 0 THEN event_id % 5 * 200 ELSE 1000 + s_suppkey END AS white
FROM events LEFT JOIN supplier ON s_suppkey = user_id % 90""")
def _(spark, sf):
    i, s = F.col("event_id"), F.col("s_suppkey")
    frames = table(spark, sf, "events").select(
        i.alias("frame_id"), (F.col("user_id") % 90).alias("device"),
        F.when(i % 3 == 0, F.array(i % 70)).alias("black"),
        F.when(i % 4 == 0, F.array(i % 9 / 8.0)).alias("neutral"),
        (i % 5 * 200).alias("white"))
    devices = table(spark, sf, "supplier").select(
        s.alias("device"), F.array(s % 64).alias("black"), F.array(F.col("s_nationkey") / 32.0).alias("neutral"),
        (s + 1000).alias("white"))
    return pairing.enrich_frames(frames, devices).select(
        "frame_id", "device", F.col("black")[0].alias("black0"), F.col("neutral")[0].alias("neutral0"), "white")


@query("j4_newest_neutral", with_views("neutral", more="""
n AS (SELECT * FROM neutral WHERE is_neutral), f AS (SELECT clip_id, arrival FROM neutral WHERE is_frame),
h AS (SELECT clip_id, arg_min(n0, arrival) AS h0, arg_min(n1, arrival) AS h1, arg_min(n2, arrival) AS h2 FROM n GROUP BY clip_id)""") + """
SELECT f.clip_id, f.arrival, coalesce(n.n0, h0) AS n0, coalesce(n.n1, h1) AS n1, coalesce(n.n2, h2) AS n2
FROM f ASOF LEFT JOIN n ON f.clip_id = n.clip_id AND f.arrival >= n.arrival LEFT JOIN h ON f.clip_id = h.clip_id""")
def _(spark, sf):
    return pairing.newest_neutral(views.neutral(spark, sf), ["n0", "n1", "n2"])


INTERLEAVE_SQL = """
r AS (SELECT *, max(CASE WHEN NOT is_audio THEN ts_ns END) OVER w AS v_max, max(CASE WHEN is_audio THEN ts_ns END) OVER w AS a_max
      FROM packets WINDOW w AS (PARTITION BY clip_id ORDER BY arrival)),
v AS (SELECT clip_id, arrival, v_max FROM r WHERE NOT is_audio),
g AS (SELECT a.clip_id, a.arrival, min(v.arrival) AS gate FROM r a LEFT JOIN v
      ON v.clip_id = a.clip_id AND v.arrival > a.arrival AND v.v_max >= a.a_max WHERE a.is_audio GROUP BY 1, 2),
o AS (SELECT p.clip_id, p.arrival, p.is_audio, g.gate FROM packets p LEFT JOIN g USING (clip_id, arrival)),
inter AS (SELECT *, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY
        CASE WHEN is_audio THEN gate ELSE arrival END NULLS LAST, NOT is_audio, arrival) - 1 AS BIGINT) AS out_pos FROM o)"""


@query("j5_interleave_tracks", with_views("packets", more=INTERLEAVE_SQL) + "SELECT * FROM inter")
def _(spark, sf):
    return pairing.interleave_tracks(views.packets(spark, sf))


def _bands_sql() -> str:
    from cliploom.functions.sound import BAND_WIDTHS

    rows, k = [], 0
    for b, w in enumerate(BAND_WIDTHS):
        rows.append(f"({b}, {w}, {k}, {k + w - 1})")
        k += w
    return f"bands AS (SELECT * FROM (VALUES {', '.join(rows)}) t(band, width, lo, hi))"


@query("j6_band_lookup", f"""WITH {_bands_sql()}
SELECT l_partkey % 481 AS k, band, width, count(*) AS n FROM lineitem JOIN bands ON l_partkey % 481 BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def _(spark, sf):
    bins = table(spark, sf, "lineitem").select((F.col("l_partkey") % 481).alias("k"))
    return pairing.with_band(bins).groupBy("k", "band", "width").agg(F.count(F.lit(1)).alias("n"))


def image_pairs(spark, sf):
    im = views.images(spark, sf).withColumn("pair_id", F.floor(F.col("image_id") / 2).cast("long"))
    return im.filter("image_id % 2 = 0"), im.filter("image_id % 2 = 1")


@query("j7_shifted_overlap", with_views("images") + """
SELECT r.image_id // 2 AS pair_id, r.y, r.x, r.v AS ref_v, m.v AS mov_v FROM images r JOIN images m
  ON m.image_id = r.image_id + 1 AND m.x = r.x + 2 AND m.y = r.y - 1 WHERE r.image_id % 2 = 0""")
def _(spark, sf):
    return pairing.shifted_overlap(*image_pairs(spark, sf), dx=2, dy=-1)


def _j8(chunk: int, warmup: int, suffix: str, view: str) -> None:
    @query(f"j8_chunk_with_warmup{suffix}", with_views(view, more=f"""
l AS (SELECT clip_id, max(n) // {chunk} AS last_chunk FROM {view} GROUP BY clip_id)""") + f"""
SELECT s.clip_id, n AS t, c AS chunk, c = n // {chunk} AS keep FROM {view} s JOIN l ON s.clip_id = l.clip_id,
  (SELECT DISTINCT n // {chunk} AS c FROM {view}) cs WHERE c <= last_chunk AND n >= c * {chunk} - {warmup} AND n < (c + 1) * {chunk}""")
    def _(spark, sf):
        frames = getattr(views, view)(spark, sf).select("clip_id", F.col("n").alias("t"))
        return pairing.chunk_with_warmup(frames, chunk, warmup)


_j8(200, 10, "", "samples")
_j8(2000, 100, "_full", "long_samples")


FIFO_SQL = """
log AS (SELECT user_id % 20 AS session_id, event_id AS arrival, CASE WHEN event_type IN ('signup', 'view') THEN 'name'
          WHEN event_type = 'error' THEN 'fail' ELSE 'image' END AS kind FROM events),
c AS (SELECT *, sum(CASE WHEN kind = 'name' THEN -1 ELSE 1 END) OVER w AS excess,
        sum(CASE WHEN kind = 'name' THEN 0 ELSE 1 END) OVER w AS takes,
        sum(CASE WHEN kind = 'name' THEN 1 ELSE 0 END) OVER w AS names FROM log WINDOW w AS (PARTITION BY session_id ORDER BY arrival)),
m AS (SELECT *, greatest(0, max(excess) OVER (PARTITION BY session_id ORDER BY arrival)) AS missed,
        greatest(0, coalesce(max(excess) OVER (PARTITION BY session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS earlier FROM c)"""


@query("j9_fifo_names", f"""WITH {FIFO_SQL}
SELECT t.session_id, t.arrival, n.arrival AS name_arrival FROM m t LEFT JOIN m n
  ON n.session_id = t.session_id AND n.kind = 'name' AND t.missed = t.earlier AND n.names = t.takes - t.missed
WHERE t.kind = 'image'""")
def _(spark, sf):
    t = F.col("event_type")
    log = table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("session_id"), F.col("event_id").alias("arrival"),
        F.when(t.isin("signup", "view"), "name").when(t == "error", "fail").otherwise("image").alias("kind"))
    return pairing.fifo_names(log)
