"""Timing, counters and backlog."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.catalog.common import query, rounded, rounded_sql, views, with_views
from cliploom.operators import scalars, segments, telemetry
from cliploom.operators.segments import Scan

CLIP = "PARTITION BY clip_id ORDER BY arrival"


@query("w1_frame_gaps", with_views("telemetry") + f"""
SELECT clip_id, arrival, CAST(row_number() OVER w - 1 AS BIGINT) AS idx, ts_ns - lag(ts_ns) OVER w AS gap_ns FROM telemetry WINDOW w AS ({CLIP})""")
def _(spark, sf):
    return telemetry.frame_gaps(views.telemetry(spark, sf)).select("clip_id", "arrival", "idx", "gap_ns")


@query("w1_window_max_gap", with_views("telemetry", more=f"""
g AS (SELECT clip_id, row_number() OVER w - 1 AS idx, ts_ns - lag(ts_ns) OVER w AS gap FROM telemetry WINDOW w AS ({CLIP}))""") + """
SELECT clip_id, CAST(idx // 60 AS BIGINT) AS "window", max(gap) AS max_gap_ns FROM g GROUP BY clip_id, idx // 60""")
def _(spark, sf):
    return telemetry.window_max_gap(views.telemetry(spark, sf))


@query("w2_frame_trust", with_views("telemetry", more=f"""
p AS (SELECT clip_id, arrival, ts_ns, lag(ts_ns) OVER ({CLIP}) AS prev FROM telemetry)""") + f"""
SELECT clip_id, arrival, CASE WHEN prev > 0 AND ts_ns > prev THEN
  {rounded_sql("least(1.0::DOUBLE, greatest(0.5::DOUBLE, (1e9::DOUBLE / CASE WHEN clip_id % 4 > 0 THEN clip_id % 4 ELSE 30 END) / (ts_ns - prev)))")}
  ELSE 1.0::DOUBLE END AS trust FROM p""")
def _(spark, sf):
    out = telemetry.frame_trust(views.telemetry(spark, sf), F.col("clip_id") % 4)
    return out.select("clip_id", "arrival", rounded(F.col("trust")).alias("trust"))


@query("w3_frame_history", with_views("telemetry", more=f"""
p AS (SELECT clip_id, arrival, lag(arrival, 1) OVER w AS p1, lag(arrival, 2) OVER w AS p2 FROM telemetry WINDOW w AS ({CLIP}))""") + """
SELECT clip_id, arrival, coalesce(p1, arrival) AS past0, coalesce(p2, p1, arrival) AS past1 FROM p""")
def _(spark, sf):
    frames = views.telemetry(spark, sf).select("clip_id", "arrival", F.col("arrival").alias("frame_id"))
    return telemetry.frame_history(frames).select("clip_id", "arrival", "past0", "past1")


@query("w11_throttle", with_views("neutral") + f"""
SELECT clip_id, arrival, n0, n1, n2 FROM (SELECT *, row_number() OVER ({CLIP}) - 1 AS rn FROM neutral) q WHERE rn % 15 = 0""")
def _(spark, sf):
    return telemetry.throttle(views.neutral(spark, sf)).select("clip_id", "arrival", "n0", "n1", "n2")


@query("w12_running_max", with_views("packets") + f"""
SELECT clip_id, arrival, max(ts_ns) OVER ({CLIP}) AS max_ts, max(CASE WHEN NOT is_audio THEN ts_ns END) OVER ({CLIP}) AS max_video_ts FROM packets""")
def _(spark, sf):
    out = segments.scan(views.packets(spark, sf), ["clip_id"], ["arrival"], {
        "max_ts": Scan("max", F.col("ts_ns")), "max_video_ts": Scan("max", F.when(~F.col("is_audio"), F.col("ts_ns")))})
    return out.select("clip_id", "arrival", "max_ts", "max_video_ts")


@query("w13_first_event", with_views("packets") + f"""
SELECT DISTINCT clip_id, first_value(ts_ns) OVER ({CLIP}) AS first_ts, first_value(is_audio) OVER ({CLIP}) AS first_is_audio,
  first_value(size) OVER ({CLIP}) AS first_size FROM packets""")
def _(spark, sf):
    return scalars.first_event(views.packets(spark, sf), ["clip_id"], "arrival", {
        "first_ts": F.col("ts_ns"), "first_is_audio": F.col("is_audio"), "first_size": F.col("size")})


@query("a9_signal_summary", with_views("samples", more="""
b AS (SELECT clip_id, n, CASE WHEN n % 97 = 5 OR (n = 0 AND clip_id % 10 = 0) THEN 'nan'::DOUBLE WHEN n % 89 = 7 OR (n = 0 AND clip_id % 10 = 1) THEN 'inf'::DOUBLE ELSE CAST(ival AS DOUBLE) END AS v FROM samples),
g AS (SELECT *, isnan(v) OR isinf(v) AS bad FROM b)""") + f"""
SELECT clip_id, count(*) AS n, {rounded_sql("sqrt(sum(CASE WHEN bad THEN 0.0::DOUBLE ELSE v * v END) / count(*))", 4)} AS rms,
  CASE WHEN clip_id % 10 = 0 THEN 'nan'::DOUBLE ELSE min(CASE WHEN NOT bad THEN v END) END AS min,
  CASE WHEN clip_id % 10 = 0 THEN 'nan'::DOUBLE WHEN clip_id % 10 = 1 THEN 'inf'::DOUBLE ELSE max(CASE WHEN NOT bad THEN v END) END AS max,
  count(*) FILTER (WHERE bad) AS bad FROM g GROUP BY clip_id""")
def _(spark, sf):
    n, clip = F.col("n"), F.col("clip_id")
    v = (F.when((n % 97 == 5) | ((n == 0) & (clip % 10 == 0)), float("nan"))
         .when((n % 89 == 7) | ((n == 0) & (clip % 10 == 1)), float("inf")).otherwise(F.col("ival").cast("double")))
    out = telemetry.signal_summary(views.samples(spark, sf).withColumn("v", v), ["clip_id"])
    return out.withColumn("rms", rounded(F.col("rms"), 4))


TELEMETRY_WINDOWS_SQL = with_views("telemetry", more=f"""
m AS (SELECT *, coalesce(sum(CASE WHEN dropped THEN 0 ELSE 1 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 60 AS win,
        ts_ns - lag(ts_ns) OVER w AS gap FROM telemetry WINDOW w AS ({CLIP})),
e AS (SELECT clip_id, arrival, ts_ns - lag(ts_ns) OVER ({CLIP}) AS done_gap FROM telemetry WHERE NOT dropped),
j AS (SELECT m.*, e.done_gap FROM m LEFT JOIN e USING (clip_id, arrival))""") + f"""
SELECT clip_id, CAST(win AS BIGINT) AS "window", count(*) FILTER (WHERE NOT dropped) AS frames,
  {rounded_sql("CASE WHEN sum(done_gap) > 0 THEN 1e9::DOUBLE * count(*) FILTER (WHERE NOT dropped) / sum(done_gap) ELSE 0 END")} AS fps,
  {", ".join(f"{rounded_sql(f'avg({n}_ns) FILTER (WHERE NOT dropped)', 4)} AS {n}_mean_ns, max({n}_ns) FILTER (WHERE NOT dropped) AS {n}_max_ns" for n in ("gpu", "wait", "copy"))},
  max(gap) AS gap_max_ns, count(*) FILTER (WHERE dropped) AS drops
FROM j GROUP BY clip_id, win HAVING count(*) FILTER (WHERE NOT dropped) = 60"""


def rounded_windows(out):
    return out.select(
        "clip_id", "window", "frames", rounded(F.col("fps")).alias("fps"),
        *[rounded(F.col(f"{n}_mean_ns"), 4).alias(f"{n}_mean_ns") for n in ("gpu", "wait", "copy")],
        *[f"{n}_max_ns" for n in ("gpu", "wait", "copy")], "gap_max_ns", "drops")


@query("a10_telemetry_windows", TELEMETRY_WINDOWS_SQL)
def _(spark, sf):
    return rounded_windows(telemetry.telemetry_windows(views.telemetry(spark, sf)))


@query("a11_recording_counters", with_views("telemetry") + """
SELECT clip_id, count(*) AS frames_in, count(*) FILTER (WHERE NOT dropped) AS encoded, count(*) FILTER (WHERE dropped) AS dropped,
  count(*) FILTER (WHERE dropped AND arrival % 3 = 0) AS dropped_store, count(*) FILTER (WHERE dropped AND arrival % 3 = 1) AS dropped_encoder,
  count(*) FILTER (WHERE dropped AND arrival % 3 = 2) AS dropped_gpu FROM telemetry GROUP BY clip_id""")
def _(spark, sf):
    a = F.col("arrival") % 3
    cause = F.when(F.col("dropped"), F.when(a == 0, "store").when(a == 1, "encoder").otherwise("gpu"))
    return telemetry.recording_counters(views.telemetry(spark, sf).withColumn("cause", cause), ["store", "encoder", "gpu"])


BACKLOG_SQL = f"""
log AS (SELECT clip_id, arrival, CASE WHEN event_type IN ('click', 'view') THEN 'push' WHEN event_type = 'error' THEN 'reject' ELSE 'pop' END AS action FROM telemetry),
d AS (SELECT *, CAST(sum(CASE action WHEN 'push' THEN 1 WHEN 'pop' THEN -1 ELSE 0 END) OVER ({CLIP}) AS BIGINT) AS depth FROM log)"""


@query("a17_backlog", with_views("telemetry", more=BACKLOG_SQL) + """
SELECT clip_id, count(*) FILTER (WHERE action = 'push') AS pushed, count(*) FILTER (WHERE action = 'pop') AS popped,
  count(*) FILTER (WHERE action = 'reject') AS rejected, count(*) FILTER (WHERE action = 'reject' AND depth >= 16) AS rejected_full,
  max(depth) AS peak FROM d GROUP BY clip_id""")
def _(spark, sf):
    t = F.col("event_type")
    action = F.when(t.isin("click", "view"), "push").when(t == "error", "reject").otherwise("pop")
    return telemetry.backlog_summary(views.telemetry(spark, sf).withColumn("action", action))


@query("a13_quality_metrics", with_views("samples", more="""
p AS (SELECT clip_id, ival / 32768.0::DOUBLE AS r, (ival + n % 13 * 100) / 32768.0::DOUBLE AS z, (ival + n % 7 * 40) / 32768.0::DOUBLE AS e FROM samples),
m AS (SELECT clip_id, 10 * log10(sum(r * r) / (sum((z - r) * (z - r)) + 1e-12::DOUBLE)) AS si, 10 * log10(sum(r * r) / (sum((e - r) * (e - r)) + 1e-12::DOUBLE)) AS so,
   10 * log10(avg((e - r) * (e - r)) + 1e-12::DOUBLE) AS rd, max(abs(e - z)) AS md FROM p GROUP BY clip_id)""") + f"""
SELECT clip_id, {rounded_sql('si', 4)} AS snr_in, {rounded_sql('so', 4)} AS snr_out, {rounded_sql('rd', 4)} AS residual_db,
  {rounded_sql('md')} AS max_abs_diff, {rounded_sql('so - si', 4)} AS gain_db FROM m""")
def _(spark, sf):
    i, n = F.col("ival"), F.col("n")
    base = views.samples(spark, sf)
    # three variants of a clip, joined sample by sample
    ref = base.select("clip_id", "n", (i / 32768.0).alias("ref"))
    noisy = base.select("clip_id", "n", ((i + n % 13 * 100) / 32768.0).alias("noisy"))
    est = base.select("clip_id", "n", ((i + n % 7 * 40) / 32768.0).alias("est"))
    out = telemetry.quality_metrics(ref.join(noisy, ["clip_id", "n"]).join(est, ["clip_id", "n"]), ["clip_id"])
    digits = {"snr_in": 4, "snr_out": 4, "residual_db": 4, "max_abs_diff": 6, "gain_db": 4}
    return out.select("clip_id", *[rounded(F.col(c), d).alias(c) for c, d in digits.items()])
