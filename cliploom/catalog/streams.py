"""Streaming forms (R), each drained with everything available and checked like the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.catalog.bursts import RUNS_SQL, burst_frames_of
from cliploom.catalog.common import query, table, views, with_views
from cliploom.catalog.container import CLUSTERS_SQL
from cliploom.catalog.pairing import INTERLEAVE_SQL, SHOTS_SQL, shot_log
from cliploom.catalog.telemetry import TELEMETRY_WINDOWS_SQL, rounded_windows
from cliploom.operators import scalars
from cliploom.streaming import ingest, stateful, waiting


_STAGED: dict[tuple, str] = {}


def stream_of(spark, sf, name, by, seal=None, columns=("*",), parts=4):
    """A table as a stream of several parts in order, one part a micro-batch; staged once per session."""
    key = (spark.sparkContext.applicationId, spark.sparkContext.startTime, sf, name, *columns, parts)
    if key not in _STAGED:
        _STAGED[key] = ingest.staged(table(spark, sf, name).select(*columns), by, parts, seal)
    return ingest.read_stream(spark, _STAGED[key], "*.parquet", files_per_trigger=ingest.FILES)


def end_of_clips(spark, sf):
    """A last event for every clip, behind all others."""
    last = table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    ids = spark.range(20).select(F.col("id").alias("user_id"), (F.col("id") + last + 1).alias("event_id"), F.lit("end").alias("event_type"))
    return ids.withColumn("user_id", F.col("user_id").cast(table(spark, sf, "events").schema["user_id"].dataType))


def sealed_events(spark, sf):
    return stream_of(spark, sf, "events", "event_id", seal=end_of_clips(spark, sf))


def events(spark, sf):
    return sealed_events(spark, sf).filter("event_type <> 'end'")


@query("r1_live_ingest", with_views("packets") + "SELECT clip_id, arrival, is_audio, is_key, ts_ns, size FROM packets")
def _(spark, sf):
    packets = views.packets_of(events(spark, sf))
    audio, video = packets.filter("is_audio"), packets.filter("NOT is_audio")
    return ingest.drain(audio).unionByName(ingest.drain(video))


def late_row(spark, sf, name, by):
    """The row that seals a stream: a key an hour behind every other one."""
    last = table(spark, sf, name).agg(F.max(by)).first()[0]
    return spark.range(1).select((F.col("id") + last + 3600).cast(table(spark, sf, name).schema[by].dataType).alias(by))


PART_ROWS = 1 << 22  # of a part of the longer table: what waits in the state of a join grows with a part, not with the table


def order_streams(spark, sf):
    """Orders and line items in as many parts each, so that the one side does not run ahead of the other."""
    parts = max(4, *(-(-table(spark, sf, name).count() // PART_ROWS) for name in ("orders", "lineitem")))
    columns = {"orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")}
    return [stream_of(spark, sf, name, own[0], late_row(spark, sf, name, own[0]), own, parts) for name, own in columns.items()]


def half_streams(spark, sf):
    # watermarks start at the epoch, so the keys are placed an hour after it
    at = ingest.sensor_clock((F.col("ts_ns") + 3600) * 1_000_000_000)
    orders, lines = order_streams(spark, sf)
    images = orders.select(F.col("o_orderkey").alias("ts_ns"), F.col("o_custkey").alias("session_id")).withColumn("at", at)
    results = lines.select(F.col("l_orderkey").alias("ts_ns"), "l_suppkey", "l_linenumber").withColumn("at", at)
    return images, results


@query("r2_pair_streams", """
SELECT o_orderkey AS ts_ns, o_custkey AS session_id, l_suppkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def _(spark, sf):
    paired = ingest.pair_streams(*half_streams(spark, sf)).filter("session_id IS NOT NULL AND l_suppkey IS NOT NULL")
    with ingest.few_states(spark):
        return ingest.drain(paired.select("ts_ns", "session_id", "l_suppkey", "l_linenumber"))


@query("r2_pair_three_streams", """
SELECT o_orderkey AS ts_ns, o_custkey AS session_id, r.l_suppkey, r.l_linenumber, i.l_partkey AS idx
FROM orders JOIN lineitem r ON o_orderkey = r.l_orderkey JOIN lineitem i ON o_orderkey = i.l_orderkey AND i.l_linenumber = 1""")
def _(spark, sf):
    images, results = half_streams(spark, sf)
    at = ingest.sensor_clock((F.col("ts_ns") + 3600) * 1_000_000_000)
    _, lines = order_streams(spark, sf)
    indexes = lines.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("ts_ns"), F.col("l_partkey").alias("idx")).withColumn("at", at)
    paired = ingest.pair_three_streams(images, results, indexes)
    with ingest.few_states(spark):
        return ingest.drain(paired.select("ts_ns", "session_id", "l_suppkey", "l_linenumber", "idx"))


@query("r3_stray_images", """
SELECT o_orderkey AS ts_ns, o_custkey AS session_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def _(spark, sf):
    joined = ingest.pair_streams(*half_streams(spark, sf), strays=True)
    with ingest.few_states(spark):
        strays = ingest.drain(joined.select("ts_ns", "session_id", "l_suppkey")).filter("l_suppkey IS NULL AND session_id IS NOT NULL")
    return strays.drop("l_suppkey")


@query("r3_flush_at_arming", SHOTS_SQL + """,
named AS (SELECT coalesce(i.session_id, r.session_id) AS session_id, coalesce(i.shot, r.shot) AS shot, coalesce(i.ts_ns, r.ts_ns) AS ts_ns,
  i.arrival AS image_arrival, r.arrival AS result_arrival
  FROM img i FULL JOIN res r ON r.session_id = i.session_id AND r.shot = i.shot AND r.ts_ns = i.ts_ns),
newest AS (SELECT session_id, max(shot) AS newest FROM shots GROUP BY session_id)
SELECT n.session_id, n.shot, ts_ns, image_arrival, result_arrival FROM named n JOIN newest x ON x.session_id = n.session_id
WHERE shot < newest OR image_arrival IS NOT NULL AND result_arrival IS NOT NULL""")
def _(spark, sf):
    with ingest.large_state(spark):
        return ingest.drain(waiting.pair_shots(shot_log(events(spark, sf))))


def with_config(packets):
    return packets.withColumn("is_config", F.col("is_key") & (F.col("arrival") % 3 == 0))


OPEN_SQL = """
opened AS (SELECT clip_id AS c, min(arrival) AS o FROM packets WHERE is_key AND arrival % 3 = 0 GROUP BY clip_id),
kept AS (SELECT p.* FROM packets p JOIN opened ON c = clip_id AND arrival >= o)"""


@query("r4_late_and_early_packets", with_views("packets", more=OPEN_SQL) + """
SELECT clip_id, arrival, greatest(ts_ns - first_value(ts_ns) OVER (PARTITION BY clip_id ORDER BY arrival), 0) AS rel_ns FROM kept""")
def _(spark, sf):
    stream = with_config(views.packets_of(events(spark, sf)))
    return ingest.drain(stateful.cluster(stream, needs_open=True)).select("clip_id", "arrival", "rel_ns")


@query("r4_drop_before_open", with_views("packets", more=OPEN_SQL) + """
SELECT clip_id, arrival, greatest(ts_ns - first_value(ts_ns) OVER (PARTITION BY clip_id ORDER BY arrival), 0) AS rel_ns FROM kept""")
def _(spark, sf):
    kept = ingest.drain(stateful.drop_before_open(with_config(views.packets_of(events(spark, sf)))))
    return scalars.relative_time(kept).select("clip_id", "arrival", "rel_ns")


@query("r5_interleave_stream", with_views("packets", more=INTERLEAVE_SQL) + "SELECT * FROM inter")
def _(spark, sf):
    packets = views.packets_of(sealed_events(spark, sf), (F.col("event_type") == "end").alias("is_end"))
    with ingest.large_state(spark):
        return ingest.drain(waiting.interleave(packets))


@query("r6_count_windows", with_views("telemetry", more="""
g AS (SELECT *, row_number() OVER w - 1 AS idx, ts_ns - lag(ts_ns) OVER w AS gap FROM telemetry WINDOW w AS (PARTITION BY clip_id ORDER BY arrival))""") + """
SELECT clip_id, CAST(idx // 60 AS BIGINT) AS "window", min(ts_ns) AS first_ts, max(ts_ns) AS last_ts, coalesce(max(gap), 0) AS max_gap_ns, max(gpu_ns) AS gpu_max_ns
FROM g GROUP BY clip_id, idx // 60 HAVING count(*) = 60""")
def _(spark, sf):
    return ingest.drain(stateful.count_windows(views.telemetry_of(events(spark, sf)), 60))


@query("r7_cluster_stream", with_views("packets", more=CLUSTERS_SQL, recursive=True) + "SELECT clip_id, arrival, rel_ns, base_ns, cluster FROM clus")
def _(spark, sf):
    return ingest.drain(stateful.cluster(views.packets_of(events(spark, sf))))


@query("r8_complete_bursts_stream", f"""WITH {RUNS_SQL}
SELECT session_id, min(base) AS base, min(arrival) AS first_arrival, max(arrival) AS last_arrival, count(*) AS n
FROM islands GROUP BY session_id, run, burst HAVING count(*) = min(expected)""")
def _(spark, sf):
    return ingest.drain(stateful.complete_bursts(burst_frames_of(events(spark, sf))))


@query("r9_drain_backlog", with_views("packets") + """
SELECT clip_id, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes FROM packets GROUP BY clip_id""")
def _(spark, sf):
    done = ingest.drain(views.packets_of(events(spark, sf)))
    return done.groupBy("clip_id").agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))


@query("r10_bounded_triggers", with_views("packets") + "SELECT clip_id, arrival, size FROM packets WHERE is_key")
def _(spark, sf):
    stream = views.packets_of(events(spark, sf))
    return ingest.drain(stream.filter("is_key").select("clip_id", "arrival", "size"))


@query("r11_running_telemetry", with_views("telemetry") + """
SELECT clip_id, count(*) AS frames, count(*) FILTER (WHERE dropped) AS drops, max(gpu_ns) AS gpu_max_ns FROM telemetry GROUP BY clip_id""")
def _(spark, sf):
    def metrics(batch):
        return batch.groupBy("clip_id").agg(
            F.count(F.lit(1)).alias("frames"), F.count_if("dropped").alias("drops"), F.max("gpu_ns").alias("gpu_max_ns"))

    table = ingest.drain_batches(views.telemetry_of(events(spark, sf)), metrics)
    return table.groupBy("clip_id").agg(
        F.sum("frames").alias("frames"), F.sum("drops").alias("drops"), F.max("gpu_max_ns").alias("gpu_max_ns"))


@query("r11_live_windows", TELEMETRY_WINDOWS_SQL)
def _(spark, sf):
    out = ingest.drain(stateful.telemetry_windows(views.telemetry_of(events(spark, sf)), 60))
    return rounded_windows(out)


@query("r12_hold_for_neutral", with_views("neutral", more="""
n AS (SELECT * FROM neutral WHERE is_neutral), f AS (SELECT clip_id, arrival FROM neutral WHERE is_frame),
h AS (SELECT clip_id, arg_min(n0, arrival) AS h0, arg_min(n1, arrival) AS h1, arg_min(n2, arrival) AS h2 FROM n GROUP BY clip_id)""") + """
SELECT f.clip_id, f.arrival, coalesce(n.n0, h0) AS n0, coalesce(n.n1, h1) AS n1, coalesce(n.n2, h2) AS n2
FROM f ASOF LEFT JOIN n ON f.clip_id = n.clip_id AND f.arrival >= n.arrival JOIN h ON f.clip_id = h.clip_id""")
def _(spark, sf):
    with ingest.large_state(spark):
        return ingest.drain(waiting.hold_for_neutral(views.neutral_of(events(spark, sf))))
