"""Blocks, clusters and NAL units."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliploom.catalog.common import query, views, with_views
from cliploom.catalog.pairing import INTERLEAVE_SQL
from cliploom.operators import container, scalars
from cliploom.plans import clip


def _w8(size: int, suffix: str, view: str) -> None:
    @query(f"w8_full_blocks{suffix}", with_views(view) + f"""
SELECT clip_id, ch, n, n // {size} AS block FROM {view} s
WHERE n < (SELECT count(*) // {size} * {size} FROM {view} t WHERE t.clip_id = s.clip_id)""")
    def _(spark, sf):
        return container.full_blocks(getattr(views, view)(spark, sf), size).select("clip_id", "ch", "n", "block")


_w8(128, "", "samples")
_w8(3840, "_full", "long_samples")


CLUSTERS_SQL = """
rel AS (SELECT clip_id, arrival, is_audio, is_key, size, greatest(ts_ns - first_value(ts_ns) OVER (PARTITION BY clip_id ORDER BY arrival), 0) AS rel_ns,
          row_number() OVER (PARTITION BY clip_id ORDER BY arrival) AS rn FROM packets),
walk AS (
  SELECT clip_id, rn, rel_ns AS base_ns, CAST(0 AS BIGINT) AS cluster FROM rel WHERE rn = 1
  UNION ALL
  SELECT r.clip_id, r.rn, CASE WHEN (NOT r.is_audio AND r.is_key AND r.rel_ns <> w.base_ns) OR abs(r.rel_ns - w.base_ns) > 1000000000 THEN r.rel_ns ELSE w.base_ns END,
         w.cluster + CASE WHEN (NOT r.is_audio AND r.is_key AND r.rel_ns <> w.base_ns) OR abs(r.rel_ns - w.base_ns) > 1000000000 THEN 1 ELSE 0 END
  FROM walk w JOIN rel r ON r.clip_id = w.clip_id AND r.rn = w.rn + 1),
clus AS (SELECT r.*, w.base_ns, w.cluster FROM rel r JOIN walk w USING (clip_id, rn))"""


def clustered(spark, sf):
    return container.assign_clusters(scalars.relative_time(views.packets(spark, sf)))


@query("w9_assign_clusters", with_views("packets", more=CLUSTERS_SQL, recursive=True) + """
SELECT clip_id, arrival, rel_ns, base_ns, cluster FROM clus""")
def _(spark, sf):
    return clustered(spark, sf).select("clip_id", "arrival", "rel_ns", "base_ns", "cluster")


AUDIO_ONLY = CLUSTERS_SQL.replace("FROM packets)", "FROM packets WHERE is_audio)")


@query("w9_audio_only_clusters", with_views("packets", more=AUDIO_ONLY, recursive=True) + """
SELECT clip_id, arrival, rel_ns, base_ns, cluster FROM clus""")
def _(spark, sf):
    audio = scalars.relative_time(views.packets(spark, sf).filter("is_audio"))
    return container.assign_clusters(audio, bits=11).select("clip_id", "arrival", "rel_ns", "base_ns", "cluster")


@query("a14_cluster_rollup", with_views("packets", more=CLUSTERS_SQL, recursive=True) + """
SELECT clip_id, cluster, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, min(base_ns) AS base_ns, max(rel_ns) - min(rel_ns) AS span_ns,
  min(arrival) AS cue_arrival, arg_min(is_audio, arrival) AS cue_is_audio FROM clus GROUP BY clip_id, cluster""")
def _(spark, sf):
    return container.cluster_rollup(clustered(spark, sf))


WRITTEN_SQL = INTERLEAVE_SQL + """,
written AS (SELECT i.clip_id, i.out_pos AS arrival, p.is_audio, p.is_key, p.size, p.ts_ns FROM inter i JOIN packets p ON p.clip_id = i.clip_id AND p.arrival = i.arrival),
""" + CLUSTERS_SQL.replace("FROM packets)", "FROM written)")


@query("clip_container_rollup", with_views("packets", more=WRITTEN_SQL, recursive=True) + """
SELECT clip_id, cluster, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, min(base_ns) AS base_ns, max(rel_ns) - min(rel_ns) AS span_ns,
  min(arrival) AS cue_arrival, arg_min(is_audio, arrival) AS cue_is_audio FROM clus GROUP BY clip_id, cluster""")
def _(spark, sf):
    return clip.container_rollup(views.packets(spark, sf))


@query("a14_clip_durations", with_views("packets", more=CLUSTERS_SQL.split("walk AS")[0].rstrip().rstrip(",")) + """
SELECT clip_id, max(rel_ns) AS duration_ns, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes FROM rel GROUP BY clip_id""")
def _(spark, sf):
    return container.clip_durations(scalars.relative_time(views.packets(spark, sf)))


@query("m12_split_nals", with_views("nals") + "SELECT packet_id, ord, size, nal_type FROM nals")
def _(spark, sf):
    nals = container.split_nals(views.nal_payloads(spark, sf))
    kind = F.shiftright("first_byte", 1).bitwiseAND(F.lit(63)).cast("int").alias("nal_type")
    return nals.select("packet_id", "ord", "size", kind)


@query("p22_classify_nals", with_views("nals") + """
SELECT packet_id, ord, nal_type, CASE nal_type WHEN 32 THEN 'VPS' WHEN 33 THEN 'SPS' WHEN 34 THEN 'PPS' ELSE 'SLICE' END AS name FROM nals WHERE size >= 2""")
def _(spark, sf):
    named = container.classify_nals(container.split_nals(views.nal_payloads(spark, sf)))
    return named.select("packet_id", "ord", "nal_type", "name")


@query("p22_framed_sizes", with_views("nals") + """
SELECT packet_id, CAST(sum(size + 4) AS BIGINT) AS framed_size, count(*) AS units FROM nals GROUP BY packet_id""")
def _(spark, sf):
    return container.framed_sizes(container.split_nals(views.nal_payloads(spark, sf)))


# letters stand in for parameter sets here: unit types 32-34 do occur in the text bytes 64-69 ('@', 'A'-'E')
SETS_SQL = """
s AS (SELECT packet_id % 50 AS clip_id, packet_id, nal_type FROM nals WHERE size >= 2)"""


@query("a15_parameter_sets", with_views("nals", more=SETS_SQL) + """
SELECT clip_id, count(*) FILTER (WHERE nal_type = 32) AS vps, count(*) FILTER (WHERE nal_type = 33) AS sps, count(*) FILTER (WHERE nal_type = 34) AS pps,
  count(*) FILTER (WHERE nal_type = 33) > 0 AND count(*) FILTER (WHERE nal_type = 34) > 0 AS valid FROM s GROUP BY clip_id""")
def _(spark, sf):
    nals = container.split_nals(views.nal_payloads(spark, sf)).withColumn("clip_id", F.col("packet_id") % 50)
    return container.parameter_sets(nals)


@query("a15_first_config", with_views("nals", more=SETS_SQL) + """
SELECT clip_id, min(packet_id) AS config_packet FROM (SELECT clip_id, packet_id FROM s GROUP BY 1, 2
  HAVING bool_or(nal_type = 33) AND bool_or(nal_type = 34)) q GROUP BY clip_id""")
def _(spark, sf):
    nals = container.split_nals(views.nal_payloads(spark, sf)).withColumn("clip_id", F.col("packet_id") % 50)
    return container.first_config(nals)
