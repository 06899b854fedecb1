"""A recorded clip from captured packets to its container roll-up, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.operators import container, pairing, scalars
from cliploom.session import cut_lineage


def written_packets(packets: DataFrame) -> DataFrame:
    """Packets in the order in which they are written: audio gated by video, ``arrival`` being the place.

    ``packets``: clip_id, arrival, is_audio, is_key, ts_ns, size.
    """
    order = pairing.interleave_tracks(packets).select("clip_id", "arrival", F.col("out_pos").cast("long").alias("out_pos"))
    return packets.join(order, ["clip_id", "arrival"]).drop("arrival").withColumnRenamed("out_pos", "arrival")


def container_rollup(packets: DataFrame) -> DataFrame:
    """Clusters as the container has them: times from the first packet written, clusters in written order."""
    # each is read several times by the next step: interleaved and timed once
    written = cut_lineage(written_packets(packets))
    timed = cut_lineage(scalars.relative_time(written))
    return container.cluster_rollup(container.assign_clusters(timed))
