"""Parquet output with a manifest, and the rules for what a session's manifest lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.operators import segments
from cliploom.sources import recordings


def write_with_manifest(df: DataFrame, folder: str, key: str = "clip_id") -> DataFrame:
    """Write partitioned by ``key`` and list what was written: key, path, rows.

    The list comes from the tasks' commit messages (``recordings.write_listed``), so a row appears only for files of
    tasks that succeeded, and nothing is read back.
    """
    listed = recordings.write_listed(df, folder, key)
    kind = df.schema[key].dataType
    return listed.select(F.when(F.col("key") != "", F.col("key")).cast(kind).alias(key), "path", "rows")


def session_manifest(log: DataFrame) -> DataFrame:
    """Ordered output list per session from an action log.

    ``log``: session_id, arrival, kind (``still`` | ``video`` | ``sidecar``), path, complete.
    A video is listed as soon as it starts, even if it never opens; stills and side-cars only
    when fully written; empty paths never.
    """
    listed = log.filter((F.col("path") != "") & ((F.col("kind") == "video") | F.col("complete")))
    ranked = segments.position(listed, ["session_id"], ["arrival"], "ord")
    return ranked.select("session_id", "ord", "path", "kind")
