"""Capture-shaped views over the driver tables, each with the SQL that defines it.

The Spark forms need no whole-clip window: ranks come from ``segments.position`` and
images are tiled from dense vector ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.operators import segments
from cliploom.sources.tables import table

PACKETS_SQL = """
packets AS (
  SELECT user_id % 20 AS clip_id, event_id AS arrival,
         event_type IN ('click', 'view') AS is_audio, event_type = 'purchase' AS is_key,
         event_id * 2000000 - ((event_id * 7919) % 11) * 100000000 AS ts_ns,
         CAST(round(value * 100) AS BIGINT) AS size
  FROM events)"""


def packets(spark: SparkSession, folder: str) -> DataFrame:
    return packets_of(table(spark, folder, "events"))


def packets_of(events: DataFrame, *extra: Column) -> DataFrame:
    """Packets of an events table or stream, with ``extra`` columns of its rows."""
    return events.select(
        (F.col("user_id") % 20).alias("clip_id"),
        F.col("event_id").alias("arrival"),
        F.col("event_type").isin("click", "view").alias("is_audio"),
        (F.col("event_type") == "purchase").alias("is_key"),
        (F.col("event_id") * 2000000 - (F.col("event_id") * 7919) % 11 * 100000000).alias("ts_ns"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
        *extra,
    )


TELEMETRY_SQL = """
telemetry AS (
  SELECT user_id % 20 AS clip_id, event_id AS arrival, event_id * 33000000 + (event_id % 7) * 1000000 AS ts_ns,
         CAST(round(value * 100) AS BIGINT) AS gpu_ns, (event_id * 37) % 1000 AS wait_ns,
         (event_id * 53) % 500 AS copy_ns, event_type = 'error' AS dropped, event_type
  FROM events)"""


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry_of(table(spark, folder, "events"))


def telemetry_of(events: DataFrame) -> DataFrame:
    """Frame telemetry of an events table or stream."""
    i = F.col("event_id")
    return events.select(
        (F.col("user_id") % 20).alias("clip_id"),
        i.alias("arrival"),
        (i * 33000000 + i % 7 * 1000000).alias("ts_ns"),
        F.round(F.col("value") * 100).cast("long").alias("gpu_ns"),
        (i * 37 % 1000).alias("wait_ns"),
        (i * 53 % 500).alias("copy_ns"),
        (F.col("event_type") == "error").alias("dropped"),
        "event_type",
    )


SHOTS_SQL = """
shots AS (
  SELECT vec_id AS frame_id, vec_id // 3 AS burst, vec_id % 3 AS idx, 3 AS expected,
         CAST(CASE WHEN (vec_id // 3) % 10 = 0 THEN 0
              WHEN vec_id % 3 = 0 THEN 2500000 WHEN vec_id % 3 = 1 THEN 10000000 ELSE 40000000 END AS BIGINT) AS exposure_ns,
         100 AS iso, 800 AS white, 8 AS w, 8 AS h
  FROM embeddings)"""


def shots(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("vec_id")
    burst = F.floor(v / 3).cast("long")
    return table(spark, folder, "embeddings").select(
        v.alias("frame_id"),
        burst.alias("burst"),
        (v % 3).alias("idx"),
        F.lit(3).alias("expected"),
        F.when(burst % 10 == 0, 0)
        .when(v % 3 == 0, 2500000)
        .when(v % 3 == 1, 10000000)
        .otherwise(40000000)
        .cast("long")
        .alias("exposure_ns"),
        F.lit(100).alias("iso"),
        F.lit(800).alias("white"),
        F.lit(8).alias("w"),
        F.lit(8).alias("h"),
    )


PIXELS_SQL = """
pixels AS (
  SELECT frame_id, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x,
         greatest(0, 512 + CAST(round(CAST(e AS DOUBLE) * 1000) AS INT)) AS v
  FROM (SELECT vec_id AS frame_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos
        FROM embeddings) q)"""


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "embeddings")
        .select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("pos", "e"))
        .select(
            "frame_id",
            F.floor(F.col("pos") / 8).cast("int").alias("y"),
            (F.col("pos") % 8).alias("x"),
            F.greatest(F.lit(0), 512 + F.round(F.col("e").cast("double") * 1000).cast("int")).alias("v"),
        )
    )


SAMPLES_SQL = """
samples AS (
  SELECT l_suppkey AS clip_id, 0 AS ch,
         CAST(row_number() OVER (PARTITION BY l_suppkey
              ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS n,
         CAST(round((l_quantity - 25.5) * 1000) AS INT) AS ival
  FROM lineitem)"""


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """One sample per line item, ranked within its supplier; the rank never sorts a whole supplier."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("clip_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"
    )
    ranked = segments.position(
        lines, ["clip_id"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "n"
    )
    return ranked.select(
        "clip_id",
        F.lit(0).alias("ch"),
        "n",
        F.round((F.col("l_quantity") - 25.5) * 1000).cast("int").alias("ival"),
    )


# five long clips, for frames and chunks of the sizes recordings have
LONG_SAMPLES_SQL = """
long_samples AS (
  SELECT l_suppkey % 5 AS clip_id, 0 AS ch,
         CAST(row_number() OVER (PARTITION BY l_suppkey % 5
              ORDER BY l_orderkey, l_suppkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS n,
         CAST(round((l_quantity - 25.5) * 1000) AS INT) AS ival
  FROM lineitem)"""


def long_samples(spark: SparkSession, folder: str) -> DataFrame:
    names = ["l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    lines = table(spark, folder, "lineitem").select((F.col("l_suppkey") % 5).alias("clip_id"), *names, "l_quantity")
    ranked = segments.position(lines, ["clip_id"], names, "n")
    ival = F.round((F.col("l_quantity") - 25.5) * 1000).cast("int").alias("ival")
    return ranked.select("clip_id", F.lit(0).alias("ch"), "n", ival)


# 32x32 images tiled from sixteen consecutive vectors of 8x8; where the last image has fewer, they repeat.
IMAGES_SQL = """
images AS (
  SELECT image_id, CAST(tile // 4 * 8 + pos // 8 AS INT) AS y, CAST(tile % 4 * 8 + pos % 8 AS INT) AS x,
         CAST(round(CAST(e AS DOUBLE) * 1000) AS INT) AS v
  FROM (SELECT image_id, tile, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS pos
        FROM (SELECT image_id, embedding, unnest(range(place, 16, tiles)) AS tile
              FROM (SELECT vec_id // 16 AS image_id, embedding, count(*) OVER (PARTITION BY vec_id // 16) AS tiles,
                           row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) - 1 AS place FROM embeddings) q) t) i)"""


def images(spark: SparkSession, folder: str) -> DataFrame:
    image = F.floor(F.col("vec_id") / 16).cast("long")
    one = Window.partitionBy("image_id")  # sixteen vectors
    vectors = table(spark, folder, "embeddings").select(image.alias("image_id"), "vec_id", "embedding").select(
        "image_id", "embedding", F.count("*").over(one).alias("tiles"),
        (F.row_number().over(one.orderBy("vec_id")) - 1).alias("place"))
    tiled = vectors.select("image_id", "embedding", F.explode(F.sequence("place", F.lit(15), F.col("tiles").cast("int"))).alias("tile"))
    return tiled.select("image_id", "tile", F.posexplode("embedding").alias("pos", "e")).select(
        "image_id",
        (F.floor(F.col("tile") / 4) * 8 + F.floor(F.col("pos") / 8)).cast("int").alias("y"),
        (F.col("tile") % 4 * 8 + F.col("pos") % 8).cast("int").alias("x"),
        F.round(F.col("e").cast("double") * 1000).cast("int").alias("v"),
    )


CONFIGS_SQL = """
configs AS (
  SELECT p_brand AS device, p_partkey AS ord, CAST(p_partkey % 3 AS INT) AS fmt, 16 * p_size AS w,
         CAST(12 * (1 + p_partkey % 50) AS INT) AS h, p_partkey % 7 = 0 AS is_input,
         CAST(15 * (1 + p_partkey % 2) AS INT) AS lo,
         CAST(CASE WHEN p_partkey % 4 = 0 THEN 15 * (1 + p_partkey % 2) ELSE 30 * (1 + p_partkey % 2) END AS INT) AS hi
  FROM part)"""


def configs(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    lo = (15 * (1 + k % 2)).cast("int")
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("device"),
        k.alias("ord"),
        (k % 3).cast("int").alias("fmt"),
        (16 * F.col("p_size")).alias("w"),
        (12 * (1 + k % 50)).cast("int").alias("h"),
        (k % 7 == 0).alias("is_input"),
        lo.alias("lo"),
        F.when(k % 4 == 0, lo).otherwise((30 * (1 + k % 2)).cast("int")).alias("hi"),
    )


NEUTRAL_SQL = """
neutral AS (
  SELECT user_id % 20 AS clip_id, event_id AS arrival, event_type = 'signup' AS is_neutral,
         event_type IN ('purchase', 'error') AS is_frame,
         0.4 + CAST(event_id % 7 AS DOUBLE) / 20 AS n0, 0.4 + CAST(event_id % 8 AS DOUBLE) / 20 AS n1,
         0.4 + CAST(event_id % 9 AS DOUBLE) / 20 AS n2
  FROM events)"""


def neutral(spark: SparkSession, folder: str) -> DataFrame:
    return neutral_of(table(spark, folder, "events"))


def neutral_of(events: DataFrame) -> DataFrame:
    """Neutral readings and frames of an events table or stream."""
    i = F.col("event_id")
    return events.select(
        (F.col("user_id") % 20).alias("clip_id"),
        i.alias("arrival"),
        (F.col("event_type") == "signup").alias("is_neutral"),
        F.col("event_type").isin("purchase", "error").alias("is_frame"),
        *[(0.4 + (i % (7 + k)).cast("double") / 20).alias(f"n{k}") for k in range(3)],
    )


# Document text with every space turned into a start code, four bytes before an odd token and three
# before an even one; the text before the first space is junk ahead of the first code.
def nal_payloads(spark: SparkSession, folder: str) -> DataFrame:
    code = lambda i: F.when(i == 0, F.lit("")).when(i % 2 == 0, F.lit("\x00\x00\x01")).otherwise(
        F.lit("\x00\x00\x00\x01"))
    framed = F.array_join(F.transform(F.split(F.col("text"), " "), lambda t, i: F.concat(code(i), t)), "")
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return documents.select(
        F.col("doc_id").alias("packet_id"), framed.cast("binary").alias("payload")
    )


NALS_SQL = """
nals AS (
  SELECT packet_id, CAST(row_number() OVER (PARTITION BY packet_id ORDER BY pos) - 1 AS BIGINT) AS ord,
         CAST(octet_length(encode(tok)) AS BIGINT) AS size,
         CAST((CAST('0x' || substr(hex(encode(tok)), 1, 2) AS INT) >> 1) & 63 AS INT) AS nal_type
  FROM (SELECT doc_id AS packet_id, unnest(string_split(text, ' ')) AS tok,
               generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents) q
  WHERE tok <> '' AND pos > 1)"""
