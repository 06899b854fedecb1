"""Streaming sources, sinks and joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.session import durable_dir


def read_stream(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int = 16) -> DataFrame:
    """Files of one table as a stream.  ``files_per_trigger`` bounds a micro-batch: pressure slows reading, nothing is dropped."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


FILES = 4  # of a micro-batch of staged rows
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LARGE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def staged(rows: DataFrame, by: str, parts: int = 4, seal: DataFrame | None = None, files: int = FILES) -> str:
    """A folder with ``rows`` as files in the order of the integer ``by``, and behind them the rows of ``seal``.

    Parts of ``files`` files come one after the other, as a recorder writes them, so a stream that takes ``files``
    per batch never goes back.  Rows go to their part where they are read; a part is then written by several
    tasks, and filled up with empty files.  Rows without a ``by`` are in the first part.
    """
    spark = rows.sparkSession
    root = f"{durable_dir(spark)}/staged-{uuid.uuid4().hex}"
    folder = f"{root}/files"
    low, high = rows.agg(F.min(by), F.max(by)).first()
    size = ((high or 0) - (low or 0)) // parts + 1
    part = F.coalesce(F.floor((F.col(by) - (low or 0)) / size), F.lit(0))
    rows.withColumn("__part", part).write.partitionBy("__part").parquet(f"{root}/parts")
    empty = rows.limit(0).coalesce(1)
    sealing = [] if seal is None else [rows.limit(0).unionByName(seal, allowMissingColumns=True)]
    for i in range(parts + len(sealing)):
        own = sealing[0] if i == parts else spark.read.schema(rows.schema).parquet(f"{root}/parts/__part={i}").repartition(files) if _there(
            spark, f"{root}/parts/__part={i}") else empty
        own.write.mode("append").parquet(folder)
        for _ in range((i + 1) * files - len(spark.read.schema(rows.schema).parquet(folder).inputFiles())):
            empty.write.mode("append").parquet(folder)
    return folder


def _there(spark: SparkSession, folder: str) -> bool:
    """Whether a folder is there, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


@contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which the processors of ``waiting`` need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, LARGE)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


@contextmanager
def few_states(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep one partition of state for each core at most.

    Every partition commits the files of all its stores in every micro-batch, however few rows it has.
    """
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), max(8, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def drain(stream: DataFrame) -> DataFrame:
    """Process everything available, finish, and return what was written."""
    spark = stream.sparkSession
    folder = f"{durable_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_batches(stream: DataFrame, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``each`` to every micro-batch and keep its rows in a metrics table.

    A batch writes its own folder by number, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    folder = f"{durable_dir(spark)}/metrics-{uuid.uuid4().hex}"
    schema = each(spark.createDataFrame([], stream.schema)).schema

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def sensor_clock(ts_ns: Column) -> Column:
    """Microsecond timestamp of a nanosecond clock, for watermarks only."""
    return F.timestamp_micros(F.floor(ts_ns / 1000))


def pair_streams(images: DataFrame, results: DataFrame, delay: str = "10 seconds", strays: bool = False) -> DataFrame:
    """Image and result halves with the same ``ts_ns``, either first; state is evicted by the watermarks.

    With ``strays`` also the images whose result never came, once the watermark has passed them; a sealed
    input ends with a late row on both sides, which carries the watermark past the last images.
    Both sides need ``ts_ns`` and ``at`` (a timestamp from the same clock).
    """
    left = images.withWatermark("at", delay)
    right = results.withColumnsRenamed({"ts_ns": "result_ts", "at": "result_at"}).withWatermark("result_at", delay)
    same = (F.col("ts_ns") == F.col("result_ts")) & (F.col("result_at") >= F.col("at")) & (
        F.col("result_at") <= F.col("at"))
    return left.join(right, same, "left_outer" if strays else "inner")


def pair_three_streams(images: DataFrame, results: DataFrame, indexes: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Image, result and burst index of one ``ts_ns``, in whatever order they come; each side has ``ts_ns`` and ``at``."""
    third = indexes.withColumnsRenamed({"ts_ns": "index_ts", "at": "index_at"}).withWatermark("index_at", delay)
    two = pair_streams(images, results, delay)
    same = (F.col("ts_ns") == F.col("index_ts")) & (F.col("index_at") >= F.col("at")) & (F.col("index_at") <= F.col("at"))
    return two.join(third, same)
