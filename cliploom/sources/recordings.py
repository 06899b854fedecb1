"""Recordings as files: PCM read by byte range, and writes that are listed by their commit.

Layout of PCM recordings: ``<folder>/<clip_id>/<first frame>.pcm``.  A recording is one file or several; a file's name
is the number of its first sample-frame, and every file but a recording's last holds whole blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cliploom.functions.sound import BLOCK_FRAMES
from cliploom.sources.binary import decode_pcm

RANGE_BYTES = 64 << 20
RANGES = 256  # of one reading; a folder that has more has longer ones, up to RANGE_BYTES
BATCH_BYTES = 1 << 20
MANIFEST = "_manifest"
NULL = "__HIVE_DEFAULT_PARTITION__"  # how folders name a null key


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI, or of a plain path that all machines share, and the place in it."""
    if path.startswith("file:") or "://" not in path:
        return pa.fs.LocalFileSystem(), urlparse(path).path if path.startswith("file:") else path
    return pa.fs.FileSystem.from_uri(path)


def _uri(folder: str, path: str) -> str:
    """A place in the file system of ``folder`` as Spark reads it."""
    parts = urlparse(folder)
    return f"{parts.scheme}://{parts.netloc}{path if path.startswith('/') or not parts.scheme else '/' + path}" if parts.scheme else path


@dataclass
class Range(InputPartition):
    """Stretches of whole blocks: (path, clip, number of the first frame, first byte, bytes)."""

    stretches: list[tuple[str, int, int, int, int]]


def plan_ranges(files: list[tuple[str, int, int, int]], block_bytes: int, frame_bytes: int, range_bytes: int,
                most: int = RANGES) -> list[Range]:
    """Cut files (path, clip, first frame, size) at block borders and pack the stretches to about ``range_bytes``.

    A range is a task: where there would be more than ``most``, ranges are as long as a ``most``-th of all files, but not
    beyond ``RANGE_BYTES``, so that large folders still fan out.  A file's partial last block is left out.
    """
    share = min(-(-sum(length // block_bytes for *_, length in files) // most), RANGE_BYTES // block_bytes)
    step = max(1, range_bytes // block_bytes, share) * block_bytes
    out: list[Range] = []
    part, size = [], 0
    for path, clip, first, length in files:
        whole = length // block_bytes * block_bytes
        for at in range(0, whole, step):
            n = min(step, whole - at)
            if part and size + n > step:
                out.append(Range(part))
                part, size = [], 0
            part.append((path, clip, first + at // frame_bytes, at, n))
            size += n
    return [*out, Range(part)] if part else out


class PcmReader(DataSourceReader):
    """Little-endian interleaved PCM: every range of whole blocks is a task's work."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.bits, self.channels = int(options.get("bits", 16)), int(options.get("channels", 1))
        self.block, self.range_bytes = int(options.get("block", BLOCK_FRAMES)), int(options.get("range_bytes", RANGE_BYTES))
        if self.bits not in (16, 24, 32) or self.channels < 1 or self.block < 1:
            raise ValueError("samples have 16, 24 or 32 bits, and there is a channel and a block at least")

    def partitions(self) -> list[Range]:
        system, folder = _filesystem(self.folder)
        found = system.get_file_info(pa.fs.FileSelector(folder, recursive=True))
        files = []
        for info in sorted(found, key=lambda i: i.path):
            *_, clip, name = info.path.split("/")
            if info.type == pa.fs.FileType.File and name.endswith(".pcm"):
                files.append((info.path, int(clip), int(name.removesuffix(".pcm")), info.size))
        frame = self.bits // 8 * self.channels
        # without partitions Spark reads one that is None
        return plan_ranges(files, self.block * frame, frame, self.range_bytes) or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.folder)
        frame = self.bits // 8 * self.channels
        step = max(1, BATCH_BYTES // frame) * frame
        parts: list[tuple[int, int, bytes]] = []  # clip, first frame, whole frames: short stretches share a batch
        size = 0
        for path, clip, first, begin, length in partition.stretches:
            with system.open_input_file(path) as f:
                for at in range(0, length, step):
                    raw = f.read_at(min(step, length - at), begin + at)
                    if parts and size + len(raw) > step:
                        yield self._batch(parts)
                        parts, size = [], 0
                    parts.append((clip, first + at // frame, raw))
                    size += len(raw)
        if parts:
            yield self._batch(parts)

    def _batch(self, parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        channels = self.channels
        counts = np.array([len(raw) for _, _, raw in parts], np.int64) // (self.bits // 8 * channels)
        clips, firsts = (np.array([p[i] for p in parts], np.int64) for i in (0, 1))
        n = np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(clips, counts * channels)), pa.array(np.tile(np.arange(channels, dtype=np.int32), len(n))),
            pa.array(np.repeat(n, channels)), pa.array(decode_pcm(b"".join(raw for _, _, raw in parts), self.bits // 8))],
            names=["clip_id", "ch", "n", "ival"])


class PcmSource(DataSource):
    """``spark.read.format("pcm").options(bits=16, channels=1).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return "clip_id long, ch int, n long, ival int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PcmReader(dict(self.options))


def read_pcm_ranges(spark: SparkSession, folder: str, bits: int, channels: int, block: int = BLOCK_FRAMES,
                    range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Samples of the PCM recordings under ``folder``: ``clip_id, ch, n, ival``.

    Files are read by ranges of about ``range_bytes`` that begin and end at blocks of ``block`` frames, so one long
    recording is the work of many tasks and no task holds more than a megabyte of it.  The partial last block of
    a file is dropped.  ``folder`` is a path or URI that the driver and all executors reach.
    """
    spark.dataSource.register(PcmSource)
    return spark.read.format("pcm").options(bits=bits, channels=channels, block=block, range_bytes=range_bytes).load(folder)


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: (key, path, rows)."""

    files: list[tuple[str, str, int]]


class _ListedWriter(DataSourceArrowWriter):
    """Writes files of its own name and lists them only when the job commits.

    A task that fails removes its files; whatever it could not remove is in no manifest.
    """

    def __init__(self, options: dict):
        self.folder, self.key = options["path"].rstrip("/"), options["key"]
        self.job = options["job"]

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = sorted(f for m in messages if m is not None for f in m.files)
        table = pa.table({"key": pa.array([k for k, _, _ in files], pa.string()), "path": pa.array([p for _, p, _ in files], pa.string()),
                          "rows": pa.array([n for _, _, n in files], pa.int64())})
        system, folder = _filesystem(self.folder)
        system.create_dir(f"{folder}/{MANIFEST}")
        pa.parquet.write_table(table, f"{folder}/{MANIFEST}/{self.job}.parquet", filesystem=system)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _filesystem(self.folder)
        for path in [p for m in messages if m is not None for _, p, _ in m.files]:
            system.delete_file(path)


class ParquetWriter(_ListedWriter):
    """One Parquet file for every key of a task; rows come in order of the key."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _filesystem(self.folder)
        files: list[tuple[str, str, int]] = []
        key, out, path, rows = None, None, "", 0

        def close() -> None:
            if out is not None:
                out.close()
                files[-1] = (*files[-1][:2], rows)

        try:
            for batch in iterator:
                column = batch.column(self.key)
                text = np.array(["" if v is None else str(v) for v in column.to_pylist()], object)
                borders = [0, *(np.flatnonzero(text[1:] != text[:-1]) + 1).tolist(), len(text)]
                for a, b in zip(borders, borders[1:]):
                    if a == b:
                        continue
                    if out is None or text[a] != key:
                        close()
                        key, rows = text[a], 0
                        place = f"{folder}/{self.key}={quote(key, safe='') or NULL}"
                        system.create_dir(place)
                        path = f"{place}/part-{uuid.uuid4().hex}.parquet"
                        files.append((key, path, 0))
                        out = pa.parquet.ParquetWriter(path, batch.schema, filesystem=system)
                    out.write_batch(batch.slice(a, b - a))
                    rows += b - a
            close()
        except BaseException:
            if out is not None:
                out.close()
            for _, path, _ in files:
                system.delete_file(path)
            raise
        return Written(files)


class PcmWriter(_ListedWriter):
    """One PCM file for every (clip_id, part) of a task; rows come in order of clip, part, frame and channel."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.width = int(options["bits"]) // 8

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _filesystem(self.folder)
        files: list[tuple[str, str, int]] = []
        current, out = None, None
        try:
            for batch in iterator:
                clips, parts, n, values = (batch.column(c).to_numpy() for c in ("clip_id", "part", "n", "ival"))
                change = (clips[1:] != clips[:-1]) | (parts[1:] != parts[:-1])
                borders = [0, *(np.flatnonzero(change) + 1).tolist(), len(n)]
                for a, b in zip(borders, borders[1:]):
                    if a == b:
                        continue
                    if (clips[a], parts[a]) != current:
                        if out is not None:
                            out.close()
                        current = (clips[a], parts[a])
                        system.create_dir(f"{folder}/{clips[a]}")
                        files.append((str(clips[a]), f"{folder}/{clips[a]}/{n[a]:015d}.pcm", 0))
                        out = system.open_output_stream(files[-1][1])
                    raw = values[a:b].astype("<i4").view(np.uint8).reshape(-1, 4)[:, : self.width]
                    out.write(np.ascontiguousarray(raw).tobytes())
                    files[-1] = (*files[-1][:2], files[-1][2] + b - a)
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            for _, path, _ in files:
                system.delete_file(path)
            raise
        return Written(files)


class ListedSink(DataSource):
    """Sink of :func:`write_listed` (``kind=parquet``) and :func:`write_pcm` (``kind=pcm``)."""

    @classmethod
    def name(cls) -> str:
        return "listed"

    def writer(self, schema: StructType, overwrite: bool) -> _ListedWriter:
        options = dict(self.options)
        return PcmWriter(options) if options["kind"] == "pcm" else ParquetWriter(options)


def _manifest(spark: SparkSession, folder: str, job: str) -> DataFrame:
    return spark.read.schema("key string, path string, rows long").parquet(f"{folder.rstrip('/')}/{MANIFEST}/{job}.parquet")


def write_listed(df: DataFrame, folder: str, key: str = "clip_id") -> DataFrame:
    """Write ``df`` as Parquet under ``<key>=<value>`` folders; returns the manifest ``key, path, rows``.

    The manifest comes from the commit messages of the tasks that succeeded, so nothing is read back and a failed task
    lists nothing.  Adaptive execution cuts a hot key over several tasks and puts small keys together.  A
    null key is listed as an empty one.  Each call adds files and a manifest of its own to the folder.
    """
    spark, job = df.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(ListedSink)
    dealt = df.hint("rebalance", key).sortWithinPartitions(key)
    dealt.write.format("listed").mode("append").options(kind="parquet", key=key, job=job).save(folder)
    return _manifest(spark, folder, job)


def read_listed(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """Rows of all files that a manifest of ``folder`` lists."""
    system, place = _filesystem(folder.rstrip("/"))
    found = system.get_file_info(pa.fs.FileSelector(f"{place}/{MANIFEST}", allow_not_found=True))
    paths = [p for info in found for p in pa.parquet.read_table(info.path, columns=["path"], filesystem=system).column("path").to_pylist()]
    return spark.read.schema(schema).parquet(*[_uri(folder, p) for p in paths]) if paths else spark.createDataFrame([], schema)


def write_pcm(samples: DataFrame, folder: str, bits: int, block: int = BLOCK_FRAMES, blocks_per_file: int = 4096) -> DataFrame:
    """Write ``clip_id, ch, n, ival`` as PCM recordings; returns the manifest ``key, path, rows`` (rows are samples).

    A recording is cut to files of ``blocks_per_file`` blocks, so no task writes more than one of them at a time.  Frames
    are dense and every frame has all its channels.
    """
    if bits not in (16, 24, 32):
        raise ValueError("samples have 16, 24 or 32 bits")
    spark, job = samples.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(ListedSink)
    part = F.floor(F.col("n") / (block * blocks_per_file)).alias("part")
    rows = samples.select(F.col("clip_id").cast("long").alias("clip_id"), part, "n", "ch", "ival")
    dealt = rows.repartition("clip_id", "part").sortWithinPartitions("clip_id", "part", "n", "ch")
    dealt.write.format("listed").mode("append").options(kind="pcm", key="clip_id", job=job, bits=bits).save(folder)
    return _manifest(spark, folder, job)

