"""Token ids in files of directly addressable codes.

The recorder that this library follows keeps no text, so the operator is general: it works on any
table with an integer id column and a text column.

Format.  An id is split into chunks of eight bits, lowest first.  Level 0 holds the first chunk of every
id; level l holds chunk l of those ids that have it, in order.  Each level but the last of an id is
marked in the level's continuation bitmap, and a rank directory holds the number of marks before every
block of 512.  The chunk at place i of a level continues at place rank(i) of the next one, so any token
is read with a few look-ups and no decoding of what lies before it.

A file holds segments of whole documents; a segment carries the documents' ids and lengths, the number
of the shard's ids before it, and its codes.  Shards follow each other in ascending order of document id, so do segments in a shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.llm.common import text_key
from cliploom.llm.vocab import END_ID, encoder, public_file, text_slices

MAGIC = b"DAC1"
RANK_BLOCK = 512
SEGMENT_TOKENS = 1 << 18
SEGMENTS = "shard int, segment int, first long, n_tokens long, doc_ids array<long>, lengths array<long>, codes binary"


def pack(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit ids to one block of codes."""
    rest = np.ascontiguousarray(ids, np.uint32)
    levels = []
    while len(rest):
        more = rest > 0xFF
        marks = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4")
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), marks.tobytes(), ranks.tobytes()))
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<B", len(levels)) + b"".join(struct.pack("<I", level[0]) for level in levels)
    return head + b"".join(part for level in levels for part in level[1:])


def _levels(block: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Views of each level's chunks, continuation bytes and rank directory."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of codes")
    n_levels = block[4]
    at, out = 5 + 4 * n_levels, []
    for n in struct.unpack_from(f"<{n_levels}I", block, 5):
        parts = []
        for size, kind in ((n, np.uint8), ((n + 7) // 8, np.uint8), (-(-n // RANK_BLOCK), np.dtype("<u4"))):
            parts.append(np.frombuffer(block, kind, size, at))
            at += parts[-1].nbytes
        out.append(tuple(parts))
    return out


def unpack(block: bytes) -> np.ndarray:
    """All ids of a block."""
    levels = _levels(block)
    ids = np.zeros(0, np.uint32)
    for chunks, marks, _ in reversed(levels):
        value = chunks.astype(np.uint32)
        value[np.unpackbits(marks, count=len(chunks), bitorder="little").astype(bool)] |= ids << np.uint32(8)
        ids = value
    return ids


def lookup(block: bytes, places: np.ndarray) -> np.ndarray:
    """Ids at the given places; nothing else of the block is decoded."""
    places = np.asarray(places, np.int64)
    out, which = np.zeros(len(places), np.uint32), np.arange(len(places))
    for level, (chunks, marks, ranks) in enumerate(_levels(block)):
        out[which] |= chunks[places].astype(np.uint32) << np.uint32(8 * level)
        more = (marks[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
        places, which = places[more], which[more]
        if not len(places):
            break
        # rank: marks before the block of 512, whole bytes since, bits of the last byte
        first = places // RANK_BLOCK * (RANK_BLOCK // 8)
        span = first[:, None] + np.arange(RANK_BLOCK // 8)
        inside = np.where(span < (places >> 3)[:, None], marks[np.minimum(span, len(marks) - 1)], 0)
        below = marks[places >> 3] & ((1 << (places & 7)) - 1).astype(np.uint8)
        places = ranks[places // RANK_BLOCK].astype(np.int64) + np.bitwise_count(inside).sum(1, dtype=np.int64) + np.bitwise_count(below)
    return out


def write_codes(docs: DataFrame, path: str, tokenizer: str | None = None, id_column: str = "doc_id",
                text_column: str = "text", end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every whole text, append ``end_id`` to it and write the ids to files in ``path``.

    ``tokenizer`` is the path of a tokenizer file, the same on every machine (the public 49k-word file
    if not given).  Null and empty texts have the end id only.  Rows that repeat an id are documents of
    their own, next to each other; rows of null id come first.  Other columns are not read.
    """
    file = tokenizer or public_file("word_bpe_49k.json")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(file), np.array([end_id], "<u4").tobytes()
        shard, segment = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = first = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(part for _, part in held), "<u4")
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([[doc for doc, _ in held]], pa.list_(pa.int64())),
                pa.array([[len(part) // 4 for _, part in held]], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary())],
                names=["shard", "segment", "first", "n_tokens", "doc_ids", "lengths", "codes"])

        for batch in batches:
            coded = (ids for part in text_slices(batch.column("text")) for ids in code.encode(part))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= segment_tokens:
                    yield flush()
                    held, size, segment, first = [], 0, segment + 1, first + size
        if held:
            yield flush()

    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), text_key(text_column).alias("text_key"))
    order = [F.asc_nulls_first("doc_id"), F.asc("text_key")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(segments, SEGMENTS).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``: the number of ids before each, over all shards."""
    stored = spark.read.schema(SEGMENTS).parquet(path)
    shards = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    # a row for each task that wrote: bounded by the number of tasks
    return stored.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("first")).drop("before", "first")


def read_documents(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit integers) of every stored document.

    With ``checksums``, ``ids_crc32`` (unsigned crc32 of those bytes) stands in place of ``ids``, so the
    ids themselves stay in the tasks that decode them.
    """
    last = ("ids_crc32", pa.int64()) if checksums else ("ids", pa.binary())
    form = zlib.crc32 if checksums else np.ndarray.tobytes

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack(batch.column("codes")[i].as_py()).astype("<u4", copy=False)
                lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids")[i].values, pa.array(ends - lengths + batch.column("start")[i].as_py()),
                    pa.array(lengths), pa.array([form(ids[e - n : e]) for e, n in zip(ends, lengths, strict=True)], last[1])],
                    names=["doc_id", "start", "n_tokens", last[0]])

    return read_segments(spark, path).select("doc_ids", "lengths", "codes", "start").mapInArrow(
        split, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if checksums else 'ids binary'}")


def tokens_at(places: DataFrame, path: str, column: str = "place", span: int = SEGMENT_TOKENS) -> DataFrame:
    """The token at each place of the whole stored sequence, by random access: ``places`` with ``token_id``.

    Places outside the stored sequence, and null ones, get null.  A column ``token_id`` is replaced.
    """
    spark = places.sparkSession
    segments = read_segments(spark, path)
    # a segment is listed under each stretch of ``span`` places it touches, so the look-up is an equality join
    stretch = lambda at: F.floor(at / span)
    listed = segments.withColumn("stretch", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("start") + F.col("n_tokens") - 1))))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                at = np.unique(np.array(batch.column("places")[i].as_py(), np.int64))
                ids = lookup(batch.column("codes")[i].as_py(), at - batch.column("start")[i].as_py())
                found.append((at, ids))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)),
                pa.array((np.concatenate([b for _, b in found]) if found else np.zeros(0, np.int64)).astype(np.int64))],
                names=["__place", "token_id"])

    wanted = places.select(F.col(column).cast("long").alias("at")).where(F.col("at") >= 0).distinct()
    inside = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("n_tokens"))
    asked = wanted.withColumn("stretch", stretch(F.col("at"))).join(
        listed.select("stretch", "shard", "segment", "start", "n_tokens"), "stretch").where(inside)
    by_segment = asked.groupBy("shard", "segment").agg(F.collect_list("at").alias("places"))
    tokens = by_segment.join(segments.select("shard", "segment", "start", "codes"), ["shard", "segment"]).select(
        "places", "start", "codes").mapInArrow(fetch, "__place long, token_id long")
    rows = places.drop("token_id")
    return rows.join(tokens, F.col(column).cast("long") == F.col("__place"), "left").drop("__place")
