"""Packing of token sequences of many lengths into few sequences of one fixed length.

The recorder that this library follows keeps no token sequences, so the operator is general.

Method: online best fit in bounded space.  At most ``open_bins`` bins are open; a bitset has a bit for
each amount of free space that some open bin has, so the tightest bin that fits is the lowest set bit
from a piece's length on.  When a new bin would be one too many, the fullest open one closes.

Pieces are dealt by hash to groups of about ``group_pieces``, each packed by itself; a group wastes less
than a bin or so.  Inside a group pieces arrive in windows of about ``window`` pieces, each from long to short,
which lets short ones fill what long ones leave.  With many more bins than a window opens the bound would
never act; with far fewer, bins close half full.  Only lengths and checksums are moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cliploom.llm.common import shared_table
from cliploom.llm.vocab import END_ID, encoder, public_file, text_slices

LENGTH = 4096
OPEN_BINS = 256
WINDOW = 1024
GROUP_PIECES = 16_384


class Packer:
    """Bins of one group; ``place`` gives (bin, offset)."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free = 0  # bit f: some open bin has f places left
        self.bins: dict[int, list[int]] = {}  # open bins by free space, newest last
        self.n_open = self.made = 0

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        bin_ = stack.pop()
        if not stack:
            del self.bins[space]
            self.free ^= 1 << space
        self.n_open -= 1
        return bin_

    def _put(self, bin_: int, space: int) -> None:
        if space:
            self.bins.setdefault(space, []).append(bin_)
            self.free |= 1 << space
            self.n_open += 1

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.n_open >= self.open_bins and length < self.size:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, bin_ = self.size, self.made
            self.made += 1
        self._put(bin_, space - length)
        return bin_, self.size - space


def token_pieces(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text",
                 size: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Every whole text as ids with ``end_id`` behind, in pieces of at most ``size`` ids.

    Returns ``doc_id, piece, start, length, ids_crc32``.  A null or empty text is the end id alone.
    """
    file = tokenizer or public_file("word_bpe_49k.json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(file), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            coded = (ids + end for part in text_slices(batch.column(1)) for ids in code.encode(part))
            for doc, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column)).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int = LENGTH, length_column: str = "length", open_bins: int = OPEN_BINS,
         group_pieces: int = GROUP_PIECES, window: int = WINDOW) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: their places in sequences of at most ``size``.

    A sequence is filled from 0 without gaps.  Lengths must be between 1 and ``size``; rows of another
    or no length belong to no sequence and get nulls.  Repeated rows are pieces of their own.  Columns
    named ``sequence_id`` or ``offset`` are replaced.

    ``pieces`` is written to the shared folder first, since its rows are counted before they are dealt.
    """
    kept = pieces.drop("sequence_id", "offset")
    # numbered where they are written, so that rows that are alike are dealt apart
    stored = shared_table(kept.withColumn("__at", F.monotonically_increasing_id()), "pieces")
    groups, windows = max(1, stored.count() // group_pieces), max(1, group_pieces // window)
    names = kept.columns
    schema = StructType(kept.schema.fields).add("sequence_id", "long").add("offset", "long")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, current = None, None
        for batch in batches:
            bins, offsets = [], []
            for group, length in zip(batch.column("__group").to_pylist(), batch.column(length_column).to_pylist(), strict=True):
                if group != current:
                    packer, current = Packer(size, open_bins), group
                if length is None or not 1 <= length <= size:
                    bins.append(None)
                    offsets.append(None)
                    continue
                bin_, offset = packer.place(int(length))
                bins.append(group << 32 | bin_)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())],
                names=[*names, "sequence_id", "offset"])

    slot = F.pmod(F.xxhash64("__at"), F.lit(groups * windows))
    dealt = stored.withColumn("__group", F.floor(slot / windows)).withColumn("__window", slot % windows)
    ordered = dealt.repartition("__group").sortWithinPartitions("__group", "__window", F.desc(length_column), "__at")
    return ordered.mapInArrow(fill, schema)
