"""Removal of lines that many documents share.

The recorder that this library follows keeps no text, so the operator is general: it works on any
table with an integer id column and a text column.

Method: hashes of long line keys are range-partitioned together with the document, sorted by
(hash, document descending, position) and streamed once.  The first document of a hash is the one
that keeps the line; every later document of a hash loses it once the hash has been met in enough
documents.  A hash that lies in a third of all documents spans many ranges: rows of the hashes at a
range's edges wait for the totals of those hashes, of which there are two per range at most.  What
comes out are positions, packed to one compressed keep bitmap per document; text is not moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import LOWER, UPPER, join_null_safe, shared_table, text_key

BLANK = " \t\n\x0b\f\r"
DROP, WAIT, TOTAL = 0, 1, 2
MARKS = "kind int, h1 long, h2 long, doc_id long, text_key long, pos int, n_lines int, n_docs long"


def line_key(line: Column) -> Column:
    """A line without white space (x20, x09-x0D) at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def long_lines(docs: DataFrame, id_column: str, text_column: str, min_chars: int) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    split = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.split(text, "\n", -1).alias("lines"))
    lines = split.select("doc_id", "text_key", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    # two hashes with different seeds: 128 bits, so different lines do not meet even among 10^12 lines
    keys = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keys.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc_id", "text_key", "pos", "n_lines")


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order of (hash, document descending, position) to marks."""
    schema = pa.schema([
        ("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()),
        ("pos", pa.int32()), ("n_lines", pa.int32()), ("n_docs", pa.int64())])

    def marks(kind, rows, pick, n_docs=None):
        size = int(pick.sum())
        return pa.record_batch([
            pa.array(np.full(size, kind, np.int32)), pa.array(rows["h1"][pick]), pa.array(rows["h2"][pick]),
            pa.array(rows["doc"][pick], mask=rows["void"][pick]), pa.array(rows["text_key"][pick]), pa.array(rows["pos"][pick]),
            pa.array(rows["n_lines"][pick]), pa.array(np.full(size, n_docs or 0, np.int64))], schema=schema)

    held: dict | None = None  # rows of the current hash that are not settled yet: those of its first few documents
    last: dict | None = None  # the newest row
    leader: dict | None = None  # the first row of the range's first hash
    top: dict | None = None  # the first row of the current hash, that of its largest document
    leading, seen = True, 0  # whether the range's first hash still runs; documents of the current hash so far
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column("doc_id")
        rows = {
            "h1": batch.column("h1").to_numpy(), "h2": batch.column("h2").to_numpy(),
            "void": np.asarray(doc.is_null()), "doc": doc.fill_null(0).to_numpy(zero_copy_only=False),
            "text_key": batch.column("text_key").to_numpy(), "pos": batch.column("pos").to_numpy(),
            "n_lines": batch.column("n_lines").to_numpy()}
        before = {k: np.concatenate([last[k] if last else v[:1], v[:-1]]) for k, v in rows.items()}
        start = (rows["h1"] != before["h1"]) | (rows["h2"] != before["h2"])
        other = start | (rows["doc"] != before["doc"]) | (rows["void"] != before["void"])
        if last is None:
            other[0] = True
            leader = top = {k: v[:1] for k, v in rows.items()}
        if start.any():
            begin = int(np.flatnonzero(start)[-1])
            top = {k: v[begin : begin + 1] for k, v in rows.items()}
        last = {k: v[-1:] for k, v in rows.items()}
        run = np.cumsum(start)
        n_runs = int(run[-1]) + 1
        count = np.cumsum(other)
        base = np.concatenate([[0], count[np.flatnonzero(start)] - 1]) - np.concatenate([[seen], np.zeros(n_runs - 1, int)])
        order = count - base[run]  # 1 for the rows of a hash's first document, 2 for the next, ...
        fresh = other | (rows["text_key"] != before["text_key"]) | (rows["pos"] != before["pos"])
        if not fresh.all():  # repeated rows of a document say nothing new
            rows, order, run = {k: v[fresh] for k, v in rows.items()}, order[fresh], run[fresh]
        if held is not None:
            earlier = held.pop("order")
            rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
            order, run = np.concatenate([earlier, order]), np.concatenate([np.zeros(len(earlier), run.dtype), run])
            held = None
        total = np.zeros(n_runs, np.int64)
        total[0] = seen
        np.maximum.at(total, run, order)
        seen = int(total[-1])
        settled = np.ones(len(run), bool)
        if leading:
            first = run == 0
            if first.any():
                yield marks(WAIT, rows, first)
            settled &= ~first
            leading = n_runs == 1
            if not leading:
                yield marks(TOTAL, leader, np.ones(1, bool), int(total[0]))
        if not leading:
            drop = settled & (total[run] >= min_docs) & (order > 1)
            if drop.any():
                yield marks(DROP, rows, drop)
            if seen < min_docs:
                tail = run == n_runs - 1
                held = {k: v[tail] for k, v in rows.items()} | {"order": order[tail]}
            else:
                held = None
    if last is None:
        return
    if leading:
        yield marks(TOTAL, leader, np.ones(1, bool), seen)
        return
    if held is not None:
        held.pop("order")
        yield marks(WAIT, held, np.ones(len(held["h1"]), bool))
    yield marks(TOTAL, top, np.ones(1, bool), seen)


def shared_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 40,
                 min_docs: int = 5) -> DataFrame:
    """(doc_id, text_key, pos, n_lines) of every line that ``keep_bitmaps`` leaves out."""
    rows = long_lines(docs, id_column, text_column, min_chars)
    newest = F.desc_nulls_last("doc_id")
    ranged = rows.repartitionByRange("h1", "h2", newest).sortWithinPartitions("h1", "h2", newest, "text_key", "pos")
    marks = shared_table(ranged.mapInArrow(lambda b: _stream(b, min_docs), MARKS), "line-marks")
    columns = ["doc_id", "text_key", "pos", "n_lines"]
    totals = (
        marks.where(F.col("kind") == TOTAL).groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("total"), F.max("doc_id").alias("newest"))
        .where(F.col("total") >= min_docs))
    # two hashes per range at most: a bound by the number of tasks, not by the data
    waiting = marks.where(F.col("kind") == WAIT).join(F.broadcast(totals), ["h1", "h2"])
    lost = waiting.where(~F.col("doc_id").eqNullSafe(F.col("newest"))).select(columns)
    return marks.where(F.col("kind") == DROP).select(columns).unionByName(lost)


def keep_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = 40,
                 min_docs: int = 5) -> DataFrame:
    """One compressed keep bitmap for each document that loses lines.

    A line's key (``line_key``) of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses all its lines but those of the largest id.  Returns
    ``doc_id, text_key, n_lines, n_dropped, keep`` where ``keep`` is a zlib-compressed bitmap, one
    bit per line from the highest bit of the first byte on, 1 for lines that stay.  Documents
    without a row keep every line.

    Null or empty text is one empty line.  Rows that repeat an id count as one document; rows of
    one id with different texts have bitmaps of their own (``text_key``).  A null id counts as one
    document below all others.  Other columns are not read.
    """

    @F.pandas_udf("binary")
    def pack(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
        out = []
        for n, gone in zip(n_lines, dropped, strict=True):
            bits = np.ones(n, np.uint8)
            bits[gone] = 0
            out.append(zlib.compress(np.packbits(bits).tobytes()))
        return pd.Series(out)

    lost = shared_lines(docs, id_column, text_column, min_chars, min_docs)
    by_doc = lost.groupBy("doc_id", "text_key", "n_lines").agg(F.collect_set("pos").alias("gone"))
    return by_doc.select(
        "doc_id", "text_key", "n_lines", F.size("gone").cast("long").alias("n_dropped"), pack("n_lines", "gone").alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the lines that stay; adds ``n_lines`` and ``n_dropped``.

    A null text stays null.  Columns named ``n_lines`` or ``n_dropped`` are replaced.
    """

    @F.pandas_udf("string")
    def kept(text: pd.Series, keep: pd.Series) -> pd.Series:
        out = []
        for whole, bitmap in zip(text, keep, strict=True):
            if bitmap is None:
                out.append(whole)
                continue
            lines = (whole or "").split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
            out.append("\n".join(line for line, bit in zip(lines, bits, strict=True) if bit))
        return pd.Series(out, dtype=object)

    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    left = docs.select(
        F.struct(*[F.col(c) for c in names]).alias("__row"), F.col(id_column).cast("long").alias("doc_id"),
        text_key(text_column).alias("text_key"))
    joined = join_null_safe(left, bitmaps.select("doc_id", "text_key", "n_lines", "n_dropped", "keep"), ["doc_id", "text_key"], "left")
    text = F.col("__row")[text_column]
    return joined.select(
        *[(F.when(F.col("keep").isNull(), text).otherwise(kept(text, F.col("keep"))) if c == text_column else F.col("__row")[c]).alias(c)
          for c in names],
        F.coalesce("n_lines", F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))
