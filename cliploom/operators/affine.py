"""Linear recurrences ``m = a*m + b`` over long sequences, without walking a sequence in one task.

A run of steps is again one affine step, so a sequence is cut into bounded chunks, each chunk is
folded to one (a, b), the chunk steps are scanned (recursively), and each chunk is replayed from its
true start, chunk by chunk in numpy.  ``b`` and ``m`` are arrays: one recurrence per element, all with the same ``a``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

VALUES = ArrayType(DoubleType())
STEP = StructType().add("a", DoubleType()).add("b", VALUES)
CHUNK_BITS = 8
BLOCK_CELLS = 1 << 21  # values of the lists that go step by step together
LEVELS = 2  # with the chunks themselves: one step per 2**24 rows is left for each key's last list


def _blocks(steps: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sizes, a, b) of some lists of steps at a time: factors (lists, steps) and summands (lists, steps, values).

    Shorter lists are filled up with steps that change nothing, so that all lists of a block go step by step together.
    """
    values = steps.flatten()
    a, b = values.field("a").to_numpy(zero_copy_only=False), values.field("b")
    flat = b.flatten().to_numpy(zero_copy_only=False)
    sizes = steps.value_lengths().to_numpy().astype(np.int64)
    width = len(flat) // max(1, len(a))
    first = np.cumsum(sizes) - sizes
    at = 0
    while at < len(sizes):
        stop, longest = at, 0
        while stop < len(sizes) and (stop == at or (stop + 1 - at) * max(longest, sizes[stop]) * max(1, width) <= BLOCK_CELLS):
            longest = max(longest, int(sizes[stop]))
            stop += 1
        own = sizes[at:stop]
        row = np.repeat(np.arange(len(own)), own)
        place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        factors, summands = np.ones((len(own), longest)), np.zeros((len(own), longest, width))
        span = slice(int(first[at]), int(first[at] + own.sum()))
        factors[row, place] = a[span]
        summands[row, place] = flat[span.start * width : span.stop * width].reshape(-1, width)
        yield own, factors, summands
        at = stop


def _lists(rows: list[np.ndarray]) -> pa.Array:
    sizes = [len(r) for r in rows]
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.float64()))


@F.arrow_udf(STEP)
def _fold(steps: pa.Array) -> pa.Array:
    """All steps of a list as one."""
    factors, sums = [], []
    for _, a, b in _blocks(steps):
        m = np.zeros((len(a), b.shape[2]))
        for j in range(a.shape[1]):
            m = a[:, j, None] * m + b[:, j]
        factors += np.prod(a, axis=1).tolist()
        sums += list(m)
    return pa.StructArray.from_arrays([pa.array(factors, pa.float64()), _lists(sums)], names=["a", "b"])


@F.arrow_udf(ArrayType(VALUES))
def _walk(m0: pa.Array, steps: pa.Array) -> pa.Array:
    """The value going into each step of a list, and behind them the one after the last."""
    parts, counts, done = [], [], 0
    for sizes, a, b in _blocks(steps):
        n, longest, width = b.shape
        starts = m0.slice(done, n)
        m = np.empty((n, longest + 1, width))
        m[:, 0] = starts.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        for j in range(longest):
            m[:, j + 1] = a[:, j, None] * m[:, j] + b[:, j]
        parts.append(_rows(m[np.arange(longest + 1)[None, :] <= sizes[:, None]]))
        counts.append(sizes + 1)
        done += n
    ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, int)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts) if parts else _lists([]))


def _rows(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(m).ravel(), pa.float64()))


def _listed(steps: DataFrame, by: list[str], index: str, payload: Column | None = None) -> DataFrame:
    """The steps of every group in order; folding and replaying share this one shuffle."""
    step = F.struct(F.col(index).alias("i"), "a", "b", (F.lit(0) if payload is None else payload).alias("p"))
    return steps.groupBy(*by).agg(F.sort_array(F.collect_list(step)).alias("steps"))


def _folded(listed: DataFrame, by: list[str]) -> DataFrame:
    """One (a, b) per group of steps."""
    return listed.select(*by, _fold("steps").alias("f")).select(*by, "f.a", "f.b")


def _replayed(listed: DataFrame, keys: list[str], index: str, before: bool, carry: Sequence[str] = ()) -> DataFrame:
    """Value at every step of a group entered with ``m0`` (``before``: the value going into the step)."""
    values = F.slice(_walk("m0", "steps"), 1 if before else 2, F.size("steps"))
    # zipped before they are exploded, so that a row carries its own value only
    rows = listed.select(*keys, F.explode(F.arrays_zip(F.col("steps").alias("s"), values.alias("m"))).alias("z"))
    return rows.select(*keys, F.col("z.s.i").alias(index), F.col("z.m").alias("m"), *[F.col(f"z.s.p.{c}") for c in carry])


def _entries(folded: DataFrame, keys: list[str], starts: DataFrame | Column, bits: int, levels: int) -> DataFrame:
    """Value going into every group ``g``: keys, g, m."""
    if levels == 0:
        top = _listed(folded, keys, "g")
        entered = top.withColumn("m0", starts) if isinstance(starts, Column) else top.join(starts, keys)
        return _replayed(entered, keys, "g", before=True)
    listed = _listed(folded.withColumn("up", F.shiftright("g", bits)), [*keys, "up"], "g")
    above = _folded(listed, [*keys, "up"]).withColumnRenamed("up", "g")
    entries = _entries(above, keys, starts, bits, levels - 1)
    entered = listed.join(entries.select(*keys, F.col("g").alias("up"), F.col("m").alias("m0")), [*keys, "up"])
    return _replayed(entered, keys, "g", before=True)


def affine_scan(
    rows: DataFrame, keys: Sequence[str], index: str, a: Column, b: Column, starts: DataFrame | Column,
    carry: Sequence[str] = (), bits: int = CHUNK_BITS, levels: int = LEVELS,
) -> DataFrame:
    """``keys, index, m`` and the ``carry`` columns: the recurrence after each row.

    ``index`` is a unique integer per key; ``starts`` is the first value (an array) as a constant, or
    a table with ``m0`` per key.
    """
    # keys travel as one struct, so that a null key is a key of its own in every join
    key = F.struct(*keys).alias("key")
    steps = rows.select(
        key, F.col(index).cast("long").alias(index), a.cast("double").alias("a"), b.alias("b"),
        (F.struct(*carry) if carry else F.lit(0)).alias("p"),
        F.shiftright(F.col(index).cast("long"), bits).alias("g"))
    by = ["key", "g"]
    listed = _listed(steps, by, index, F.col("p"))
    first = starts if isinstance(starts, Column) else starts.select(key, "m0")
    entries = _entries(_folded(listed, by), ["key"], first, bits, levels)
    out = _replayed(listed.join(entries.withColumnRenamed("m", "m0"), by), ["key"], index, before=False, carry=carry)
    return out.select("key.*", index, "m", *carry)
