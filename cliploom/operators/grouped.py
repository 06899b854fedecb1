"""Whole groups of rows as Arrow tables, many groups to a table.

Where groups are small, a Python call for each of them costs more than its work; a call here gets all groups that
end in a record batch, so it may do them together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: ``fn(rows, ends)``: rows of several whole groups and their borders, the first one 0, to a record batch.
Work = Callable[[pa.Table, np.ndarray], pa.RecordBatch]


def _changes(rows: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Places where a row's key differs from that of the row before; nulls are a key like others."""
    change = np.zeros(max(0, rows.num_rows - 1), bool)
    for k in keys:
        column = rows.column(k)
        null = column.is_null().to_numpy(zero_copy_only=False)
        value = column.fill_null(0).to_numpy(zero_copy_only=False)
        change |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(change) + 1


def map_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Work, schema: str) -> DataFrame:
    """``fn`` over all groups of equal (integer) ``keys``, rows of a group sorted by ``order``.

    A task holds one record batch and the group that is not yet at its end.
    """
    keys = list(keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return fn(table, np.concatenate([[0], _changes(table.to_batches()[0], keys), [table.num_rows]]).astype(np.int64))

        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = _changes(batch, keys)
            last = int(cuts[-1]) if len(cuts) else 0
            if held:
                ends = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]).combine_chunks()
                if not last and not len(_changes(ends.to_batches()[0], keys)):
                    held.append(batch)
                    continue
                if last:
                    held.append(batch.slice(0, last))
                yield done()
            elif last:
                held = [batch.slice(0, last)]
                yield done()
            held = [batch.slice(last)]
        if held:
            yield done()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(scan, schema)


def lists(flat: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists; NaN is null, as it is in lists that come from pandas."""
    ends = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(flat).ravel(), pa.float64(), from_pandas=True))
