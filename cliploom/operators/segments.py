"""Ordered scans over a clip without putting a clip into one task.

``Window.partitionBy(clip).orderBy(arrival)`` sorts a whole clip in a single task, which
fails once one clip holds a large share of the rows.  The scans here cut every clip into
segments of the (integer) order key, aggregate each segment map-side, scan the few
segment rows (recursively, ``levels`` times), and finish with a window inside one segment.
With an order key that is unique per clip a segment holds at most ``2**bits`` rows, so
every window partition is bounded; only the join on (clip, segment) and the inner window
move the rows, and both use the same partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEGMENT_BITS = 16
# One level leaves one small row per 2**16 order values for the final per-clip window, whatever the input.
LEVELS = 1


@dataclass(frozen=True)
class Scan:
    """One running value.

    kind: ``sum`` | ``max`` | ``last`` (newest non-null so far) | ``first`` (oldest non-null
    so far) | ``next`` (nearest non-null ahead) | ``position`` (0-based row number).
    ``strict`` leaves the current row out.
    """

    kind: str
    value: Column | None = None
    strict: bool = False


def _summary(scan: Scan, at: Column, fields: list[str] | None) -> Column:
    v = scan.value
    if scan.kind == "position":
        return F.count(F.lit(1))
    if scan.kind == "sum":
        return F.sum(v)
    if scan.kind == "max":
        return F.max(v)
    present = F.when(v.isNotNull(), at)
    pick = F.max_by if scan.kind == "last" else F.min_by
    if fields is None:
        return pick(v, present)
    # field by field: buffers of plain numbers keep this a hash aggregation, a struct would be sorted first
    return F.when(F.count(v) > 0, F.struct(*[pick(v[f], present).alias(f) for f in fields]))


def _fields(df: DataFrame, scan: Scan) -> list[str] | None:
    if scan.kind not in ("last", "first", "next"):
        return None
    kind = df.select(scan.value.alias("v")).schema["v"].dataType
    return kind.fieldNames() if isinstance(kind, StructType) else None


def _carried(scan: Scan, value: Column) -> Scan:
    """The scan that runs over segment summaries to give the value coming into a segment."""
    return Scan("sum" if scan.kind == "position" else scan.kind, value, strict=True)


def _windowed(scan: Scan, keys: Sequence[str], order: Sequence[Column]) -> Column:
    by = W.partitionBy(*keys).orderBy(*order)
    end = -1 if scan.strict else 0
    back = by.rowsBetween(W.unboundedPreceding, end)
    if scan.kind == "position":
        return F.row_number().over(by).cast("long") - 1
    if scan.kind == "sum":
        return F.sum(scan.value).over(back)
    if scan.kind == "max":
        return F.max(scan.value).over(back)
    if scan.kind == "last":
        return F.last(scan.value, ignorenulls=True).over(back)
    if scan.kind == "first":
        return F.first(scan.value, ignorenulls=True).over(back)
    if scan.kind == "next":
        # looked at from the far end: a frame that is open ahead would be read again for every row
        turned = W.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
        return F.last(scan.value, ignorenulls=True).over(turned.rowsBetween(W.unboundedPreceding, end))
    raise ValueError(scan.kind)


def _merged(scan: Scan, carry: Column, local: Column) -> Column:
    if scan.kind in ("sum", "position"):
        return F.coalesce(carry + local, carry, local)
    if scan.kind == "max":
        return F.greatest(carry, local)
    if scan.kind == "first":
        return F.coalesce(carry, local)
    return F.coalesce(local, carry)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: dict[str, Scan],
    bits: int = SEGMENT_BITS,
    levels: int = LEVELS,
) -> DataFrame:
    """Add the columns named in ``scans``, each a running value per ``keys`` in ``order``.

    ``order[0]`` must be a non-null integer; the whole of ``order`` must be unique per key.
    ``levels=0`` is a plain window, for inputs whose clips are known to be small.  A null key is a
    key of its own.
    """
    order_cols = [F.col(c) for c in order]
    if levels == 0:
        return df.select("*", *[_windowed(s, keys, order_cols).alias(n) for n, s in scans.items()])

    seg = f"__segment{levels}"
    at = order_cols[0] if len(order) == 1 else F.struct(*order_cols)
    # one struct holds key and segment: null keys match in the join, and join and windows share a shuffle
    group = f"__group{levels}"
    rows = df.withColumn(seg, F.shiftright(order_cols[0].cast("long"), bits)).withColumn(group, F.struct(*keys, seg))
    temp = {n: f"__in_{levels}_{n}" for n in scans}
    summaries = rows.groupBy(group).agg(
        *[_summary(s, at, _fields(df, s)).alias(temp[n]) for n, s in scans.items()]
    ).select(*[F.col(group)[c].alias(c) for c in [*keys, seg]], *temp.values())
    carried = {f"__carry_{levels}_{n}": _carried(s, F.col(temp[n])) for n, s in scans.items()}
    carries = scan(summaries, keys, [seg], carried, bits, levels - 1).select(F.struct(*keys, seg).alias(group), *carried)
    joined = rows.join(carries, group, "left")
    local = {n: f"__local_{levels}_{n}" for n in scans}
    inner = joined.select(
        "*", *[_windowed(s, [group], order_cols).alias(local[n]) for n, s in scans.items()]
    )
    out = [
        _merged(s, F.coalesce(F.col(f"__carry_{levels}_{n}"), F.lit(0)) if s.kind == "position"
                else F.col(f"__carry_{levels}_{n}"), F.col(local[n])).alias(n)
        for n, s in scans.items()
    ]
    return inner.select(*[F.col(c) for c in df.columns], *out)


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n", **kw) -> DataFrame:
    """0-based rank of each row within its key."""
    return scan(df, keys, order, {name: Scan("position")}, **kw)


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, Column], **kw
) -> DataFrame:
    """``lag(1)`` of several expressions; a null value stays a null, it is not skipped."""
    boxed = F.struct(*[c.alias(n) for n, c in columns.items()])
    got = scan(df, keys, order, {"__previous": Scan("last", boxed, strict=True)}, **kw)
    return got.select(*df.columns, *[F.col("__previous")[n].alias(n) for n in columns])


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: Column | None = None, salts: int = 1, few: bool = True) -> DataFrame:
    """Left-join one row per key onto many; a null key is a key like others.

    The per-key side is not copied: where it is small it is broadcast, and else adaptive execution cuts the partition of
    a hot key.  Planning goes by the size of files, so where keys are as many as a table's rows, ``few=False`` rules a
    broadcast out.  For sessions that cut no skewed joins, ``salts`` spreads every key by ``spread`` over so many partitions.
    """
    salt = [] if salts == 1 else [F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int").alias("salt")]
    copies = per_key.withColumn("__at", F.struct(*keys)) if salts == 1 else per_key.withColumn(
        "__at", F.explode(F.array(*[F.struct(*keys, F.lit(i).alias("salt")) for i in range(salts)])))
    one = copies.drop(*keys)
    return df.withColumn("__at", F.struct(*keys, *salt)).join(one if few else one.hint("merge"), "__at", "left").drop("__at")
