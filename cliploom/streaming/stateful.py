"""Keyed stateful processors over packet and frame streams.

State is kept per key by Structured Streaming; a micro-batch brings a bounded number of files, so
the rows of one key in one batch are bounded too, and they are folded with array operations.  Order
inside a key is the explicit ``arrival`` column: rows are sorted by it within a batch, and a batch that
goes back behind an earlier one is rejected, since its rows would be folded in the wrong order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cliploom.operators.container import CLUSTER_SPAN_NS, openings

Fold = Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]]
NEVER = -(2**63)


def fold_by_key(stream: DataFrame, key: str, start: tuple, fold: Fold, out_schema: str, state_schema: str) -> DataFrame:
    """``fold(state, rows)`` per key and batch, rows in arrival order; returns the new state and output rows."""

    def run(ident: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        if rows.empty:
            return
        newest, *current = state.get if state.exists else (NEVER, *start)
        rows = rows.sort_values("arrival", kind="stable")
        if rows["arrival"].iloc[0] <= newest:
            raise ValueError(f"{key} {ident[0]} goes back from arrival {newest} to {rows['arrival'].iloc[0]}: feed files in arrival order")
        after, out = fold(tuple(current), rows)
        state.update((int(rows["arrival"].iloc[-1]), *after))
        out.insert(0, key, ident[0])
        yield out

    return stream.groupBy(key).applyInPandasWithState(
        run, f"{key} long, {out_schema}", f"newest_arrival long, {state_schema}", "append", GroupStateTimeout.NoTimeout)


def drop_before_open(packets: DataFrame) -> DataFrame:
    """Packets from each clip's first ``is_config`` row on: clip_id, arrival, ts_ns; the container is not open before it."""

    def fold(state, rows):
        (is_open,) = state
        if not is_open:
            config = np.flatnonzero(rows["is_config"].to_numpy(bool))
            rows = rows.iloc[config[0]:] if len(config) else rows.iloc[:0]
        return (bool(is_open or len(rows)),), rows[["arrival", "ts_ns"]].reset_index(drop=True)

    return fold_by_key(packets, "clip_id", (False,), fold, "arrival long, ts_ns long", "is_open boolean")


def cluster(packets: DataFrame, span_ns: int = CLUSTER_SPAN_NS, needs_open: bool = False) -> DataFrame:
    """Relative time (late packets clamp to zero, none is dropped) and cluster of each packet.

    With ``needs_open``, packets before the clip's first ``is_config`` row are dropped: the container is not open yet.
    """

    def fold(state, rows):
        first, base, number, is_open = state
        if not is_open:
            config = np.flatnonzero(rows["is_config"].to_numpy(bool))
            rows = rows.iloc[config[0]:] if len(config) else rows.iloc[:0]
            is_open = bool(len(config))
        ts = rows["ts_ns"].to_numpy()
        fresh = number < 0
        if fresh and len(ts):
            first = int(ts[0])
        rel = np.maximum(ts - first, 0)
        hard = ~rows["is_audio"].to_numpy(bool) & rows["is_key"].to_numpy(bool)
        opens = openings(rel, hard, None if fresh else base, span_ns)
        place = np.searchsorted(opens, np.arange(len(rel)), side="right")
        bases = np.concatenate([[base], rel[opens]]).astype(np.int64)
        out = pd.DataFrame({"arrival": rows["arrival"].to_numpy(), "rel_ns": rel, "base_ns": bases[place], "cluster": number + place})
        return (first, int(bases[-1]), number + len(opens), is_open), out

    return fold_by_key(packets, "clip_id", (0, 0, -1, not needs_open), fold,
                       "arrival long, rel_ns long, base_ns long, cluster long",
                       "first long, base long, number long, is_open boolean")


def complete_bursts(frames: DataFrame) -> DataFrame:
    """A row when a burst reaches its expected count; another base drops a partial burst."""

    def fold(state, rows):
        base, need, have, began = state
        rows = rows[rows["expected"] >= 2]
        path, at = rows["base"].to_numpy(object), rows["arrival"].to_numpy()
        out = []
        # runs of one base; the first run may go on from the batch before
        starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])) if len(path) else np.zeros(0, int)
        for lo, hi in zip(starts, [*starts[1:], len(path)], strict=True):
            if path[lo] != base:
                base, need, have, began = path[lo], int(rows["expected"].iloc[lo]), 0, 0
            first = lo - have  # where the open burst would begin, counted in rows of this batch
            n = (hi - first) // need
            for k in range(n):
                a, b = first + k * need, first + (k + 1) * need - 1
                out.append((base, int(at[a]) if a >= lo else began, int(at[b]), need))
            have = hi - first - n * need
            if have and first + n * need >= lo:
                began = int(at[hi - have])
        return (base, need, have, began), pd.DataFrame(out, columns=["base", "first_arrival", "last_arrival", "n"])

    return fold_by_key(frames, "session_id", ("", 0, 0, 0), fold,
                       "base string, first_arrival long, last_arrival long, n long",
                       "base string, need long, have long, began long")


def count_windows(frames: DataFrame, size: int) -> DataFrame:
    """A row per ``size`` frames of a clip: window number, first and last stamp, largest gap and gpu time."""

    def fold(state, rows):
        seen, previous, began, gap, gpu = state
        ts, work = rows["ts_ns"].to_numpy(), rows["gpu_ns"].to_numpy()
        gaps = np.diff(np.concatenate([[previous if seen else ts[0]], ts]))
        window = (seen + np.arange(len(ts))) // size
        parts = pd.DataFrame({"window": window, "first_ts": ts, "last_ts": ts, "gap": gaps, "gpu": work})
        if seen % size:  # what earlier batches have of the open window
            parts = pd.concat([pd.DataFrame([(seen // size, began, began, gap, gpu)], columns=parts.columns), parts])
        done = parts.groupby("window").agg(first_ts=("first_ts", "first"), last_ts=("last_ts", "last"), max_gap_ns=("gap", "max"),
                                           gpu_max_ns=("gpu", "max")).reset_index()
        seen += len(ts)
        full, open_ = done[done["window"] < seen // size], done[done["window"] >= seen // size]
        last = tuple(map(int, open_[["first_ts", "max_gap_ns", "gpu_max_ns"]].iloc[0])) if len(open_) else (0, 0, 0)
        return (seen, int(ts[-1]), *last), full

    return fold_by_key(frames, "clip_id", (0, 0, 0, 0, 0), fold,
                       "window long, first_ts long, last_ts long, max_gap_ns long, gpu_max_ns long",
                       "seen long, previous long, began long, gap long, gpu long")


def telemetry_windows(frames: DataFrame, size: int) -> DataFrame:
    """Statistics of every full window of ``size`` encoded frames as soon as it is full, as the batch form gives them.

    ``frames``: clip_id, arrival, ts_ns, dropped, gpu_ns, wait_ns, copy_ns.
    """
    parts = ("gpu", "wait", "copy")
    sums, tops = [f"{p}_sum" for p in parts], [f"{p}_max_ns" for p in parts]
    open_names = ["frames", "wall", *sums, *tops, "gap_max_ns", "drops"]

    def fold(state, rows):
        done, previous, previous_done, *open_ = state
        ts, encoded = rows["ts_ns"].to_numpy(), ~rows["dropped"].to_numpy(bool)
        before = done + np.cumsum(encoded) - encoded
        gap = np.diff(np.concatenate([[ts[0] if previous == NEVER else previous], ts]))
        gap[: previous == NEVER] = -1  # no frame before the first
        done_ts = ts[encoded]
        wall = np.zeros(len(ts), np.int64)
        wall[encoded] = np.diff(np.concatenate([done_ts[:1] if previous_done == NEVER else [previous_done], done_ts]))
        table = {"window": before // size, "frames": encoded.astype(np.int64), "wall": wall, "gap_max_ns": gap, "drops": (~encoded).astype(np.int64)}
        for p in parts:
            work = rows[f"{p}_ns"].to_numpy()
            table |= {f"{p}_sum": np.where(encoded, work, 0), f"{p}_max_ns": np.where(encoded, work, NEVER)}
        frame = pd.DataFrame(table)[["window", *open_names]]
        if open_[0] or open_[-1]:
            frame = pd.concat([pd.DataFrame([(done // size, *open_)], columns=frame.columns), frame])
        agg = {c: "sum" for c in ("frames", "wall", *sums, "drops")} | {c: "max" for c in (*tops, "gap_max_ns")}
        merged = frame.groupby("window").agg(agg).reset_index()
        done += int(encoded.sum())
        full, rest = merged[merged["window"] < done // size], merged[merged["window"] >= done // size]
        kept = [int(v) for v in rest[open_names].iloc[0]] if len(rest) else [0, 0, 0, 0, 0, NEVER, NEVER, NEVER, -1, 0]
        out = pd.DataFrame({
            "window": full["window"], "frames": full["frames"],
            "fps": np.where(full["wall"] > 0, 1e9 * full["frames"] / np.maximum(full["wall"], 1), 0.0),
            **{f"{p}_mean_ns": full[f"{p}_sum"] / full["frames"] for p in parts}, **{c: full[c] for c in tops},
            "gap_max_ns": full["gap_max_ns"].astype("Int64").mask(full["gap_max_ns"] < 0), "drops": full["drops"]})
        last_done = int(done_ts[-1]) if len(done_ts) else previous_done
        return (done, int(ts[-1]), last_done, *kept), out

    return fold_by_key(
        frames, "clip_id", (0, NEVER, NEVER, 0, 0, 0, 0, 0, NEVER, NEVER, NEVER, -1, 0), fold,
        "window long, frames long, fps double, gpu_mean_ns double, wait_mean_ns double, copy_mean_ns double, "
        "gpu_max_ns long, wait_max_ns long, copy_max_ns long, gap_max_ns long, drops long",
        "done long, previous long, previous_done long, " + ", ".join(f"{c} long" for c in open_names))
