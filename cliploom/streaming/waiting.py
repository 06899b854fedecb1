"""Stream processors whose rows wait for others: state that is appended to, and read when it is released.

What waits lives in list and map state with an entry for each batch or timestamp, so a batch writes what it brings
and no more, however much waits.  The processors need Spark's RocksDB state store (``ingest.large_state``).
Rows of a key are folded in the order of ``arrival``; a batch that goes back behind an earlier one is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NEVER = -(2**63)


def in_order(name: str, key: tuple, batches: Iterator[pd.DataFrame], newest: int) -> pd.DataFrame:
    """All rows that a batch has for a key, by ``arrival``."""
    rows = pd.concat(list(batches), ignore_index=True).sort_values("arrival", kind="stable").reset_index(drop=True)
    if len(rows) and rows["arrival"].iloc[0] <= newest:
        raise ValueError(f"{name} {key[0]} goes back from arrival {newest} to {rows['arrival'].iloc[0]}: feed files in arrival order")
    return rows


def _process(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(processor, f"{key} long, {schema}", "append", "none")


class PairShots(StatefulProcessor):
    """Halves of the open shot of a session, by timestamp."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shot = handle.getValueState("shot", "newest long, shot long, wanted long, images long")
        self.halves = handle.getMapState("halves", "ts_ns long", "images array<long>, results array<long>")

    def _known(self, shot: int, stamps: np.ndarray | None) -> tuple[list[tuple], list[tuple]]:
        """(shot, ts_ns, arrival) of waiting images and results: of some stamps, or of all of them."""
        if stamps is None:
            found = [(ts, value) for (ts,), value in self.halves.iterator()]
        else:
            found = [(int(ts), self.halves.getValue((int(ts),))) for ts in stamps if self.halves.containsKey((int(ts),))]
        return tuple([(shot, ts, int(at)) for ts, value in found for at in value[side]] for side in (0, 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, shot, wanted, images = self.shot.get() if self.shot.exists() else (NEVER, 0, 0, 0)
        batch = in_order("session", key, rows, newest)
        if batch.empty:
            return
        arm = (batch["kind"] == "arm").to_numpy()
        number = shot + np.cumsum(arm)
        limits = {shot: wanted, **dict(zip(number[arm].tolist(), batch["wanted"].to_numpy()[arm].tolist(), strict=True))}
        halves = pd.DataFrame({"shot": number, "ts_ns": batch["ts_ns"], "arrival": batch["arrival"], "kind": batch["kind"]})[~arm & (number > 0)]
        new = {"image": halves[halves["kind"] == "image"], "result": halves[halves["kind"] == "result"]}
        taken = new["image"].groupby("shot").cumcount() + np.where(new["image"]["shot"] == shot, images, 0)
        counted = new["image"][taken.to_numpy() < new["image"]["shot"].map(limits).to_numpy(float)]
        here = np.unique(halves.loc[halves["shot"] == shot, "ts_ns"].to_numpy()) if len(halves) else np.zeros(0, np.int64)
        before = self._known(shot, None if arm.any() else here) if shot else ([], [])
        columns = ["shot", "ts_ns", "arrival"]
        sides = []
        for old, fresh in zip(before, (counted, new["result"]), strict=True):
            sides.append(pd.concat([pd.DataFrame(old, columns=columns, dtype="int64").assign(old=True),
                                    fresh[columns].astype("int64").assign(old=False)], ignore_index=True))
        image, result = sides
        both = image.merge(result, on=["shot", "ts_ns"], how="outer", suffixes=("_i", "_r"), indicator=True)
        paired = both[(both["_merge"] == "both") & ~((both["old_i"] == True) & (both["old_r"] == True))]  # noqa: E712 - may be missing
        last = int(number[-1])
        strays = both[(both["_merge"] != "both") & (both["shot"] < last)]
        out = pd.concat([paired, strays])
        self._keep(last, arm.any(), image, result)
        self.shot.update((int(batch["arrival"].iloc[-1]), last, int(limits[last]),
                          int((new["image"]["shot"] == last).sum()) + (images if last == shot else 0)))
        yield pd.DataFrame({
            "session_id": key[0], "shot": out["shot"], "ts_ns": out["ts_ns"],
            "image_arrival": out["arrival_i"].astype("Int64"), "result_arrival": out["arrival_r"].astype("Int64")})

    def _keep(self, shot: int, cleared: bool, image: pd.DataFrame, result: pd.DataFrame) -> None:
        """Arming clears what waited; then the halves of the open shot are put to their timestamps."""
        if cleared:
            self.halves.clear()
        kept = [side[side["shot"] == shot].groupby("ts_ns")["arrival"].apply(list).to_dict() if shot else {} for side in (image, result)]
        for ts in kept[0].keys() | kept[1].keys():
            self.halves.updateValue((int(ts),), tuple([int(at) for at in side.get(ts, [])] for side in kept))

    def close(self) -> None:
        pass


def pair_shots(log: DataFrame) -> DataFrame:
    """Pairs of image and result as they come; arming the next shot throws the halves that still wait out as strays.

    ``log``: session_id, arrival, kind (``arm`` | ``image`` | ``result``), ts_ns, wanted.  Result: session_id, shot (from
    1), ts_ns, image_arrival, result_arrival; a stray has one of the two only.  The first ``wanted`` images of a
    shot count, the others are dropped; halves before the first arming have no shot and are dropped too.
    """
    return _process(log, "session_id", PairShots(), "shot long, ts_ns long, image_arrival long, result_arrival long")


class Interleave(StatefulProcessor):
    """Audio that waits for a video stamp at or above its own, in parts of a batch each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clip = handle.getValueState("clip", "newest long, video long, due long, written long, head long, tail long")
        self.waiting = handle.getMapState("waiting", "part long", "due array<long>, arrival array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, reached, due, written, head, tail = self.clip.get() if self.clip.exists() else (NEVER, NEVER, NEVER, 0, 0, 0)
        batch = in_order("clip", key, rows, newest)
        if batch.empty:
            return
        ends = batch["is_end"].to_numpy(bool) if "is_end" in batch else np.zeros(len(batch), bool)
        audio, at, ts = batch["is_audio"].to_numpy(bool) & ~ends, batch["arrival"].to_numpy(), batch["ts_ns"].to_numpy()
        v_at = at[~audio & ~ends]
        stamps = np.maximum.accumulate(np.concatenate([[reached], ts[~audio & ~ends]]))
        # a packet waits for those before it, so its own time is the largest so far
        dues = np.maximum.accumulate(np.concatenate([[due], ts[audio]]))[1:]
        taken_due, taken_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while head < tail and (len(v_at) or ends.any()):
            part_due, part_at = (np.array(x, np.int64) for x in self.waiting.getValue((head,)))
            if part_due[0] > stamps[-1] and not ends.any():
                break
            self.waiting.removeKey((head,))
            taken_due.append(part_due)
            taken_at.append(part_at)
            head += 1
        n_taken = sum(map(len, taken_at))
        a_due, a_at = np.concatenate([*taken_due, dues]), np.concatenate([*taken_at, at[audio]])
        gate = np.maximum(np.searchsorted(stamps[1:], a_due), np.searchsorted(v_at, a_at))
        ready = gate < len(v_at)
        slot = np.concatenate([2 * gate[ready], 2 * np.arange(len(v_at)) + 1])
        order = np.argsort(slot, kind="stable")
        arrival = np.concatenate([a_at[ready], v_at])[order]
        is_audio = np.concatenate([np.ones(int(ready.sum()), bool), np.zeros(len(v_at), bool)])[order]
        gates = pd.array(v_at[slot[order] // 2] if len(order) else [], dtype="Int64")
        gates[~is_audio] = pd.NA
        left = ~ready
        if ends.any():
            arrival, is_audio = np.concatenate([arrival, a_at[left]]), np.concatenate([is_audio, np.ones(int(left.sum()), bool)])
            gates = pd.array([*gates, *[pd.NA] * int(left.sum())], dtype="Int64")
            left[:] = False
        old = np.arange(len(left)) < n_taken
        if (left & old).any():  # the rest of the part read last goes back to its place
            head -= 1
            self.waiting.updateValue((head,), (a_due[left & old].tolist(), a_at[left & old].tolist()))
        if (left & ~old).any():
            self.waiting.updateValue((tail,), (a_due[left & ~old].tolist(), a_at[left & ~old].tolist()))
            tail += 1
        self.clip.update((int(at[-1]), int(stamps[-1]), int(dues[-1]) if len(dues) else due, written + len(arrival), head, tail))
        yield pd.DataFrame({"clip_id": key[0], "arrival": arrival, "is_audio": is_audio, "gate": gates, "out_pos": written + np.arange(len(arrival))})

    def close(self) -> None:
        pass


def interleave(packets: DataFrame) -> DataFrame:
    """Audio gated by video as packets arrive; audio later than every video so far stays in state.

    A row with ``is_end`` closes its clip (the column may be absent): audio still waiting is written
    behind everything else, without a gate.
    """
    return _process(packets, "clip_id", Interleave(), "arrival long, is_audio boolean, gate long, out_pos long")


class HoldForNeutral(StatefulProcessor):
    """Frames that wait for the clip's first neutral; a list entry for each batch that brings some."""

    names = ("n0", "n1", "n2")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clip = handle.getValueState("clip", "newest long, ready boolean, n0 double, n1 double, n2 double")
        self.waiting = handle.getListState("waiting", "arrival array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, ready, *values = self.clip.get() if self.clip.exists() else (NEVER, False, 0.0, 0.0, 0.0)
        batch = in_order("clip", key, rows, newest)
        if batch.empty:
            return
        at = batch["arrival"].to_numpy()
        neutral, frame = batch["is_neutral"].to_numpy(bool), batch["is_frame"].to_numpy(bool)
        known = np.vstack([[values], batch[list(self.names)].to_numpy(float)[neutral]])
        seen = np.cumsum(neutral)[frame]  # neutrals of this batch up to each frame; 0 is the one from before
        frames = at[frame]
        if not ready:
            early = frames[seen == 0]
            frames, seen = frames[seen > 0], seen[seen > 0]
            if neutral.any():
                held = [np.array(part, np.int64) for (part,) in self.waiting.get()]
                early = np.concatenate([*held, early])
                self.waiting.clear()
                frames, seen = np.concatenate([early, frames]), np.concatenate([np.ones(len(early), int), seen])
                ready = True
            elif len(early):
                self.waiting.appendValue((early.tolist(),))
        self.clip.update((int(at[-1]), bool(ready), *map(float, known[-1])))
        out = pd.DataFrame(known[seen], columns=list(self.names))
        out.insert(0, "arrival", frames)
        out.insert(0, "clip_id", key[0])
        yield out

    def close(self) -> None:
        pass


def hold_for_neutral(events: DataFrame) -> DataFrame:
    """Frames with the newest neutral; frames wait in state until the clip's first neutral.

    ``events``: clip_id, arrival, is_neutral, is_frame, n0, n1, n2.
    """
    return _process(events, "clip_id", HoldForNeutral(), "arrival long, n0 double, n1 double, n2 double")
