"""Streams over many files and micro-batches give the batch result."""

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cliploom import catalog
from cliploom.catalog import streams
from cliploom.catalog.bursts import burst_frames_of
from cliploom.catalog.pairing import shot_log
from cliploom.operators import bursts, container, pairing, scalars, telemetry
from cliploom.sources import views
from cliploom.streaming import ingest, stateful, waiting

FOLDER = "/root/testdata/sf0.001"


def split_events(spark, tmp_path, parts=4):
    """One file per arrival range, written in order so that batches do not go back in arrival."""
    e = spark.read.parquet(f"{FOLDER}/events.parquet")
    size = e.count() // parts + 1
    for i in range(parts):
        e.filter(F.floor(F.col("event_id") / size) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return ingest.read_stream(spark, str(tmp_path / "events"), "*.parquet", files_per_trigger=1), e


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_stateful_streams_equal_batch(spark, tmp_path):
    stream, events = split_events(spark, tmp_path)
    packets = views.packets_of(events)
    cols = ["clip_id", "arrival", "rel_ns", "base_ns", "cluster"]
    same(ingest.drain(stateful.cluster(views.packets_of(stream))).select(cols),
         container.assign_clusters(scalars.relative_time(packets)).select(cols))
    cols = ["clip_id", "window", "frames", "drops", "gap_max_ns", "gpu_max_ns"]
    same(ingest.drain(stateful.telemetry_windows(views.telemetry_of(stream), 60)).select(cols),
         telemetry.telemetry_windows(views.telemetry_of(events)).select(cols))
    cols = ["clip_id", "arrival", "is_audio", "gate", "out_pos"]
    with ingest.large_state(spark):
        gated = ingest.drain(waiting.interleave(views.packets_of(stream)))
    same(gated.select(cols),
         pairing.interleave_tracks(packets).filter("NOT is_audio OR gate IS NOT NULL").select(cols))
    same(ingest.drain(stateful.complete_bursts(burst_frames_of(stream))), bursts.complete_bursts(burst_frames_of(events)))
    cols = ["clip_id", "arrival", "n0", "n1", "n2"]
    held = pairing.newest_neutral(views.neutral_of(events), ["n0", "n1", "n2"]).filter("n0 IS NOT NULL")
    with ingest.large_state(spark):
        same(ingest.drain(waiting.hold_for_neutral(views.neutral_of(stream))).select(cols), held.select(cols))


def test_files_that_go_back_are_rejected(spark, tmp_path):
    e = spark.read.parquet(f"{FOLDER}/events.parquet")
    for part in ("event_id >= 500", "event_id < 500"):
        e.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = ingest.read_stream(spark, str(tmp_path / "events"), "*.parquet", files_per_trigger=1)
    with pytest.raises(StreamingQueryException, match="goes back"):
        ingest.drain(stateful.cluster(views.packets_of(stream)))
    with ingest.large_state(spark), pytest.raises(StreamingQueryException, match="goes back"):
        ingest.drain(waiting.interleave(views.packets_of(stream)))


def test_shots_are_flushed_at_arming(spark, tmp_path):
    """Over four batches the stream pairs as the batch form does, and throws out every half of a shot that ended."""
    stream, events = split_events(spark, tmp_path)
    with ingest.large_state(spark):
        out = ingest.drain(waiting.pair_shots(shot_log(stream))).toPandas()
    log = shot_log(events)
    pairs = pairing.pair_shots(log).toPandas()
    key = ["session_id", "shot", "ts_ns", "image_arrival", "result_arrival"]
    both = out.dropna()
    assert sorted(map(tuple, both[key].astype("int64").to_numpy().tolist())) == sorted(map(tuple, pairs[key].to_numpy().tolist()))
    strays = out[out[["image_arrival", "result_arrival"]].isna().any(axis=1)]
    shots, want = {}, set()
    for r in log.orderBy("session_id", "arrival").collect():
        s = shots.setdefault(r["session_id"], {"shot": 0, "image": [], "result": []})
        if r["kind"] == "arm":
            if s["shot"]:
                stamps = {k: {ts for ts, _ in s[k]} for k in ("image", "result")}
                want |= {(r["session_id"], s["shot"], ts, k, at) for k, o in (("image", "result"), ("result", "image")) for ts, at in s[k] if ts not in stamps[o]}
            s |= {"shot": s["shot"] + 1, "image": [], "result": [], "left": r["wanted"]}
        elif s["shot"] and (r["kind"] == "result" or s["left"] > 0):
            s["left"] -= r["kind"] == "image"
            s[r["kind"]].append((r["ts_ns"], r["arrival"]))
    got = {(r.session_id, r.shot, r.ts_ns, *(("image", r.image_arrival) if r.image_arrival == r.image_arrival else ("result", r.result_arrival)))
           for r in strays.astype(float).itertuples()}
    assert want and got == want


class Cell:
    """State of one variable, which counts the numbers written to it."""

    def __init__(self, log):
        self.value, self.log = {}, log

    def _note(self, value):
        self.log[-1] += sum(len(v) if isinstance(v, list) else 1 for v in value)

    def exists(self):
        return "v" in self.value

    def get(self):
        return self.value.get("v") if "v" in self.value else iter([v for k, v in sorted(self.value.items())])

    def update(self, value):
        self._note(value)
        self.value["v"] = value

    def appendValue(self, value):
        self._note(value)
        self.value[len(self.value)] = value

    def updateValue(self, key, value):
        self._note(value)
        self.value[key] = value

    def getValue(self, key):
        return self.value[key]

    def containsKey(self, key):
        return key in self.value

    def removeKey(self, key):
        del self.value[key]

    def iterator(self):
        return iter(list(self.value.items()))

    def clear(self):
        self.value.clear()


class Handle:
    def __init__(self):
        self.log, self.cells = [], {}

    def _cell(self, name, *_):
        return self.cells.setdefault(name, Cell(self.log))

    getValueState = getListState = getMapState = _cell


def fed(processor, batches):
    """Output rows of every batch, and the numbers that it wrote to the state."""
    handle, out = Handle(), []
    processor.init(handle)
    for batch in batches:
        handle.log.append(0)
        out.append(pd.concat(list(processor.handleInputRows((1,), iter([batch]), None))))
    return out, handle


def test_a_batch_writes_what_it_brings():
    """Audio and frames that wait for long are not written again with every batch."""
    n, size = 40, 25
    audio = [pd.DataFrame({"arrival": range(b * size, (b + 1) * size), "is_audio": True, "ts_ns": range(b * size, (b + 1) * size)}) for b in range(n)]
    video = pd.DataFrame({"arrival": [n * size, n * size + 1], "is_audio": False, "ts_ns": [333, 10**9]})
    out, handle = fed(waiting.Interleave(), [*audio, video])
    assert max(handle.log[:n]) <= 2 * size + 6 and sum(map(len, out[:n])) == 0
    assert out[n]["arrival"].tolist() == [*range(334), n * size, *range(334, n * size), n * size + 1]
    assert not handle.cells["waiting"].value
    half, handle = fed(waiting.Interleave(), [*audio, video.iloc[:1]])
    assert len(half[n]) == 335 and handle.log[n] <= 2 * size + 6  # the rest of one part is all that is put back
    frames = [pd.DataFrame({"arrival": range(b * size, (b + 1) * size), "is_neutral": False, "is_frame": True, "n0": 0.0, "n1": 0.0, "n2": 0.0}) for b in range(n)]
    neutral = pd.DataFrame({"arrival": [n * size], "is_neutral": True, "is_frame": False, "n0": 1.0, "n1": 2.0, "n2": 3.0})
    out, handle = fed(waiting.HoldForNeutral(), [*frames, neutral])
    assert max(handle.log[:n]) <= size + 5 and out[n]["arrival"].tolist() == list(range(n * size)) and set(out[n]["n1"]) == {2.0}
    assert not handle.cells["waiting"].value


def test_arming_empties_the_state():
    rows = [(0, "arm", 0, 9), (1, "image", 5, 0), (2, "result", 6, 0), (3, "image", 6, 0), (4, "arm", 0, 1)]
    batches = [pd.DataFrame([r], columns=["arrival", "kind", "ts_ns", "wanted"]) for r in rows]
    out, handle = fed(waiting.PairShots(), batches)
    assert [len(o) for o in out] == [0, 0, 0, 1, 1] and not handle.cells["halves"].value
    assert out[3][["ts_ns", "image_arrival", "result_arrival"]].to_numpy().tolist() == [[6, 3, 2]]
    assert out[4]["image_arrival"].tolist() == [1] and out[4]["result_arrival"].isna().all()


def test_staged_parts(spark):
    """A micro-batch is a part of the order, whatever the sizes; rows without a number are in the first."""
    rows = spark.range(0, 100, 1, 5).select(F.when(F.col("id") % 10 < 9, F.col("id")).alias("number"), "id").where("id < 30 OR id >= 90")
    folder = ingest.staged(rows, "number", parts=5, seal=spark.range(1).select((F.col("id") + 1000).alias("number")), files=3)
    stream = ingest.read_stream(spark, folder, "*.parquet", files_per_trigger=3)
    out = ingest.drain_batches(stream, lambda b: b.agg(F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"),
                                                       F.count_if(F.col("number").isNull()).alias("missing")))
    got = sorted((r["batch"], r["n"], r["low"], r["high"], r["missing"]) for r in spark.read.parquet(out.inputFiles()[0].rsplit("/batch=", 1)[0]).collect() if r["n"])
    assert sum(g[1] for g in got) == 41
    bounds = [(low, high) for _, _, low, high, _ in got]
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:])) and got[0][4] == 4 and sum(g[4] for g in got) == 4


def test_pairs_wait_by_the_part(spark, tmp_path, monkeypatch):
    """More rows make more micro-batches, staged with what the streams read; state has few partitions while they run; pairs are all there."""
    monkeypatch.setattr(streams, "PART_ROWS", 60)
    folder = str(tmp_path)
    orders = spark.range(120).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("x").alias("o_comment"))
    lines = spark.range(360).select(
        F.floor(F.col("id") / 3).alias("l_orderkey"), (F.col("id") % 11).alias("l_suppkey"), (F.col("id") % 3 + 1).cast("int").alias("l_linenumber"),
        (F.col("id") * 2).alias("l_partkey"), F.lit("x").alias("l_comment"))
    orders.write.parquet(f"{folder}/orders.parquet")
    lines.write.parquet(f"{folder}/lineitem.parquet")
    parts = []
    monkeypatch.setattr(ingest, "staged", lambda rows, by, n, seal, real=ingest.staged: parts.append((n, rows.columns)) or real(rows, by, n, seal))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        with ingest.few_states(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == max(8, spark.sparkContext.defaultParallelism)
        got = catalog.queries()["r2_pair_three_streams"](spark, folder)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert parts == [(6, ["o_orderkey", "o_custkey"]), (6, ["l_orderkey", "l_suppkey", "l_linenumber", "l_partkey"])]
    assert sorted(map(tuple, got.collect())) == sorted((i // 3, i // 3 % 7, i % 11, i % 3 + 1, i // 3 * 6) for i in range(360))
