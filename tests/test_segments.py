import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cliploom.operators import affine, pairing, scalars, segments
from cliploom.operators.container import assign_clusters
from cliploom.operators.segments import Scan


def clip_rows(seed, clips=3, n=60):
    rng = random.Random(seed)
    return [(c, a, rng.choice([None, rng.randint(-50, 50)])) for c in range(clips) for a in sorted(rng.sample(range(500), n))]


@pytest.mark.parametrize("bits,levels", [(3, 1), (2, 2), (2, 3), (12, 2), (4, 0)])
def test_scan_equals_plain_window(spark, bits, levels):
    df = spark.createDataFrame(clip_rows(bits), "k long, a long, v long").repartition(5)
    kinds = {
        "s": Scan("sum", F.col("v")), "ss": Scan("sum", F.col("v"), strict=True),
        "m": Scan("max", F.col("v")), "l": Scan("last", F.col("v")), "ls": Scan("last", F.col("v"), strict=True),
        "f": Scan("first", F.col("v")), "n": Scan("next", F.col("v")), "ns": Scan("next", F.col("v"), strict=True),
        "p": Scan("position"),
    }
    got = segments.scan(df, ["k"], ["a"], kinds, bits=bits, levels=levels)
    w = W.partitionBy("k").orderBy("a")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    ahead, after = w.rowsBetween(0, W.unboundedFollowing), w.rowsBetween(1, W.unboundedFollowing)
    want = df.select(
        "k", "a", "v", F.sum("v").over(upto).alias("s"), F.sum("v").over(before).alias("ss"), F.max("v").over(upto).alias("m"),
        F.last("v", True).over(upto).alias("l"), F.last("v", True).over(before).alias("ls"),
        F.first("v", True).over(upto).alias("f"), F.first("v", True).over(ahead).alias("n"),
        F.first("v", True).over(after).alias("ns"), (F.row_number().over(w) - 1).cast("long").alias("p"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_null_keys_are_keys_of_their_own(spark, levels):
    rows = [(k, j, a, 1) for k in (None, 1) for j in (None, 2) for a in range(10)]
    df = spark.createDataFrame(rows, "k long, j long, a long, v long").repartition(3)
    got = segments.scan(df, ["k", "j"], ["a"], {"s": Scan("sum", F.col("v"))}, bits=1, levels=levels)
    assert sorted((r.k or 0, r.j or 0, r.a, r.s) for r in got.collect()) == sorted((k or 0, j or 0, a, a + 1) for k, j, a, _ in rows)
    ones = [(k, t, 1.0, [1.0]) for k in (None, 1) for t in range(10)]
    steps = spark.createDataFrame(ones, "k long, t long, a double, x array<double>")
    run = affine.affine_scan(steps, ["k"], "t", F.col("a"), F.col("x"), F.array(F.lit(0.0)), bits=1, levels=levels)
    assert sorted((r.k or 0, r.t, r.m[0]) for r in run.collect()) == sorted((k or 0, t, t + 1.0) for k, t, _, _ in ones)


def test_attach_finds_the_null_key(spark):
    df = spark.range(100).select(F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (None, "none")], "k long, s string")
    got = segments.attach(df, small, ["k"], F.col("id"))
    assert {(r.k, r.s) for r in got.distinct().collect()} >= {(0, "a"), (None, "none"), (2, None)} and got.count() == 100


def test_attach_keeps_every_row(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, s string")
    got = segments.attach(df, small, ["k"], F.col("id"))
    assert got.count() == 1000
    assert {(r.k, r.s) for r in got.distinct().collect()} == {(0, "a"), (1, "b"), (2, None)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_attach_makes_no_copies_and_can_rule_out_a_broadcast(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    per_key = spark.range(2).select(F.col("id").alias("k"), F.lit("a").alias("s"))
    assert "Generate" not in plan_of(segments.attach(df, per_key, ["k"], F.col("id")))
    got = segments.attach(df, per_key, ["k"], few=False)
    assert "Generate" not in plan_of(got) and "BroadcastHashJoin" not in plan_of(got) and got.count() == 1000
    salted = segments.attach(df, per_key, ["k"], F.col("id"), salts=4)
    assert sorted(map(str, got.collect())) == sorted(map(str, salted.collect()))


def test_values_per_burst_and_device_are_not_broadcast(spark):
    frames = spark.range(300).select((F.col("id") / 3).cast("long").alias("burst"), F.col("id").alias("frame_id"), F.lit(4).alias("w"), F.lit(2).alias("h"),
                                     F.when(F.col("id") == 7, 15).otherwise(16).cast("long").alias("bytes"))
    kept = scalars.geometry_guard(frames, "burst")
    assert "BroadcastHashJoin" not in plan_of(kept) and kept.count() == 297
    rgb = spark.range(30).select((F.col("id") % 4).alias("device"), "id", *[F.lit(0.5).alias(c) for c in "rgb"])
    one = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    devices = spark.range(3).select(F.col("id").alias("device"), F.array(*[F.lit(1.0)] * 3).alias("gains"), one.alias("ccm"))
    out = scalars.develop_colour(rgb, devices)
    assert "BroadcastHashJoin" not in plan_of(out) and out.count() == 23


def test_no_window_is_open_ahead(spark):
    df = spark.createDataFrame(clip_rows(1), "k long, a long, v long")
    got = segments.scan(df, ["k"], ["a"], {"n": Scan("next", F.col("v")), "ns": Scan("next", F.col("v"), strict=True)})
    assert "unboundedfollowing" not in plan_of(got).lower()


def fifo(events):
    out, queue = [], []
    for at, kind in events:
        if kind == "name":
            queue.append(at)
        else:
            got = queue.pop(0) if queue else None
            if kind == "image":
                out.append((at, got))
    return out


def test_fifo_names_replay(spark):
    rng = random.Random(5)
    rows = [(s, a, rng.choice(["name", "image", "fail"])) for s in range(6) for a in range(80)]
    got = pairing.fifo_names(spark.createDataFrame(rows, "session_id long, arrival long, kind string"), bits=3, levels=2)
    want = [(s, *r) for s in range(6) for r in fifo([(a, k) for q, a, k in rows if q == s])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def interleave(packets):
    out, queue, newest = [], [], None
    for at, audio, ts in packets:
        if audio:
            queue.append((at, ts))
            continue
        newest = ts if newest is None else max(newest, ts)
        while queue and queue[0][1] <= newest:
            out.append((queue.pop(0)[0], at))
        out.append((at, None))
    return [(a, g, i) for i, (a, g) in enumerate(out + [(a, None) for a, _ in queue])]


def test_interleave_replay(spark):
    rng = random.Random(7)
    rows = [(c, a, rng.random() < (0.5, 0.9, 0.1, 1.0)[c], a * 40 + rng.randint(-200, 200)) for c in range(4) for a in range(120)]
    df = spark.createDataFrame(rows, "clip_id long, arrival long, is_audio boolean, ts_ns long")
    got = pairing.interleave_tracks(df, bits=4, levels=2)
    want = [(c, *r) for c in range(4) for r in interleave([r[1:] for r in rows if r[0] == c])]
    assert sorted((r.clip_id, r.arrival, r.gate, r.out_pos) for r in got.collect()) == sorted(want, key=lambda r: r[:2])


def test_interleave_with_a_clock_that_stands_still(spark, monkeypatch):
    """One stamp of the far future holds a running maximum for the rest of the clip; that stretch is one row of the axis."""
    monkeypatch.setattr(segments, "SEGMENT_BITS", 3)
    rng = random.Random(9)
    rows = []
    for c in range(4):
        for a in range(200):
            ts = 10**15 if a == 20 and c < 3 or c == 2 and a == 50 else a * 40 + rng.randint(-200, 200)
            rows.append((c, a, (a == 50 if c == 2 else a == 20) if ts == 10**15 and c else rng.random() < 0.5, ts))
    df = spark.createDataFrame(rows, "clip_id long, arrival long, is_audio boolean, ts_ns long")
    asked = []
    scan = segments.scan
    monkeypatch.setattr(segments, "scan", lambda d, keys, order, *a, **kw: (asked.append(d) if order[0] == "value" else None, scan(d, keys, order, *a, **kw))[1])
    got = pairing.interleave_tracks(df).collect()
    want = [(c, *r) for c in range(4) for r in interleave([r[1:] for r in rows if r[0] == c])]
    assert sorted((r.clip_id, r.arrival, r.gate, r.out_pos) for r in got) == sorted(want, key=lambda r: r[:2])
    axis = asked[0].groupBy("clip_id", "value", "kind").count().where("count > 1")
    assert len(asked) == 1 and axis.count() == 0 and asked[0].where(F.col("value") == 10**15).count() <= 6


@pytest.mark.parametrize("levels", [0, 1, 2])
@pytest.mark.parametrize("keys", [0.0, 0.05])
def test_clusters_replay(spark, levels, keys):
    rng = random.Random(11)
    rows = []
    for c in range(4):
        for a in range(150):
            rel = max(0, a * 7 + rng.randint(-30, 30)) if c else 0
            rows.append((c, a, rng.random() < 0.5, rng.random() < keys, rel))
    df = spark.createDataFrame(rows, "clip_id long, arrival long, is_audio boolean, is_key boolean, rel_ns long")
    got = assign_clusters(df, span_ns=25, bits=3, fan_bits=2, levels=levels)
    want = []
    for c in range(4):
        base, number = None, -1
        for _, a, audio, key, rel in (r for r in rows if r[0] == c):
            if base is None or (not audio and key and rel != base) or abs(rel - base) > 25:
                base, number = rel, number + 1
            want.append((c, a, base, number))
    assert sorted((r.clip_id, r.arrival, r.base_ns, r.cluster) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("bits,levels", [(2, 0), (2, 1), (2, 2), (8, 2)])
def test_affine_scan_replay(spark, bits, levels):
    rng = random.Random(3)
    rows = [(k, t, rng.random(), [rng.random(), rng.random()]) for k in range(2) for t in range(70)]
    df = spark.createDataFrame(rows, "k long, t long, a double, x array<double>")
    got = affine.affine_scan(df, ["k"], "t", F.col("a"), F.col("x"), F.array(F.lit(5.0), F.lit(-5.0)), ["a"], bits=bits, levels=levels)
    have = {(r.k, r.t): r.m for r in got.collect()}
    for k in range(2):
        m = [5.0, -5.0]
        for _, t, a, x in (r for r in rows if r[0] == k):
            m = [a * p + q for p, q in zip(m, x)]
            assert have[k, t] == pytest.approx(m, abs=1e-12)
