"""Hard negatives against a plain version, on feature frames of the denoiser too."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import hard_negatives
from cliploom.plans import denoise

SCHEMA = "frame_id long, clip_id long, bands array<double>"
LIMIT = 2**63 - 1


def brute(rows, every=10, positives=5, negatives=5, at_least=80, scale=256):
    ok = [(i, c, [max(-LIMIT - 1, min(LIMIT, int(np.floor(scale * x)))) if abs(scale * x) < 2**63 else (LIMIT if x > 0 else -LIMIT - 1) for x in v])
          for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in ok if i % every == 0}):
        group, mine = min((c, v) for i, c, v in ok if i == a)
        scored = sorted((-max(-LIMIT, min(LIMIT, sum(x * y for x, y in zip(mine, v)))), i, c) for i, c, v in ok if i != a and len(v) == len(mine))
        near = [(-s, i) for s, i, c in scored if c == group][:positives]
        for place, (p, positive) in enumerate(near, 1):
            far = [(-s, i) for s, i, c in scored if c != group and at_least * p <= 100 * -s <= 100 * p][:negatives]
            out += [(a, place, positive, rank, i, p, s) for rank, (s, i) in enumerate(far, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0 AS rank", "1.0 AS v", "2 AS dim", "3 AS anchor_id")
    columns = ["anchor_id", "place", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = hard_negatives.hard_negatives(df, **{"every": 10} | options)
    assert found.columns == columns
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize(("block", "first", "cells"), [(2048, 8, 1 << 22), (16, 1, 60), (1, 2, 36)])
def test_same_as_plain_version(spark, monkeypatch, block, first, cells):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "FIRST_DIMS", first)
    monkeypatch.setattr(hard_negatives, "PASS_CELLS", cells)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(4, 12))
    v = centres[rng.integers(0, 4, 80)] + rng.normal(size=(80, 12)) * 0.4
    v[20:30] = v[20]  # ties
    v[31] = 0
    rows = [(i, int(rng.integers(0, 3)), x.tolist()) for i, x in enumerate(v)]
    rows += [(10, 1, v[3].tolist()), (11, 2, v[5].tolist()), (11, 2, v[5].tolist()), (300, 1, None), (310, None, v[1].tolist()),
             (320, 1, [None] * 12), (330, 2, [float("inf")] * 12), (340, 0, [float("nan")] * 12), (None, 1, v[1].tolist()), (400, 1, []), (411, 1, []),
             (412, 2, []), (-10, 2, v[6].tolist()), (500, 1, [1.0, 2.0]), (501, 1, [1.0, 2.0]), (502, 2, [1.0, 1.9])]
    want = brute(rows)
    assert want and run(spark, rows) == want


def test_large_numbers(spark):
    rows = [(0, 1, [3e14, -2.5]), (1, 1, [2e14, 0.1]), (2, 2, [1.9e14, 5.0]), (3, 2, [1e300, 1.0]), (4, 1, [1e6, 1.0]), (5, 3, [9e5, 1.0])]
    assert run(spark, rows) == brute(rows)
    near = [(0, 1, [3e5, 1.0]), (1, 1, [3e5, 2.0]), (2, 2, [2.9e5, 5.0]), (3, 3, [3e5, 1.0])]
    assert run(spark, near) == brute(near) != []


def test_few_frames(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0])]) == []
    assert run(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])]) == brute([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])])
    # a negative score of the positive leaves no window
    assert run(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-1.0])]) == []


def test_hot_clip_and_options(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 6)) + 0.5
    rows = [(i, 1 if i % 3 else i, x.tolist()) for i, x in enumerate(v)]
    options = {"every": 7, "positives": 2, "negatives": 3, "at_least": 50, "scale": 16}
    assert run(spark, rows, **options) == brute(rows, **options)


def test_feature_frames_of_the_denoiser(spark):
    rng = np.random.default_rng(2)
    samples = spark.createDataFrame(
        [(clip, 0, n, float(np.sin(n * (0.2 + 0.1 * (clip % 3))) + rng.normal() * 0.1)) for clip in range(6) for n in range(400)],
        "clip_id long, ch int, n long, v double")
    frames = denoise.features(samples, size=32, hop=16, widths=(4, 6, 7), bins=4)
    frames = frames.select((F.col("clip_id") * 1000 + F.col("t")).alias("frame_id"), "clip_id", F.col("erb").alias("bands"))
    rows = [tuple(r) for r in frames.collect()]
    out = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=10)
    assert sorted(map(tuple, out.collect())) == brute(rows) != []


def test_bounds_hold_what_is_unread():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-50, 50, (30, 9)), rng.integers(-50, 50, (4, 9))
    row = {"dim": 9, "ids": np.arange(30).tobytes(), "clips": np.zeros(30, np.int64).tobytes(), "data": np.ascontiguousarray(x.T).astype("<i2").tobytes()}
    block = hard_negatives.Block(row, 50)
    order = np.argsort(-np.abs(q), axis=1)
    low, high = block.bounds(q.astype(float), order)
    for a in range(4):
        for k in range(10):
            rest = x[:, order[a][k:]] @ q[a][order[a][k:]]
            assert (low[a][k] <= rest).all() and (rest <= high[a][k]).all()
