import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cliploom.operators import bursts, frames
from cliploom.plans import hdr


def image_df(spark, planes, key="pair_id"):
    rows = [(k, y, x, float(v)) for k, p in planes.items() for (y, x), v in np.ndenumerate(p)]
    return spark.createDataFrame(rows, f"{key} long, y int, x int, v double")


def scene(h, w, seed=0):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 600, (h // 4, w // 4)), np.ones((4, 4), int)) + rng.integers(0, 40, (h, w))


def test_align_known_shift(spark):
    big = scene(80, 96)
    ref, mov = big[8:72, 8:88], big[5:69, 6:86]  # mov(y+3, x+2) == ref(y, x)
    got = bursts.align(image_df(spark, {1: ref}), image_df(spark, {1: mov}), 80, 64).collect()
    assert [(r.dx, r.dy) for r in got] == [(2, 3)]


def burst(spark, shift):
    big = scene(96, 96, 3) + 100
    planes = {i: big[16 + s[1]:80 + s[1], 16 + s[0]:80 + s[0]] for i, s in enumerate([(0, 0), (0, 0), shift])}
    meta = [(7, i, i, 3, 10_000_000, 100, 4000, [0.0] * 4, 64, 64, 8192) for i in range(3)]
    frames_df = spark.createDataFrame(
        meta, "burst long, frame_id long, idx int, expected int, exposure_ns long, iso int, white int, black array<double>, w int, h int, bytes long")
    return planes, frames_df, image_df(spark, planes, "frame_id").withColumn("v", F.col("v").cast("int"))


def test_merge_removes_a_known_translation(spark):
    planes, meta, pixels = burst(spark, (-6, -4))
    err = {}
    for name, kw in {"plus": {}, "minus": {"as_written": True}, "none": {"aligned": False}}.items():
        out = hdr.merge_bursts(meta, pixels, 64, 64, **kw).collect()
        assert len(out) == 64 * 64
        err[name] = sum((r.value - planes[1][r.y, r.x]) ** 2 for r in out)
    assert err["plus"] == 0
    assert err["none"] > 0 and err["minus"] > 0


def test_incomplete_and_mixed_bursts_give_nothing(spark):
    _, meta, pixels = burst(spark, (0, 0))
    assert hdr.merge_bursts(meta.filter("idx < 2"), pixels, 64, 64, aligned=False).count() == 0
    mixed = meta.withColumn("w", F.when(F.col("idx") == 2, 32).otherwise(F.col("w")))
    assert hdr.merge_bursts(mixed, pixels, 64, 64, aligned=False).count() == 0


def test_missing_exposure_and_all_clipped_pixel(spark):
    meta = [(1, i, i, e, 100, 800, [60.0] * 4) for i, e in enumerate([0, 10, 10])]
    df = spark.createDataFrame(meta, "burst long, frame_id long, idx int, exposure_ns long, iso int, white int, black array<double>")
    per_burst, per_frame = bursts.burst_scalars(df)
    assert {r.frame_id: r.e_rel for r in per_frame.collect()} == {0: 0.25, 1: 1.0, 2: 4.0}
    pixels = spark.createDataFrame([(i, 0, 0, 800) for i in range(3)], "frame_id long, y int, x int, v int")
    out = bursts.merge_brackets(pixels, df, per_burst, per_frame, 1, 1).collect()
    assert out[0].radiance == 740.0


def test_pyramid_sizes():
    assert bursts.pyramid_sizes(2040, 1530)[-1] == (31, 23) or bursts.pyramid_sizes(2040, 1530)[-1][1] <= 16
    assert bursts.pyramid_sizes(16, 99) == [(16, 99)]


def nlm_brute(planes, target, history):
    h, w = planes[target].shape
    pad = 6
    big = {k: np.pad(p, pad, mode="reflect") for k, p in planes.items()}
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            sigma = 0.04 * np.sqrt(max(planes[target][y, x], 0)) + 0.004
            num = den = 0.0
            for src in dict.fromkeys(history):
                for oy in (-4, -2, 0, 2, 4):
                    for ox in (-4, -2, 0, 2, 4):
                        d2 = np.mean([(big[target][y + pad + qy, x + pad + qx] - big[src][y + pad + qy + oy, x + pad + qx + ox]) ** 2
                                      for qy in (-2, 0, 2) for qx in (-2, 0, 2)])
                        wt = np.exp(-max(d2 - 2 * sigma**2, 0) / (1.25 * sigma) ** 2)
                        num += wt * big[src][y + pad + oy, x + pad + ox]
                        den += wt
            out[y, x] = num / den
    return out


@pytest.mark.parametrize("bits", [3, 8])
def test_non_local_means_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(frames, "TILE_BITS", bits)
    rng = np.random.default_rng(1)
    planes = {i: 0.5 + 0.05 * rng.standard_normal((12, 18)) for i in range(3)}
    history = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 1, 0)], "frame_id long, past0 long, past1 long")
    got = frames.non_local_means(image_df(spark, planes, "frame_id"), history, 18, 12)
    values = {(r.frame_id, r.y, r.x): r.v for r in got.collect()}
    for target, past in {0: [0], 1: [1, 0], 2: [2, 1, 0]}.items():
        want = nlm_brute(planes, target, past)
        assert max(abs(values[target, y, x] - want[y, x]) for y in range(12) for x in range(18)) < 1e-12


def test_tiles_do_not_change_a_demosaic(spark, monkeypatch):
    plane = {0: np.random.default_rng(4).random((40, 50))}
    out = []
    for bits in (3, 4, 8):
        monkeypatch.setattr(frames, "TILE_BITS", bits)
        out.append(sorted(map(tuple, frames.demosaic(image_df(spark, plane, "image_id"), 50, 40).collect())))
    assert len(out[0]) == 2000
    for other in out[1:]:
        assert np.allclose(np.array(out[0]), np.array(other), atol=1e-12)


def test_constant_image_unchanged_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(frames, "TILE_BITS", 5)
    planes = {0: np.full((70, 80), 0.25)}
    history = spark.createDataFrame([(0, 0, 0)], "frame_id long, past0 long, past1 long")
    got = frames.non_local_means(image_df(spark, planes, "frame_id"), history, 80, 70)
    assert got.count() == 70 * 80
    assert got.filter(F.abs(F.col("v") - 0.25) > 1e-12).count() == 0
    rgb = frames.demosaic(image_df(spark, planes, "image_id"), 80, 70)
    assert rgb.count() == 70 * 80
    assert rgb.filter((F.abs(F.col("r") - 0.25) > 1e-12) | (F.abs(F.col("b") - 0.25) > 1e-12)).count() == 0


def test_temporal_blend_is_identity_at_the_shipped_cap(spark):
    rng = np.random.default_rng(2)
    planes = {i: rng.random((10, 10)) for i in range(4)}
    meta = spark.createDataFrame(
        [(0, i, i, max(i - 1, 0), 1.0) for i in range(4)], "clip_id long, frame_id long, idx long, past0 long, trust double")
    got = frames.temporal_blend(image_df(spark, planes, "frame_id"), meta, 10, 10).collect()
    assert len(got) == 400
    assert all(r.v == pytest.approx(planes[r.frame_id][r.y, r.x], abs=1e-15) for r in got)


@pytest.mark.parametrize("width", [1, 5, 63, 64, 65, 130, 200])
def test_packed_lines_equal_single_bits(width):
    """Lines of any width, moved by any shift, against a comparison place by place."""
    rng = np.random.default_rng(width)
    ref = [rng.random(width) < 0.5 for _ in range(6)] + [rng.random(70) < 0.5, np.zeros(0, bool)]
    mov = [rng.random(width) < 0.5 for _ in range(6)] + [rng.random(3) < 0.5, rng.random(9) < 0.5]
    shifts = [sorted({0, 1, -1, 2, -3, width // 2, -width, 63, 64, -65, width + 4}) for _ in ref]
    shifts[3] = [7]
    pack = lambda lines: bursts._packed.func(pa.array([x.tolist() for x in lines], pa.list_(pa.bool_())))
    size = lambda lines: pa.array([len(x) for x in lines], pa.int32())
    got = bursts._mismatches.func(pack(ref), pack(mov), size(ref), size(mov), pa.array(shifts, pa.list_(pa.int32()))).to_pylist()
    want = [[sum(bool(r[x] != m[x + dx]) for x in range(len(r)) if 0 <= x + dx < len(m)) for dx in dxs] for r, m, dxs in zip(ref, mov, shifts)]
    assert got == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_patch_sums_equal_single_patches(spark, monkeypatch, radius):
    """Running sums over the same-colour grids against every patch by itself, over tiles of any size."""
    rng = np.random.default_rng(radius)
    for shape, count, step in (((9, 14), 3, 2), ((20, 7), 2, 3), ((6, 6), 1, 2)):
        a = rng.random(shape)
        for axis in (0, 1):
            n = shape[axis] - (count - 1) * step
            want = sum(np.take(a, range(k * step, k * step + n), axis) for k in range(count))
            assert np.allclose(frames._spread_sums(a, count, step, axis), want, atol=1e-13)
    planes = {i: 0.5 + 0.05 * rng.standard_normal((21, 18)) for i in range(2)}
    history = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "frame_id long, past0 long, past1 long")
    out = []
    for bits in (3, 4, 8):
        monkeypatch.setattr(frames, "TILE_BITS", bits)
        got = frames.non_local_means(image_df(spark, planes, "frame_id"), history, 18, 21, patch_radius=radius)
        out.append({(r.frame_id, r.y, r.x): r.v for r in got.collect()})
    assert len(out[0]) == 2 * 21 * 18
    for other in out[1:]:
        assert max(abs(out[0][k] - v) for k, v in other.items()) < 1e-12


def test_no_pixel_join_with_the_history(spark):
    """Joins are of tiles: below them pixels are already packed."""
    pixels = image_df(spark, {0: np.zeros((8, 8))}, "frame_id")
    history = spark.createDataFrame([(0, 0, 0)], "frame_id long, past0 long, past1 long")
    plan = frames.non_local_means(pixels, history, 8, 8)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "plane" in plan[:join] or plan.index("FlatMapGroupsInPandas", join) > join
    assert plan.count("FlatMapGroupsInPandas") == 2
