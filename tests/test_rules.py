import re

import numpy as np
from pyspark.sql import functions as F

from cliploom.functions import pixel, rates, tags
from cliploom.operators import container, scalars, selection


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_nal_edges(spark):
    payload = bytes([9, 9, 0, 0, 1, 0x40, 1, 0, 0, 0, 1, 0, 0, 1, 0x42, 0, 0, 0, 0, 1, 0x44, 7])
    df = spark.createDataFrame([(1, bytearray(payload))], "packet_id long, payload binary")
    rows = container.split_nals(df).orderBy("ord").collect()
    assert [(r.ord, r.size, r.first_byte) for r in rows] == [(0, 2, 0x40), (1, 2, 0x42), (2, 2, 0x44)]
    named = container.classify_nals(container.split_nals(df)).orderBy("ord").collect()
    assert [r.name for r in named] == ["VPS", "SPS", "PPS"]


def test_units_of_many_packets_equal_a_search_packet_by_packet():
    rng = np.random.default_rng(5)
    packets = [bytes(rng.choice([0, 0, 0, 1, 2], rng.integers(0, 40)).astype(np.uint8)) for _ in range(3000)]
    want = []
    for n, raw in enumerate(packets):
        codes = [m.span() for m in re.finditer(b"\x00?\x00\x00\x01", raw)]
        want += [(n, raw[a:b]) for (_, a), b in zip(codes, [c[0] for c in codes[1:]] + [len(raw)]) if b > a]
    joined = b"".join(packets)
    packet, first, last = container.unit_places(np.frombuffer(joined, np.uint8), np.cumsum([len(p) for p in packets]))
    assert [(int(n), joined[a:b]) for n, a, b in zip(packet, first, last)] == want


def test_resolution_ties(spark):
    df = spark.createDataFrame(
        [("d", 0, 0, 10, 40, False), ("d", 1, 0, 40, 10, False), ("d", 2, 0, 99, 99, True), ("d", 3, 0, 20, 20, False)],
        "device string, ord long, fmt int, w int, h int, is_input boolean")
    best = selection.best_resolution(df).first()
    assert (best.w, best.h) == (40, 10)
    first = selection.largest_size(df.filter("NOT is_input")).first()
    assert (first.w, first.h) == (10, 40)


def test_fps_rules(spark):
    df = spark.createDataFrame(
        [("a", 0, 15, 30), ("a", 1, 24, 30), ("a", 2, 60, 60), ("a", 3, 7, 120)], "device string, ord long, lo int, hi int")
    assert tuple(selection.fixed_fps(df).first())[1:] == (60, 60)
    devices = spark.createDataFrame([("a",), ("none",)], "device string")
    got = {r.device: (r.lo, r.hi) for r in selection.exposure_fps(devices, df).collect()}
    assert got == {"a": (24, 30), "none": (30, 30)}


def test_nearest_width_falls_back_to_last(spark):
    df = spark.createDataFrame([("d", 0, 100, 10), ("d", 1, 200, 10)], "device string, ord long, w int, h int")
    assert selection.nearest_width(df, F.lit(4 / 3), 640).first().w == 200


def test_singular_matrix_and_zero_denominator(spark):
    flat = F.array(*[F.lit(1.0)] * 9)
    none = F.lit(None).cast("array<double>")
    df = spark.range(1).select(F.lit(1).alias("device"), none.alias("forward2"), F.lit(21).alias("illuminant2"),
                               none.alias("forward1"), flat.alias("colour1"))
    ccm = scalars.derive_colour_matrix(df).first().ccm
    for r in range(3):
        assert abs(sum(ccm[3 * r:3 * r + 3]) - 1) < 1e-12
    assert one(spark, tags.rational(F.lit(3), F.lit(0), 1.0)) == 1.0
    assert one(spark, tags.rational(F.lit(3), F.lit(0), 0.0)) == 0.0


def test_paths_and_rounding(spark):
    assert one(spark, rates.burst_base(F.lit("a/IMG_1_12.dng"), F.lit(2))) == "a/IMG_1_12.dng"
    assert one(spark, rates.burst_base(F.lit("a/IMG_1_12.dng"), F.lit(12))) == "a/IMG_1"
    assert one(spark, rates.cut_at_last_dng(F.lit("x.dng.dng/y"))) == "x.dng"
    assert one(spark, rates.sidecar_path(F.lit("v.mkv.mkv"))) == "v.mkv_ai.flac"
    assert one(spark, pixel.quantize_radiance(F.lit(2.5), F.lit(9.9))) == 3
    assert one(spark, pixel.quantize_radiance(F.lit(12.0), F.lit(9.9))) == 9
    assert one(spark, pixel.quantize_radiance(F.lit(-4.0), F.lit(9.9))) == 0


def test_keyframe_at_the_cluster_base_opens_nothing(spark):
    df = spark.createDataFrame([(1, 0, True, False, 0), (1, 1, False, True, 0), (1, 2, False, True, 5)],
                               "clip_id long, arrival long, is_audio boolean, is_key boolean, rel_ns long")
    assert [r.cluster for r in container.assign_clusters(df).orderBy("arrival").collect()] == [0, 0, 1]
