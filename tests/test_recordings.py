"""PCM by byte range and writes that are listed by their commit."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.catalog import recordings as catalog
from cliploom.sources import binary, recordings
from cliploom.sources.binary import read_pcm

BLOCK = 8


def samples_of(clips, channels, bits):
    top = 1 << (bits - 1)
    rng = np.random.default_rng(bits + channels)
    return {clip: rng.integers(-top, top, (frames, channels)) for clip, frames in clips.items()}


def raw_bytes(values, bits):
    return values.astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()


@pytest.mark.parametrize("bits", [16, 24, 32])
@pytest.mark.parametrize("channels", [1, 3])
def test_same_rows_for_every_range(spark, bits, channels):
    folder = tempfile.mkdtemp(prefix="run-")
    data = samples_of({5: 3 * BLOCK, 6: 10 * BLOCK + 3, 7: BLOCK - 1, 8: 0}, channels, bits)
    for clip, values in data.items():
        os.makedirs(f"{folder}/{clip}")
        with open(f"{folder}/{clip}/{0:015d}.pcm", "wb") as f:
            f.write(raw_bytes(values, bits))
    want = sorted((clip, ch, n, int(v)) for clip, values in data.items() for n, row in enumerate(values[: len(values) // BLOCK * BLOCK]) for ch, v in enumerate(row))
    payloads = spark.createDataFrame([(c, bytearray(raw_bytes(v, bits))) for c, v in data.items()], "clip_id long, payload binary")
    assert sorted(map(tuple, read_pcm(payloads, bits, channels, BLOCK).collect())) == want
    frame = bits // 8 * channels
    for range_bytes in (1, BLOCK * frame, 3 * BLOCK * frame + 1, 1 << 20):
        df = recordings.read_pcm_ranges(spark, folder, bits, channels, BLOCK, range_bytes)
        assert df.columns == ["clip_id", "ch", "n", "ival"] and sorted(map(tuple, df.collect())) == want


def test_a_recording_is_the_work_of_many_tasks():
    plan = recordings.plan_ranges([("a", 1, 0, 1000), ("b", 2, 7, 90), ("c", 3, 0, 5), ("d", 4, 0, 40)], 10, 2, 100)
    assert [len(r.stretches) for r in plan] == [1] * 10 + [1, 1]
    assert [s for r in plan for s in r.stretches][:2] == [("a", 1, 0, 0, 100), ("a", 1, 50, 100, 100)]
    assert all(sum(s[4] for s in r.stretches) <= 100 for r in plan)
    small = recordings.plan_ranges([(f"f{i}", i, 0, 19) for i in range(12)], 10, 2, 50)
    assert [len(r.stretches) for r in small] == [5, 5, 2]


def test_ranges_have_a_bound():
    files = [("a", 1, 0, 100_000), *[(f"f{i}", i, 0, 35) for i in range(5000)]]
    plan = recordings.plan_ranges(files, 10, 2, 10)
    assert len(plan) <= 2 * recordings.RANGES  # a stretch that does not fit begins the next range
    stretches = [s for r in plan for s in r.stretches]
    assert [s for s in stretches if s[0] != "a"] == [(f"f{i}", i, 0, 0, 30) for i in range(5000)]
    own = [s for s in stretches if s[0] == "a"]
    assert len(own) > 1 and sum(s[4] for s in own) == 100_000 and all(a[3] + a[4] == b[3] and b[2] == b[3] // 2 for a, b in zip(own, own[1:]))


def test_short_stretches_share_a_batch():
    folder = tempfile.mkdtemp(prefix="run-")
    for i in range(20):
        with open(f"{folder}/{i}.pcm", "wb") as f:
            f.write(raw_bytes(np.array([[i], [-i]]), 16))
    reader = recordings.PcmReader({"path": folder, "bits": "16"})
    batches = list(reader.read(recordings.Range([(f"{folder}/{i}.pcm", i, 10 * i, 0, 4) for i in range(20)])))
    assert [b.num_rows for b in batches] == [40]
    assert [tuple(r.values()) for r in batches[0].to_pylist()] == [r for i in range(20) for r in ((i, 0, 10 * i, i), (i, 0, 10 * i + 1, -i))]


def test_a_folder_without_a_whole_block_has_no_rows(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    os.makedirs(f"{folder}/1")
    with open(f"{folder}/1/{0:015d}.pcm", "wb") as f:
        f.write(bytes(2 * BLOCK - 2))
    assert recordings.read_pcm_ranges(spark, folder, 16, 1, BLOCK).count() == 0


def test_files_are_as_many_as_clips(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    spark.range(3000).selectExpr("id % 3 AS l_suppkey", "id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "1.0D AS l_extendedprice",
                                 "CAST(id % 50 AS DOUBLE) AS l_quantity").write.parquet(f"{folder}/lineitem.parquet")
    out = catalog.pcm_folder(spark, folder, "samples", 16, 1)
    assert sorted(os.listdir(out)) == ["0", "1", "2", recordings.MANIFEST] and all(len(os.listdir(f"{out}/{c}")) == 1 for c in range(3))
    assert recordings.read_pcm_ranges(spark, out, 16, 1, block=1).count() == 3000


def test_slices_are_decoded_some_at_a_time(spark, monkeypatch):
    data = samples_of({c: 5 * BLOCK + c for c in range(6)}, 2, 24)
    payloads = spark.createDataFrame([(c, bytearray(raw_bytes(v, 24))) for c, v in data.items()], "clip_id long, payload binary").coalesce(1)
    want = sorted(map(tuple, read_pcm(payloads, 24, 2, BLOCK, 1).collect()))
    monkeypatch.setattr(binary, "DECODE_BYTES", 2 * BLOCK * 6)
    monkeypatch.setattr(binary, "decode_pcm", lambda raw, width, f=binary.decode_pcm: f(raw, width) if len(raw) <= 2 * BLOCK * 6 else None)
    assert sorted(map(tuple, read_pcm(payloads, 24, 2, BLOCK, 1).collect())) == want and len(want) == 6 * 5 * BLOCK * 2


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_written_recordings_read_back(spark, bits):
    folder = tempfile.mkdtemp(prefix="run-")
    data = samples_of({1: 70, 2: 9, 30: 1}, 2, bits)
    rows = [(clip, ch, n, int(v)) for clip, values in data.items() for n, row in enumerate(values) for ch, v in enumerate(row)]
    df = spark.createDataFrame(rows, "clip_id long, ch int, n long, ival int").repartition(5)
    manifest = recordings.write_pcm(df, folder, bits, BLOCK, blocks_per_file=2).collect()
    assert sorted(map(tuple, recordings.read_pcm_ranges(spark, folder, bits, 2, block=1).collect())) == sorted(rows)
    assert sum(r["rows"] for r in manifest) == len(rows) and len(manifest) == 5 + 1 + 1
    assert all(os.path.getsize(r["path"]) == r["rows"] * bits // 8 for r in manifest)


def test_options_are_checked(spark):
    with pytest.raises(ValueError, match="bits"):
        recordings.write_pcm(spark.createDataFrame([], "clip_id long, ch int, n long, ival int"), "/tmp/none", 12)
    with pytest.raises(ValueError, match="bits"):
        recordings.PcmReader({"path": "x", "bits": "8"})


def test_listed_rows_are_those_of_the_commit(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    df = spark.range(1000).select((F.col("id") % 7).alias("clip_id"), "id", F.lit("kept").alias("path"))
    df = df.withColumn("clip_id", F.when(F.col("clip_id") == 6, None).otherwise(F.col("clip_id")))
    first = recordings.write_listed(df, folder)
    assert {(r["key"], r["rows"]) for r in first.groupBy("key").agg(F.sum("rows").alias("rows")).collect()} == {
        *[(str(c), 143) for c in range(6)], ("", 142)}
    assert sorted(map(tuple, recordings.read_listed(spark, folder, df.schema).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert recordings.write_listed(df.limit(0), folder).count() == 0  # an empty write lists nothing
    recordings.write_listed(df.where("id < 10"), folder)
    assert recordings.read_listed(spark, folder, df.schema).count() == 1010
    assert recordings.read_listed(spark, tempfile.mkdtemp(prefix="run-"), df.schema).count() == 0


def test_a_failing_task_lists_nothing(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    bad = spark.range(200).select((F.col("id") % 3).alias("clip_id"), F.expr("IF(id = 150, raise_error('broken'), id)").cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        recordings.write_listed(bad, folder)
    assert recordings.read_listed(spark, folder, "clip_id long, id long").count() == 0
    assert not [f for _, _, files in os.walk(folder) for f in files if f.endswith(".parquet")]
