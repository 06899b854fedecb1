import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from cliploom.operators import audio, grouped


def test_groups_are_whole_over_batch_borders(spark):
    """Groups longer and shorter than a record batch; a null key is a group of its own."""
    sizes = {0: 1, 1: 700, 2: 3, 3: 250, None: 40}
    rows = [(k, i) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long").repartition(7, "i")

    def total(table: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        i = table.column("i").to_numpy()
        assert all((np.diff(i[a:b]) == 1).all() for a, b in zip(ends, ends[1:]))
        return pa.RecordBatch.from_arrays(
            [table.column("k").combine_chunks().take(pa.array(ends[:-1])), pa.array(np.diff(ends))], names=["k", "n"])

    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = sorted((tuple(r) for r in grouped.map_groups(df, ["k"], ["i"], total, "k long, n long").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert got == sorted(sizes.items(), key=str)


def test_frames_by_length_are_those_of_the_spectra(spark):
    rows = [(clip, 0, n, 0.5) for clip, length in ((1, 1), (2, 7), (3, 8), (4, 9), (5, 400), (None, 20)) for n in range(length)]
    df = spark.createDataFrame(rows, "clip_id long, ch int, n long, v double")
    want = {tuple(r) for r in audio.spectra(df, 16, 8, frames_per_chunk=4).select("clip_id", "ch", "t").collect()}
    assert {tuple(r) for r in audio.frame_numbers(df, 16, 8).collect()} == want


def test_work_on_many_small_groups_shares_calls(spark):
    """Small chunks go to Python by the batch, not one by one; a null value stays null, and a failing chunk takes its channel back."""
    rows = [(clip, 0, t, None if t == 5 else float(t)) for clip in (1, 2, None) for t in range(50)]
    df = spark.createDataFrame(rows, "clip_id long, ch int, t long, v double")

    def model(pdf: pd.DataFrame) -> pd.Series:
        assert pdf["t"].is_monotonic_increasing and list(pdf.index) == list(range(len(pdf)))
        if pdf["clip_id"].iloc[0] == 2 and pdf["t"].max() > 45:
            raise ValueError
        return pdf["v"] * 2

    out = audio.score_chunks(df, model, chunk=10, warmup=3)
    got = {(r.clip_id, r.t): (r.v, r.failed_chunks) for r in out.collect()}
    assert got == {(c, t): (None if v is None else v if c == 2 else 2 * v, 1 if c == 2 else 0) for c, _, t, v in rows}
    for done in (out, audio.spectra(df.withColumnRenamed("t", "n").withColumn("v", F.lit(0.5)), 16, 8)):
        assert "FlatMapGroupsInPandas" not in done._jdf.queryExecution().toString()


def test_filtering_meets_controls_without_a_join(spark):
    """Controls are exploded from a few rows; as a side of a join they'd be taken for small and broadcast whole."""
    rng = np.random.default_rng(3)
    widths, low, length = (1, 2, 2, 4), 4, 2 * (1 << audio.NEIGHBOUR_BITS) * 8 + 50
    clips = [(1, 0, n, float(v)) for n, v in enumerate(rng.uniform(-1, 1, length))] + [(2, 0, n, 0.5) for n in range(20)] + [(None, 0, 0, 0.5)]
    clip = spark.createDataFrame(clips, "clip_id long, ch int, n long, v double")
    spec, t = audio.spectra(clip, 16, 8), F.col("t")
    lists = {"gain": (len(widths), (t % 7) / 4), "cre": (low * 5, (t % 3 - 1) / 2), "cim": (low * 5, (t % 5 - 2) / 3)}
    controls = audio.frame_numbers(clip, 16, 8).where("t % 50 <> 3").select("clip_id", "ch", "t", *[
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i, v=v: v + i / 8).alias(c) for c, (n, v) in lists.items()])
    twice = controls.unionByName(controls.where("t = 10").withColumn("gain", F.transform("gain", lambda g: g / 2)))
    out = audio.filter_spectra(spec, twice, widths, low, post_filter=False)
    got = sorted((r.clip_id, r.t, r.re, r.im) for r in out.collect())
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()

    known = {(r.clip_id, r.t): np.array(r.re) + 1j * np.array(r.im) for r in spec.collect()}
    want = []
    for r in twice.where("clip_id IS NOT NULL").collect():
        taps = (np.array(r.cre) + 1j * np.array(r.cim)).reshape(low, 5)
        value = known[r.clip_id, r.t] * np.repeat(r.gain, widths)
        value[:low] = sum(known.get((r.clip_id, r.t + o - 2), np.zeros(9))[:low] * taps[:, o] for o in range(5))
        want.append((r.clip_id, r.t, value.real.tolist(), value.imag.tolist()))
    want.sort()
    assert [x[:2] for x in got] == [x[:2] for x in want] and len({x[:2] for x in got}) == len(got) - 1
    np.testing.assert_allclose([x[2] for x in got], [x[2] for x in want], atol=1e-12)
    np.testing.assert_allclose([x[3] for x in got], [x[3] for x in want], atol=1e-12)
