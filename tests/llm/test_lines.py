import random
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from cliploom.llm import lines
from tests.llm import brute

LONG = "this line is quite long enough to count as shared text"


def kept(df, bitmaps):
    return {(r["doc_id"], r["old"]): r["text"] or "" for r in lines.apply_bitmaps(df.selectExpr("*", "text AS old"), bitmaps).collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_same_as_brute_force(spark, parts):
    rng = random.Random(parts)
    pool = [f"{LONG} {i}" for i in range(12)] + [f"  {LONG.upper()} 3\t", "short", "", f"{LONG} 3"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    docs += [(None, f"{LONG} 3\n{LONG} 4"), (99, None), (8, f"{LONG} 5\nother")] + [(7, docs[7][1])] * 40
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = kept(df, lines.keep_bitmaps(df))
    assert got == {(i, t): brute.drop_lines(docs)[(i, t)] for i, t in docs}


@pytest.mark.parametrize("cuts", [[], [40], [1, 2, 3, 50, 51, 90], list(range(0, 120, 2))])
def test_ranges_and_batches_may_cut_a_hash(spark, cuts):
    """The stream gives the same lines wherever ranges and batches end inside runs of one hash."""
    rows = sorted([(h, h, -d, d % 3, p) for h in range(3) for d in range(2 + 18 * h) for p in range(2)])
    cols = list(zip(*rows, strict=True))
    whole = pa.record_batch([
        pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([-x for x in cols[2]], pa.int64()),
        pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array([9] * len(rows), pa.int32())],
        names=["h1", "h2", "doc_id", "text_key", "pos", "n_lines"])
    # a document of one hash lies in one range, as range partitioning on (hash, document) gives it
    edges = sorted({0, len(rows), *[c - c % 2 for c in cuts if c < len(rows)]})
    marks = []
    for a, b in zip(edges, edges[1:], strict=False):
        batches = [whole.slice(i, min(3, b - i)) for i in range(a, b, 3)]
        marks += [r for out in lines._stream(iter(batches), 5) for r in out.to_pylist()]
    total, newest = {}, {}
    for r in marks:
        if r["kind"] == lines.TOTAL:
            total[r["h1"]] = total.get(r["h1"], 0) + r["n_docs"]
            newest[r["h1"]] = max(newest.get(r["h1"], -1), r["doc_id"])
    got = {(r["h1"], r["doc_id"], r["pos"]) for r in marks if r["kind"] == lines.DROP} | {
        (r["h1"], r["doc_id"], r["pos"]) for r in marks
        if r["kind"] == lines.WAIT and total[r["h1"]] >= 5 and r["doc_id"] != newest[r["h1"]]}
    n = {h: 2 + 18 * h for h in range(3)}
    assert got == {(h, d, p) for h in range(3) for d in range(n[h]) for p in range(2) if n[h] >= 5 and d != n[h] - 1}


def test_bitmap_holds_one_bit_per_line(spark):
    df = spark.createDataFrame([(i, f"a\n{LONG}\nb") for i in range(5)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lines.keep_bitmaps(df).collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    assert np.unpackbits(np.frombuffer(zlib.decompress(rows[0]["keep"]), np.uint8))[:3].tolist() == [1, 0, 1]
    assert (rows[0]["n_lines"], rows[0]["n_dropped"]) == (3, 1)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.apply_bitmaps(empty, lines.keep_bitmaps(empty)).count() == 0
    df = spark.createDataFrame([(i, f"{LONG}\nx", "k", 7, None) for i in range(6)],
                               "doc_id long, text string, key string, n_lines int, keep string")
    out = lines.apply_bitmaps(df, lines.keep_bitmaps(df)).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["x"] * 5 + [f"{LONG}\nx"]
    assert out[0]["key"] == "k" and out[0]["n_lines"] == 2
    assert partial(brute.drop_lines)([(i, f"{LONG}\nx") for i in range(6)])[(0, f"{LONG}\nx")] == "x"
