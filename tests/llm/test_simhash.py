import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import common, simhash
from tests.llm import brute


def test_fingerprint_by_definition():
    for text in ["", " \t\n", "One", "a b c", "A b C d", "x y z w v " * 40, "ä ö\xa0ü b c", "a  b\tc\nd e"]:
        assert simhash.fingerprint(text.encode()) == brute.fingerprint(text)


def test_components_same_as_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    prints = {}
    for i in range(400):
        p = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            p ^= 1 << rng.randrange(64)
        prints[1000 - 2 * i] = p
    rows = [(int(np.uint64(p).view(np.int64)), i) for i, p in prints.items()]
    distinct = spark.createDataFrame(rows, "fingerprint long, node long").groupBy("fingerprint").agg({"node": "min"}).toDF("fingerprint", "node")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(distinct)).collect()}
    want = brute.components(prints)
    assert all(found.get(i, i) == want[i] for i in {r["node"] for r in distinct.collect()})


def test_crowded_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "SMALL", 4)
    rng = random.Random(3)
    prints = {i: (1 << rng.randrange(64)) | (1 << rng.randrange(64)) | (1 << rng.randrange(64)) for i in range(120)}
    rows = {int(np.uint64(p).view(np.int64)): i for i, p in sorted(prints.items(), reverse=True)}
    distinct = spark.createDataFrame(list(rows.items()), "fingerprint long, node long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(distinct)).collect()}
    want = brute.components({i: prints[i] for i in rows.values()})
    assert {i: found.get(i, i) for i in rows.values()} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 900), (700, 900)], "a long, b long")
    found = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 700: 500, 900: 500}


def test_documents(spark):
    text = " ".join(f"word{i}" for i in range(300))
    docs = [(5, text), (3, text), (9, text.replace("word7 ", "other ")), (1, None), (2, " "), (4, "quite another text of few words"),
            (None, "lonely"), (None, text), (4, "quite another text of few words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS fingerprint", "1 AS node")
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    got = {(r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert got >= {(5, 3), (3, 3), (1, 1), (2, 1), (4, 4)}
    assert ((9, 3) in got) == (bin(brute.fingerprint(text) ^ brute.fingerprint(docs[2][1])).count("1") <= 4)
    assert sorted(r["component_id"] is None for r in rows if r["doc_id"] is None) == [False, True]
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.representatives(df).collect()), key=repr)
    assert [i for i, _ in kept if i is not None].count(4) == 1
    assert {i for i, _ in kept} >= {1, 3, 4, None} and not {i for i, _ in kept} & {2, 5}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.representatives(empty).count() == 0


def test_radius_beyond_the_grid(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fingerprint long, node long"), 5)


def test_what_scans_make_is_not_broadcast(spark, monkeypatch):
    """Each fingerprint makes 70 rows, which are not in any file; so a broadcast is never planned, however small the files."""
    plans = {}
    plan = lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()})
    write = simhash.shared_table
    monkeypatch.setattr(simhash, "shared_table", lambda df, name: plan(df, name) or write(df, name))
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", k=12)) for _ in range(40)]
    docs = write(spark.createDataFrame([(i, texts[i % 40]) for i in range(60)], "doc_id long, text string"), "documents")
    found = simhash.near_duplicates(docs)
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found.collect()}
    kept = simhash.smallest_of_each(docs, found)
    plan(kept, "kept rows")
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in rows.values()}
    want = brute.components({i: brute.fingerprint(texts[i % 40]) for i in range(60)})
    assert {i: c for i, (_, c) in rows.items()} == want
    assert all("SortMergeJoin" in plans[n] and "Broadcast" not in plans[n] for n in ("links", "kept rows"))


def test_written_tables_leave_the_session_as_it_is(spark):
    for value in (None, "false"):
        spark.conf.unset(common.CLEANUP) if value is None else spark.conf.set(common.CLEANUP, value)
        table = common.shared_table(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
        assert spark.conf.get(common.CLEANUP, None) == value and table.join(table.withColumnRenamed("count", "n"), "k").count() == 7
    spark.conf.unset(common.CLEANUP)
