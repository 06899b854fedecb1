import random

from pyspark.sql import functions as F

from cliploom.llm import contamination
from tests.llm import brute


def found(spark, docs, items, extra=False):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    if extra:
        d = d.withColumns({c: F.lit("x") for c in ("words", "item_id", "start", "k", "text_key")})
        b = b.withColumns({c: F.lit("x") for c in ("words", "doc_id", "n")})
    out = contamination.contaminated_words(d, b).withColumn("n_hit", contamination.hit_words(F.col("hits")))
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out.collect()), key=repr)


def test_same_as_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["tä", "a", "b", "C", "d1", "ee", "日本", "f", "g", "h"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 7, 10, 11, 14])))) for i in range(14)]
    items += [(90, ""), (91, None), (92, items[5][1]), (None, "a b"), (10, "!!!")]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary[:6]) for _ in range(rng.randint(0, 30))]
        if i % 3 == 0:
            words[len(words) // 2 : 0] = rng.choice(items)[1].upper().split() if rng.choice(items)[1] else []
        docs.append((i, ", ".join(words)))
    docs = [(i, t) for i, t in docs] + [(100, None), (None, "a b c"), (3, docs[3][1]), (3, docs[3][1]), (4, "other text")]
    docs = [(i, t) for i, t in docs]
    clean = [(i, t) for i, t in items if i is not None]
    for extra in (False, True):
        assert found(spark, docs, items, extra) == sorted(brute.contamination(docs, clean), key=repr)


def test_items_of_null_text_do_not_fail(spark):
    assert found(spark, [(1, "a b")], [(1, None), (2, "")]) == [(1, 2, 0, ())]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c")]) == []
    assert found(spark, [(1, "a b c"), (2, None)], []) == [(1, 3, 0, ()), (2, 0, 0, ())]


def test_long_text_and_repeated_passage(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    text = ("x " * 5000 + passage + " ") * 4
    assert found(spark, [(1, text)], [(7, passage)]) == [(1, 4 * 5012, 48, ("7",))]


def test_long_run(spark):
    """A document that quotes an item of 30,000 words is one run."""
    item = " ".join(f"w{i}" for i in range(30_000))
    docs = [(1, "before " + item + " after"), (2, item), (3, " ".join(item.split()[100:109])), (4, " ".join(item.split()[100:110]))]
    assert found(spark, docs, [(7, item)]) == [(1, 30_002, 30_000, ("7",)), (2, 30_000, 30_000, ("7",)), (3, 9, 0, ()), (4, 10, 10, ("7",))]


def test_saturated_filter(spark):
    """A filter of 64 bits lets nearly every word through: runs are whole texts, and the result is the same."""
    rng = random.Random(2)
    items = [(i, " ".join(f"v{rng.randrange(60)}" for _ in range(rng.choice([4, 12])))) for i in range(40)]
    docs = [(i, " ".join(f"v{rng.randrange(60)}" for _ in range(3000)) + " " + items[i][1]) for i in range(6)]
    d, b = (spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id")))
    out = contamination.contaminated_words(d, b, bits=6).withColumn("n_hit", contamination.hit_words(F.col("hits")))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out.collect()), key=repr)
    assert got == sorted(brute.contamination(docs, items), key=repr)


def test_filter_follows_the_number_of_shingles():
    assert contamination.filter_bits(0) == 16 and contamination.filter_bits(10**6) == 24 and contamination.filter_bits(10**10) == 28


def test_what_scans_make_is_not_broadcast(spark, monkeypatch):
    """Runs and their shingles are made by scans, of which no file tells; so no broadcast is planned, however small the files."""
    plans = {}
    plan = lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()})
    write = contamination.shared_table
    monkeypatch.setattr(contamination, "shared_table", lambda df, name: plan(df, name) or write(df, name))
    passage = " ".join(f"w{i}" for i in range(15))
    rows, texts = [(i, f"x{i} {passage if i % 3 else ''} y") for i in range(30)], [(7, passage), (8, "c d")]
    docs = write(spark.createDataFrame(rows, "doc_id long, text string"), "documents")
    items = write(spark.createDataFrame(texts, "item_id long, text string"), "benchmark")
    out = contamination.contaminated_words(docs, items)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out.withColumn("n_hit", contamination.hit_words(F.col("hits"))).collect()]
    assert sorted(got) == sorted(brute.contamination(rows, texts))
    runs = plans["found-runs"]
    assert "SortMergeJoin" in runs and not any("posexplode" in b or "MapInArrow" in b for b in runs.split("BroadcastExchange")[1:])
