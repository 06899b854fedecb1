import numpy as np
import pytest

from cliploom.llm import retrieval


def brute(rows, k, every):
    ok = [(i, np.floor(64.0 * np.array(v, float)).astype(np.int64)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        mine = min((v.tolist() for i, v in ok if i == q))
        scores = sorted((-int(np.dot(mine, v)), i) for i, v in ok if i != q and len(v) == len(mine))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def run(spark, rows, k=5, every=10):
    df = spark.createDataFrame(rows, "frame_id long, bands array<double>").selectExpr("*", "0 AS rank", "1.0 AS score", "2 AS part")
    return sorted((r["query_id"], r["rank"], r["frame_id"], r["score"]) for r in retrieval.top_products(df, k, every).collect())


@pytest.mark.parametrize(("seeds", "block", "cosine"), [(4096, 2048, 0.5), (10, 16, 0.0), (6, 7, 2.0), (3, 5, 0.3)])
def test_same_as_brute_force(spark, monkeypatch, seeds, block, cosine):
    monkeypatch.setattr(retrieval, "SEEDS", seeds)
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "COSINE", cosine)
    rng = np.random.default_rng(seeds)
    v = rng.normal(size=(150, 12)) * np.exp(rng.normal(size=(150, 1)) * 1.5)
    v[20:40] = v[20]  # ties
    v[41] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(10, v[3].tolist()), (10, v[3].tolist()), (300, None), (310, [float("nan")] * 12), (320, [None] * 12),
             (330, [float("inf")] * 12), (None, v[1].tolist()), (400, []), (410, []), (-10, v[5].tolist()), (500, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows, 5, 10)


def test_large_numbers_and_few_candidates(spark):
    rows = [(0, [3e7, -2.5]), (1, [2e7, 0.1]), (2, [-1e7, 5.0])]
    assert run(spark, rows) == brute(rows, 5, 10)
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []
