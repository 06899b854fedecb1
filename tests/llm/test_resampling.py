"""Importance resampling against a plain version."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cliploom.llm import resampling
from tests.llm.brute import words

SCHEMA = "doc_id long, text string"


def grams(text, longest):
    w = words(text)
    return [" ".join(w[i : i + m]).encode() for m in range(1, longest + 1) for i in range(len(w) - m + 1)]


def brute(docs, target, longest=2, buckets=10_000, least=20, percent=25, seed=7):
    bucket = lambda g: zlib.crc32(g) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text, longest)))
    for text in target:
        t.update(map(bucket, grams(text, longest)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, text in docs:
        f = [gain(bucket(g)) for g in grams(text, longest)]
        weight = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    ready = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for n, r in enumerate(ready[: len(ready) * percent // 100]):
        r[5] = n + 1
    return sorted(map(tuple, rows), key=str)


def run(spark, docs, target, **options):
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS row", "'x' AS lines", "2.0 AS score", "3 AS rank", "4 AS n")
    aims = spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "'y' AS doc_id", "1 AS held")
    out = resampling.resample(df, aims, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in out), key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "x1", "d'or", "naïve", "中文", "zeta", "eta-theta", "99"]
    line = "This line stands in many documents, as licences do."
    docs = []
    for i in range(n):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 30]))) for _ in range(rng.randint(0, 6))]
        docs.append((i, "\n".join([*parts, line] if i % 3 else parts)))
    return docs + [(500, None), (501, ""), (502, "\n\n \r\n"), (503, "!!\none\n\n--\ntwo three\n"), (7, "again " * 25), (7, "again " * 25),
                   (None, "no id " * 15), (504, "long\n" * 9000), (505, "word " * 30_000)]


@pytest.mark.parametrize(("longest", "buckets", "hot"), [(2, 10_000, 4096), (1, 50, 3), (4, 70_000, 10**9)])
def test_same_as_plain_version(spark, monkeypatch, longest, buckets, hot):
    monkeypatch.setattr(resampling, "HOT", hot)
    docs, target = corpus(longest), ["alpha beta\nGamma zeta alpha", None, "", "naïve 中文 x1"]
    assert run(spark, docs, target, longest=longest, buckets=buckets) == brute(docs, target, longest, buckets)


def test_shares_and_least_words(spark):
    docs = corpus(9, 60)
    for percent in (0, 100):
        assert run(spark, docs, ["zeta"], percent=percent, least_words=3) == brute(docs, ["zeta"], percent=percent, least=3)
    assert run(spark, docs, [], seed=8) == brute(docs, [], seed=8)
    assert run(spark, [], ["zeta"]) == []
    with pytest.raises(ValueError, match="share"):
        run(spark, docs, [], percent=101)


def test_draw_follows_the_target(spark):
    """Documents in the words of the target are drawn far more often than the rest."""
    rng = random.Random(3)
    text = lambda v: " ".join(rng.choice(v) for _ in range(40))
    own, other = [f"near{i}" for i in range(30)], [f"far{i}" for i in range(300)]
    docs = [(i, text(own if i < 50 else other)) for i in range(400)]
    drawn = [r for r in run(spark, docs, [text(own) for _ in range(20)], percent=12) if r[5] is not None]
    near = sum(r[0] < 50 for r in drawn)
    assert len(drawn) == 48 and near / 50 > 4 * (48 - near) / 350


def test_grams_and_gains_by_hand():
    first, size, bucket = resampling.gram_buckets([b"a", b"b", b"c"], np.array([0, 0, 1]), 2, 1000)
    assert first.tolist() == [0, 1, 2, 0] and size.tolist() == [1, 1, 1, 2]
    assert bucket.tolist() == [zlib.crc32(g) % 1000 for g in (b"a", b"b", b"c", b"a b")]
    gains = resampling.bucket_gains(np.array([3, 0]), np.array([0, 1]))
    assert gains.tolist() == [math.floor(1000 * math.log(1 * 5 / (4 * 3))), math.floor(1000 * math.log(2 * 5 / (1 * 3)))]
