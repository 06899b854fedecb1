import math
import random
import re

import numpy as np
import pytest

from cliploom.llm import toxicity

BAD = ["idiot", "moron", "scum", "ID10T,", "trash!"]


def documents(n, seed=0):
    rng = random.Random(seed)
    words = [f"wort{i}" for i in range(60)] + ["you", "are", "Du", "und"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD[:3]) if rng.random() < 0.5 else f"lowei{rng.randint(0, 400)}")
        rows.append((i, " ".join(text), toxic))
    return rows


def test_learns_words_and_beginnings(spark):
    rows = documents(1500)
    docs = spark.createDataFrame([(i, t, "u") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (9999, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_documents(docs, labels)
    assert {"idiot", "moron", "scum"} <= model.words and "lowei" in model.prefixes
    out = model.score(docs).withColumn("held", toxicity.held_out()).toPandas().merge(labels.toPandas().dropna(), on="doc_id")
    held = out[out["held"]]
    assert len(held) > 200 and ((held["score"] >= 0.5) == (held["toxic"] == 1)).mean() > 0.95
    assert out["score"].between(0, 1).all() and set(out.columns) == {"doc_id", "text", "score", "held", "toxic"}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, ""), (1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.fit_documents(docs, none).score(docs).collect()] == [0.0] * 4
    ones = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.fit_documents(docs, ones).score(docs).collect()} <= {0.0, 1.0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.fit_documents(empty, ones).score(empty).count() == 0


def test_features():
    reader = toxicity.Reader(frozenset({"idiot"}), frozenset({"lowei"}))
    name = {n: i for i, n in enumerate(toxicity.FEATURES)}
    plain, near, far = (reader.features(t) for t in ("some calm words", "you IDIOT!!", "you " + "a " * 30 + "idiot"))
    assert not plain[: name["near_second"] + 1].any()
    assert near[name["near_second"]] > 0 == far[name["near_second"]] and near[name["shout_rate"]] > 0 and near[name["exclaim_rate"]] > 0
    assert reader.features("loweischaft")[name["prefix_count"]] > 0
    assert reader.features("1d1ot id1ot idiooooot")[name["hidden_rate"]] > 0
    for text in ("", " \n", "!!!", "a" * 300_000, "x " * 100_000):
        assert np.isfinite(reader.features(text)).all()


def test_second_reading_comes_from_the_cache():
    reader = toxicity.Reader(frozenset({"idiot"}), frozenset())
    assert (reader.features("An idiot, you!") == reader.features("An idiot, you!")).all()


def plain_features(text, words, prefixes):
    """Every feature by a loop over the text's words."""
    bare = lambda t: re.sub(r"^\W+|\W+$", "", t).lower()
    known = lambda w: w in words
    begins = lambda w: any(w[:n] in prefixes for n in (4, 5, 6) if len(w) >= n)
    n = hits = pre = hidden = shout = mixed = stretched = 0
    bad, you = [], []
    for at, token in enumerate(text.split()):
        w = bare(token)
        if not w:
            continue
        n += 1
        hit, start, hide = known(w), begins(w), False
        plain = re.sub(r"[\W_]", "", token.lower().translate(toxicity.DISGUISE))
        short = re.sub(r"(\w)\1{2,}", r"\1", w)
        if not hit and (plain != w and known(plain) or short != w and known(short)):
            hide = True
        hits, pre, hidden = hits + hit, pre + start, hidden + hide
        if hit or start or hide:
            bad.append(at)
        if w in toxicity.SECOND:
            you.append(at)
        stretched += short != w
        shout += len(w) > 1 and token.isupper()
        mixed += bool(re.search(r"[^\W\d][^\w\s'’.,-]+[^\W\d]|[^\W\d_]\d|\d[^\W\d_]", token))
    near = sum(any(abs(b - y) <= toxicity.NEAR for y in you) for b in bad)
    size, n1 = max(1, len(text.encode())), max(1, n)
    rate = lambda signs: sum(text.count(c) for c in signs) / size
    signs = [chr(c) for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))]
    capitals = [chr(c) for c in range(65, 91)]
    return [hits / n1, math.log1p(hits), pre / n1, math.log1p(pre), hidden / n1, near / n1, len(you) / n1, rate(capitals), shout / n1, rate("!"), rate("?"),
            rate(signs), rate("*#$@"), mixed / n1, stretched / n1, math.log1p(n1), size / n1]


def test_features_equal_a_plain_loop():
    rng = random.Random(6)
    words, prefixes = frozenset(["idiot", "moron", "scum"]), frozenset(["lowe", "tras", "garbag"])
    pieces = ["idiot", "IDIOT!!", "1d10t", "iiiidiot", "id-iot", "m0ron,", "lowei7", "trash", "garbages", "you", "Du", "your", "--", "ok", "A", "a*b", "x9", "Ünd", "日本", "soooo"]
    reader = toxicity.Reader(words, prefixes)
    for _ in range(2):  # the second time from the cache
        for n in (0, 1, 2, 5, 40):
            for _ in range(40):
                text = " ".join(rng.choice(pieces) for _ in range(n))
                assert np.allclose(reader.features(text), plain_features(text, words, prefixes), atol=1e-12), text


def test_lexicon_equals_plain_counts(spark):
    rows = documents(400, 2)
    total, toxic = len(rows), sum(y for _, _, y in rows)
    held = {}
    for _, text, y in rows:
        words = {w for w in map(toxicity._bare, text.split()) if 1 < len(w) <= toxicity.LONG_WORD}
        for term in words | {"^" + w[:n] for w in words for n in toxicity.PREFIXES if len(w) >= n}:
            n, t = held.get(term, (0, 0))
            held[term] = n + 1, t + y
    rate = toxic / total
    side = lambda k, p, q: k * math.log(p / q) if k else 0.0
    evidence = {w: 2 * (side(t, t / n, rate) + side(n - t, 1 - t / n, 1 - rate)) for w, (n, t) in held.items() if t / n > max(0.5, rate)}
    strong = sorted((w for w, e in evidence.items() if e >= toxicity.EVIDENCE), key=lambda w: (-evidence[w], w))
    df = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int")
    for most in (4000, 3):
        words, prefixes = toxicity.learn_lexicon(df, "text", "toxic", most)
        assert words == {w for w in strong[:most] if w[0] != "^"} and prefixes == {w[1:] for w in strong[:most] if w[0] == "^"}
    assert len(strong) > 3


def test_calibration_is_pool_adjacent_violators(spark):
    """The steps of a fitted model against the textbook algorithm on the same raw scores."""
    rng = random.Random(1)
    points = sorted((round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(200))
    merged = {}
    for x, y in points:
        n, s = merged.get(x, (0, 0))
        merged[x] = n + 1, s + y
    pools = []
    for x, (n, s) in sorted(merged.items()):
        pools.append([s, n, x, x])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], high]
    from pyspark.ml.regression import IsotonicRegression

    df = spark.createDataFrame([(x, float(y)) for x, y in points], "__raw double, label double")
    steps = IsotonicRegression(featuresCol="__raw", labelCol="label", predictionCol="__step").fit(df)
    got = {r["__raw"]: r["__step"] for r in steps.transform(df).collect()}
    assert got == pytest.approx({x: s / n for s, n, low, high in pools for x in merged if low <= x <= high})
