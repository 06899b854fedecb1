"""Toxicity scores of texts.

The recorder that this library follows keeps no text, so the operator is general: it works on any table
of texts and any table of labelled texts.

Method: gradient-boosted trees over dense features, with isotonic calibration.  The features are densities
of a lexicon (words and word beginnings), how near its words stand to the second person, rates of
capitals, punctuation and obfuscation, and length.  The lexicon is learned from labelled texts: terms
whose share of toxic texts is far above the general one (likelihood ratio).  Texts are read once.

The model is fitted on a sample of at most about ``max_rows`` labelled rows, three quarters of them for lexicon and trees,
one quarter for the calibration.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import bounded_sample, shared_table

MAX_ROWS = 20_000
MAX_TERMS = 4_000  # size of the lexicon, a parameter of the model
EVIDENCE = 20.0  # least likelihood ratio (2 ln) of a term
PREFIXES = (4, 5, 6)
NEAR = 5  # words between a lexicon word and the second person
BLEND = 0.01  # share of the uncalibrated probability, which orders texts within a step of the calibration
CACHE_WORDS = 400_000
LONG_WORD = 64
FEATURES = (
    "lexicon_rate", "lexicon_count", "prefix_rate", "prefix_count", "hidden_rate", "near_second", "second_rate",
    "capital_rate", "shout_rate", "exclaim_rate", "question_rate", "punctuation_rate", "mask_rate", "mixed_rate",
    "stretched_rate", "log_words", "word_length")
#: Second-person words of the larger European languages (fixed values).
SECOND = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch tu te toi ton ta tes vous votre vos "
    "tú ti tuyo usted ustedes vosotros os".split())  # fmt: skip
#: Characters that stand for letters in disguised words (fixed values).
DISGUISE = str.maketrans("0134578@$!", "oieastbasi")
WORD, HIT, PREFIX, HIDDEN, YOU, SHOUT, MIXED, STRETCHED = 1, 2, 4, 8, 16, 32, 64, 128
EDGES = re.compile(r"^\W+|\W+$")
STRETCH = re.compile(r"(\w)\1{2,}")


def _bare(token: str) -> str:
    return EDGES.sub("", token).lower()


class Reader:
    """Features of a text under one lexicon; what is known of a token is kept in a bounded cache."""

    def __init__(self, words: frozenset[str], prefixes: frozenset[str]):
        self.words, self.prefixes = words, prefixes
        self.cache: dict[str, int] = {}

    def _known(self, word: str) -> int:
        found = HIT if word in self.words else 0
        return found | (PREFIX if any(word[:n] in self.prefixes for n in PREFIXES if len(word) >= n) else 0)

    def _code(self, token: str) -> int:
        word = _bare(token)
        if not word:
            return 0
        code = WORD | self._known(word)
        if not code & HIT:
            plain = re.sub(r"[\W_]", "", token.lower().translate(DISGUISE))
            if plain != word and self._known(plain) & HIT:
                code |= HIDDEN
        if STRETCH.search(word):
            code |= STRETCHED
            if not code & HIT and self._known(STRETCH.sub(r"\1", word)) & HIT:
                code |= HIDDEN
        if word in SECOND:
            code |= YOU
        if len(word) > 1 and token.isupper():
            code |= SHOUT
        if re.search(r"[^\W\d][^\w\s'’.,-]+[^\W\d]|[^\W\d_]\d|\d[^\W\d_]", token):
            code |= MIXED
        return code

    def codes(self, text: str) -> np.ndarray:
        tokens = text.split()
        try:
            return np.array([*map(self.cache.__getitem__, tokens)], np.uint8)
        except KeyError:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            out = []
            for token in tokens:
                code = self.cache.get(token)
                if code is None:
                    code = self._code(token)
                    if len(token) <= LONG_WORD:
                        self.cache[token] = code
                out.append(code)
            return np.array(out, np.uint8)

    def features(self, text: str) -> np.ndarray:
        codes = self.codes(text)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        letters = np.bincount(raw, minlength=256)
        n, size = max(1, int((codes & WORD).astype(bool).sum())), max(1, len(raw))
        has = {bit: (codes & bit).astype(bool) for bit in (HIT, PREFIX, HIDDEN, YOU, SHOUT, MIXED, STRETCHED)}
        bad = np.flatnonzero(has[HIT] | has[PREFIX] | has[HIDDEN])
        you = np.flatnonzero(has[YOU])
        near = 0
        if len(bad) and len(you):
            right = np.searchsorted(you, bad)
            gap = np.minimum(np.abs(bad - you[np.maximum(right - 1, 0)]), np.abs(you[np.minimum(right, len(you) - 1)] - bad))
            near = int((gap <= NEAR).sum())
        count = {bit: float(v.sum()) for bit, v in has.items()}
        signs = letters[33:48].sum() + letters[58:65].sum() + letters[91:97].sum() + letters[123:127].sum()
        return np.array([
            count[HIT] / n, np.log1p(count[HIT]), count[PREFIX] / n, np.log1p(count[PREFIX]), count[HIDDEN] / n, near / n,
            count[YOU] / n, letters[65:91].sum() / size, count[SHOUT] / n, letters[33] / size, letters[63] / size, signs / size,
            (letters[42] + letters[35] + letters[36] + letters[64]) / size, count[MIXED] / n, count[STRETCHED] / n, np.log1p(n),
            size / n])


def with_features(texts: DataFrame, column: str, words: frozenset[str], prefixes: frozenset[str]) -> DataFrame:
    """``texts`` with ``__features``."""
    lexicon = texts.sparkSession.sparkContext.broadcast((words, prefixes))

    @F.arrow_udf("array<double>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(*lexicon.value)
        for batch in batches:
            found = [reader.features(batch[i].as_py() or "") for i in range(len(batch))]
            flat = np.concatenate(found) if found else np.zeros(0)
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64()))

    return texts.withColumn("__features", scan(F.col(column)))


def learn_lexicon(labelled: DataFrame, text_column: str, label_column: str, max_terms: int = MAX_TERMS) -> tuple[frozenset[str], frozenset[str]]:
    """Words and word beginnings that mark toxic texts; at most ``max_terms`` reach the driver."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in map(_bare, (text or "").split()) if 1 < len(w) <= LONG_WORD}
                found = [*words, *{"^" + w[:n] for w in words for n in PREFIXES if len(w) >= n}]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], names=["term", "label"])

    rows = labelled.select(text_column, F.col(label_column).cast("int"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(label_column), F.lit(0)).alias("toxic")).first()
    if not 0 < total["toxic"] < total["n"]:
        return frozenset(), frozenset()
    rate = total["toxic"] / total["n"]
    counts = rows.mapInArrow(terms, "term string, label int").groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("t"))
    share = F.col("t") / F.col("n")
    side = lambda k, p, q: F.when(k > 0, k * F.log(p / q)).otherwise(0.0)
    evidence = 2 * (side(F.col("t"), share, F.lit(rate)) + side(F.col("n") - F.col("t"), 1 - share, F.lit(1 - rate)))
    strong = counts.where(share > max(0.5, rate)).withColumn("evidence", evidence).where(F.col("evidence") >= EVIDENCE)
    chosen = [r["term"] for r in strong.orderBy(F.desc("evidence"), "term").limit(max_terms).collect()]
    return frozenset(t for t in chosen if t[0] != "^"), frozenset(t[1:] for t in chosen if t[0] == "^")


@dataclass
class Model:
    """A fitted scorer.  ``base`` is the share of toxic rows, the score where there was nothing to learn."""

    words: frozenset[str]
    prefixes: frozenset[str]
    base: float
    trees: GBTClassificationModel | None = None
    steps: IsotonicRegressionModel | None = None

    def score(self, docs: DataFrame, text_column: str = "text") -> DataFrame:
        """``docs`` with ``score``, between 0 and 1.

        Null and empty texts are scored by their features, all of them zero.  A column ``score`` is replaced.
        """
        rows = docs.drop("score")
        if self.trees is None or self.steps is None:
            return rows.withColumn("score", F.lit(self.base))
        read = with_features(rows, text_column, self.words, self.prefixes)
        return _calibrated(self.trees, self.steps, read).select(*rows.columns, "score")


def _raw(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    scored = trees.transform(rows.withColumn("__vector", array_to_vector("__features")))
    return scored.withColumn("__raw", vector_to_array("__p")[1]).drop("__vector", "__margin", "__p", "__class")


def _calibrated(trees: GBTClassificationModel, steps: IsotonicRegressionModel, rows: DataFrame) -> DataFrame:
    known = steps.transform(_raw(trees, rows))
    blended = (1 - BLEND) * F.col("__step") + BLEND * F.col("__raw")
    return known.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), blended))).drop("__step", "__raw", "__features")


def fit(labelled: DataFrame, text_column: str = "text", label_column: str = "toxic", order_column: str = "doc_id",
        max_rows: int = MAX_ROWS) -> Model:
    """Fit on ``labelled``: texts with labels 0 or 1.

    Rows of null label are left out.  Of more than ``max_rows`` rows an even share is used, drawn by the
    hash of ``order_column``, which has no other use than to draw and to split.  With labels of one kind
    only, or with no rows, every text scores their mean (0 without rows).
    """
    known = labelled.where(F.col(label_column).isin(0, 1))
    return _fit(bounded_sample(known, _order(order_column), max_rows).select(
        F.col(text_column).alias("text"), F.col(label_column).cast("int").alias("label"), _order(order_column).alias("order")), max_rows)


def _order(column: str):
    return F.xxhash64(F.col(column), F.lit(9))


def _fit(rows: DataFrame, max_rows: int) -> Model:
    # rows that repeat a text under one id count once; ids with many texts are bounded here too
    sample = bounded_sample(shared_table(rows.distinct().repartition(8, "order"), "labelled"), F.xxhash64("text"), max_rows)
    fitting, check = sample.where(F.pmod("order", F.lit(4)) != 0), sample.where(F.pmod("order", F.lit(4)) == 0)
    kinds = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    base = kinds.get(1, 0) / max(1, sum(kinds.values()))
    words, prefixes = learn_lexicon(fitting, "text", "label")
    both = fitting.agg(F.countDistinct("label")).first()[0] == 2 and check.agg(F.countDistinct("label")).first()[0] == 2
    if not both:
        return Model(words, prefixes, base)
    read = shared_table(with_features(sample, "text", words, prefixes), "features")
    part = F.pmod("order", F.lit(4))
    learner = GBTClassifier(
        featuresCol="__vector", labelCol="label", predictionCol="__class", maxIter=20, maxDepth=4,
        stepSize=0.2, minInstancesPerNode=5, seed=9)
    learner = learner.setProbabilityCol("__p").setRawPredictionCol("__margin")
    trees = learner.fit(read.where(part != 0).withColumn("__vector", array_to_vector("__features")).withColumn("label", F.col("label").cast("double")))
    held = _raw(trees, read.where(part == 0)).withColumn("label", F.col("label").cast("double"))
    steps = IsotonicRegression(featuresCol="__raw", labelCol="label", predictionCol="__step").fit(held)
    return Model(words, prefixes, base, trees, steps)


def held_out(id_column: str = "doc_id"):
    """Whether a row's label may not be learned from: crc32 of the id as text, modulo 5, is 0; so is a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  label_column: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit on the texts of ``docs`` that ``labels`` marks and that are not held out.

    The sample is drawn from the labels, so it has ``max_rows`` ids at most; only those are broadcast.
    An id that has several labels counts as toxic if one of them is.
    """
    known = labels.where(F.col(label_column).isin(0, 1)).where(~held_out(id_column)).groupBy(
        F.col(id_column).alias("__id")).agg(F.max(label_column).alias("__label"))
    drawn = bounded_sample(known, _order("__id"), max_rows)
    rows = docs.join(F.broadcast(drawn), F.col(id_column) == F.col("__id"))
    return _fit(rows.select(F.col(text_column).alias("text"), F.col("__label").cast("int").alias("label"), _order("__id").alias("order")), max_rows)
