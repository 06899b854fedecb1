"""Importance resampling of documents towards a target distribution of hashed word n-grams.

The recorder that this library follows keeps no texts, so the operator is general: it works on any table with
an integer id column and a text column, and any table of target texts.

Method: segment deduplication.  Line ends cut texts into lines.  Each distinct line is cut into words once, its
features' buckets are kept, and they count as often as the line occurs.  N-grams that go over a line end belong to
no line; they are found where a document is read and added by themselves.  A document's sum of gains is then
the sum over its lines' sums and its own n-grams, by a join on the lines' hashes.

Lines that make up a 4096th of all occurrences or more, at most 4096 by that rule, are joined by broadcast; no
other line holds more of the rows, so no task of the shuffled join does.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import ranks, shared_table
from cliploom.llm.contamination import WORD_TABLE
from cliploom.llm.vocab import text_slices

BUCKETS = 10_000
LONGEST = 2  # words of a feature
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
HOT = 4096  # a line is hot from this fraction of all lines' occurrences on


def _dtype(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def gram_buckets(words: list[bytes], group: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word's place, words of it, bucket) of every run of 1 to ``longest`` words inside a group."""
    n = len(words)
    at, size, found = [np.arange(n)], [np.ones(n, np.int64)], []
    sums = list(map(zlib.crc32, words))
    found.append(np.fromiter(sums, np.int64, n))
    spaced = [b" " + w for w in words] if longest > 1 else []
    for m in range(2, longest + 1):
        # a checksum goes on where that of the run without its last word ended
        sums = list(map(zlib.crc32, spaced[m - 1 :], sums))
        inside = np.flatnonzero(group[m - 1 :] == group[: n - m + 1]) if n >= m else np.zeros(0, np.int64)
        at.append(inside)
        size.append(np.full(len(inside), m))
        found.append(np.fromiter(sums, np.int64, len(sums))[inside])
    return np.concatenate(at), np.concatenate(size), np.concatenate(found) % buckets


def _split_binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive stretches of ``values`` as binaries."""
    ends = np.cumsum(counts) * values.dtype.itemsize
    raw = values.tobytes()
    return pa.array([raw[a:b] for a, b in zip((ends - counts * values.dtype.itemsize).tolist(), ends.tolist(), strict=True)], pa.binary())


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))


def document_lines(docs: DataFrame, id_column: str, text_column: str, longest: int, buckets: int) -> DataFrame:
    """``row, doc_id, lines, crossing``: the lines that hold words, by hash and number of copies in the document,
    and the buckets of the n-grams that go over line ends."""
    edge = longest - 1
    kind = _dtype(buckets)

    def cut(texts: list[bytes | None]) -> list[pa.Array]:
        digests: list[bytes] = []
        copies: list[int] = []
        n_lines = np.zeros(len(texts), np.int64)
        words: list[bytes] = []  # those near a line end; a stretch is cut where words in the middle of a line are left out
        owner: list[int] = []
        line: list[int] = []
        stretch: list[int] = []
        at = cuts = 0
        for d, text in enumerate(texts):
            seen: dict[bytes, int] = {}
            cuts += 1
            for raw in (text or b"").split(b"\n"):
                w = raw.translate(WORD_TABLE).split()
                if not w:
                    continue
                key = xxhash.xxh3_128_digest(raw)
                seen[key] = seen.get(key, 0) + 1
                at += 1
                if edge and len(w) <= 2 * edge:
                    parts = [w]
                else:
                    parts = [w[:edge], w[len(w) - edge :]] if edge else []
                for i, part in enumerate(parts):
                    cuts += i
                    words += part
                    owner += [d] * len(part)
                    line += [at] * len(part)
                    stretch += [cuts] * len(part)
            digests += seen
            copies += seen.values()
            n_lines[d] = len(seen)
        first, size, bucket = gram_buckets(words, np.array(stretch, np.int64), longest, buckets)
        numbers = np.array(line, np.int64)
        over = size > 1
        over[over] = numbers[first[over]] != numbers[first[over] + size[over] - 1]
        by = np.array(owner, np.int64)[first[over]]
        order = np.argsort(by, kind="stable")
        k1, k2 = _halves(digests)
        lines = pa.StructArray.from_arrays([k1, k2, pa.array(copies, pa.int64())], names=["k1", "k2", "copies"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_lines)]).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, lines),
                _split_binary(bucket[over][order].astype(kind), np.bincount(by, minlength=len(texts)))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(2).cast(pa.binary())):
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cut(texts)], names=["row", "doc_id", "lines", "crossing"])
                at += len(texts)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column))
    return rows.mapInArrow(scan, "row long, doc_id long, lines array<struct<k1: long, k2: long, copies: long>>, crossing binary")


def distinct_lines(docs: DataFrame, text_column: str, longest: int, buckets: int) -> DataFrame:
    """``k1, k2, held, n_words, features``: every distinct line with its occurrences and its features' buckets."""
    kind = _dtype(buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for lines in text_slices(batch.column(0).cast(pa.binary())):
                cut = [raw.translate(WORD_TABLE).split() for raw in lines]
                n = np.fromiter(map(len, cut), np.int64, len(cut))
                owner = np.repeat(np.arange(len(cut)), n)
                first, _, bucket = gram_buckets([w for words in cut for w in words], owner, longest, buckets)
                by = owner[first]
                order = np.argsort(by, kind="stable")
                k1, k2 = _halves([xxhash.xxh3_128_digest(raw) for raw in lines])
                features = _split_binary(bucket[order].astype(kind), np.bincount(by, minlength=len(cut)))
                yield pa.RecordBatch.from_arrays(
                    [k1, k2, batch.column(1).slice(at, len(lines)), pa.array(n), features], names=["k1", "k2", "held", "n_words", "features"])
                at += len(lines)

    lines = docs.select(F.explode(F.split(text_column, "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("held")).mapInArrow(
        scan, "k1 long, k2 long, held long, n_words long, features binary")


def _histogram(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of ``rows`` (features, held); each task adds its rows up before the shuffle."""
    kind = _dtype(buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            sizes = np.array([len(b) // np.dtype(kind).itemsize for b in batch.column(0).to_pylist()], np.int64)
            values = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)
            np.add.at(total, values, np.repeat(batch.column(1).to_numpy(), sizes))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return rows.select("features", "held").mapInArrow(scan, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_counts(lines: DataFrame, documents: DataFrame, buckets: int) -> np.ndarray:
    """Features in every bucket: those of lines times their occurrences, and those over line ends."""
    own = documents.select(F.col("crossing").alias("features"), F.lit(1).cast("long").alias("held"))
    rows = _histogram(lines.select("features", "held").unionByName(own), buckets).collect()  # a row for each bucket at most
    counts = np.zeros(buckets, np.int64)
    for row in rows:
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of every bucket."""
    n, total, wanted = len(counts), float(counts.sum() + len(counts)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((target[b] + 1.0) * total / ((counts[b] + 1.0) * wanted))) for b in range(n)], np.int64)


def _summed(batches: Iterator[pa.RecordBatch], gains: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """The last column's buckets become their number and their sum of gains; other columns stay."""
    size = np.dtype(kind).itemsize
    for batch in batches:
        held = batch.column(batch.num_columns - 1).to_pylist()
        n = np.array([len(b) // size for b in held], np.int64)
        sums = np.concatenate([[0], np.cumsum(gains[np.frombuffer(b"".join(held), kind)])])
        ends = np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(n), pa.array(sums[ends] - sums[ends - n])], names=[*batch.schema.names[:-1], "n", "gain"])


def _weights(documents: DataFrame, lines: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    kind = _dtype(len(gains))
    sums = shared_table(lines.select("k1", "k2", "held", "n_words", "features").mapInArrow(
        lambda b: _summed(b, gains, kind), "k1 long, k2 long, held long, n_words long, n long, gain long"), "line-gains")
    every = sums.agg(F.sum("held")).first()[0] or 0
    hot = F.col("held") * HOT >= every  # at most HOT lines
    one = sums.where(hot).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.struct("n_words", "n", "gain").alias("own"))
    rest = sums.where(~hot).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.struct("n_words", "n", "gain").alias("own"))
    same = (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    placed = documents.select("row", "doc_id", F.explode("lines").alias("line")).select("row", "doc_id", "line.*")
    known = placed.join(F.broadcast(one), same, "left").drop("h1", "h2")
    others = known.where(F.col("own").isNull()).drop("own").join(rest, same)
    add = ["row", "doc_id", *[(F.col("copies") * F.col(f"own.{c}")).alias(c) for c in ("n_words", "n", "gain")]]
    over = documents.select("row", "doc_id", F.lit(0).cast("long").alias("n_words"), "crossing").mapInArrow(
        lambda b: _summed(b, gains, kind), "row long, doc_id long, n_words long, n long, gain long")
    parts = known.where(F.col("own").isNotNull()).select(*add).unionByName(others.select(*add)).unionByName(over)
    total = parts.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n", "gain")])
    return total.select("doc_id", "n_words", F.col("n").alias("n_features"),
                        F.when(F.col("n") > 0, F.floor(F.col("gain") / F.col("n"))).otherwise(0).cast("long").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text",
             longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT,
             seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``.

    Features are the runs of 1 to ``longest`` words of a whole text, hashed to ``buckets``.  A bucket's gain is a
    thousand times the logarithm of its share in ``target`` over its share in ``docs``; a row's ``weight`` is the
    floored mean of its features' gains, and ``score`` adds Gumbel noise that ``seed`` and the id decide, so
    that the highest scores are a draw without replacement.  Of the rows with at least ``least_words`` words the
    best ``percent`` of a hundred get a ``rank`` from 1 on, ties by the smaller id; the others' is null.

    Null and empty texts have no features, weight 0 and no rank.  Rows that repeat an id share its noise and are
    rows of their own; a null id hashes like an empty one and comes first among ties.  With an empty
    ``target`` all gains are those of an even distribution.  Other columns are not read.
    """
    if longest < 1 or not 0 <= percent <= 100:
        raise ValueError("a feature has a word at least, and a share is between 0 and 100")
    documents = shared_table(document_lines(docs, id_column, text_column, longest, buckets), "document-lines")
    lines = shared_table(distinct_lines(docs, text_column, longest, buckets), "distinct-lines")
    wanted = bucket_counts(
        distinct_lines(target, target_text, longest, buckets),
        document_lines(target.withColumn("__id", F.lit(None).cast("long")), "__id", target_text, longest, buckets), buckets)
    weights = _weights(documents, lines, bucket_gains(bucket_counts(lines, documents, buckets), wanted))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = shared_table(weights.withColumn("score", (F.col("weight") + noise).cast("long")), "scores")

    ready = scored.where(F.col("n_words") >= least_words)
    ranked = ranks(ready, [F.col("score").desc(), F.col("doc_id").asc()], "ranges")
    drawn = ready.count() * percent // 100
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*out, F.when(F.col("rank") < drawn, F.col("rank") + 1).alias("rank")).unionByName(
        scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
