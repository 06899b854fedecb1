"""Search for benchmark passages in a corpus.

The recorder that this library follows keeps no text, so the operator is general: it works on any
table of documents and any table of benchmark items.

Method: a prefix-filtered set join.  An item's windows are sets of word shingles.  A window occurs
in a document only if all its shingles do, so one necessary shingle, the rarest one of the window,
is enough to join on.  Rarity is counted over the whole corpus.  Positional and length bounds then
place the window in the document, and its words are compared one by one.

Documents are read once.  A filter of at most 32 MiB, sized by the number of benchmark shingles, marks words
that may belong to one; each longest stretch of such words (a run) is kept with its words.  Every
occurrence of a window lies in one run, so nothing after this step needs the texts.  A run is known by a
128-bit hash of its words, so its length is paid for once, whatever it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import as_bytes, join_null_safe, mix, shared_table, text_key, unsized

#: Words are runs of digits, letters a-z and everything outside ASCII, after A-Z became a-z.
WORD_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SHINGLE = 5
FILTER_BITS = (16, 28)  # least and greatest size of the filter, as powers of two
SPARE = 16  # bits of the filter for each shingle, up to the greatest size; beyond it runs only get longer
CHUNK_WORDS = 200_000
RUN_ROWS = 4_096  # shingles of a run in one record batch


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, from the words' hashes."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


def item_windows(items: DataFrame, id_column: str, text_column: str, window: int) -> DataFrame:
    """Distinct windows: ``words`` (joined by spaces), ``n``, ``k`` (shingle size), ``shingles``, ``items``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                if not size:
                    continue
                k = min(SHINGLE, size)
                s = shingles(hashes(words), k).view(np.int64)
                starts = range(len(words) - size + 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(starts), pa.string()),
                    pa.array([b" ".join(words[i : i + size]).decode() for i in starts], pa.string()),
                    pa.array([size] * len(starts), pa.int32()), pa.array([k] * len(starts), pa.int32()),
                    pa.array([s[i : i + size - k + 1] for i in starts], pa.list_(pa.int64()))],
                    names=["item_id", "words", "n", "k", "shingles"])

    rows = items.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("string"), text_column)
    cuts = rows.mapInArrow(cut, "item_id string, words string, n int, k int, shingles array<long>")
    return cuts.groupBy("words").agg(
        F.first("n").alias("n"), F.first("k").alias("k"), F.first("shingles").alias("shingles"),
        F.collect_set("item_id").alias("items"))


def filter_bits(shingles: int) -> int:
    """Size of the filter, as a power of two, for so many different shingles."""
    return min(FILTER_BITS[1], max(FILTER_BITS[0], (SPARE * shingles).bit_length()))


def shingle_filter(windows: DataFrame, bits: int | None = None) -> np.ndarray:
    """Bits of all window shingles, OR-ed by Spark to 64 at a time; of ``2 ** bits``, or as many as their number asks for."""
    every = windows.select(F.explode("shingles").alias("s"))
    if bits is None:
        bits = filter_bits(every.distinct().count())
    slot = F.shiftrightunsigned("s", 64 - bits)
    words = every.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(s, {64 - bits}) & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def document_runs(docs: DataFrame, windows: DataFrame, id_column: str, text_column: str, bits: int | None = None) -> DataFrame:
    """Every document with its word count and its runs (``start``, ``k``, the hash ``h1, h2`` and the ``words``)."""
    shape = {r["k"]: r["least"] for r in windows.groupBy("k").agg(F.min("n").alias("least")).collect()}  # SHINGLE rows at most
    filter_ = docs.sparkSession.sparkContext.broadcast(shingle_filter(windows, bits))
    run = pa.struct([("start", pa.int32()), ("k", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("words", pa.string())])

    def search(texts: list[list[bytes]]) -> list[list[dict]]:
        found: list[list[dict]] = [[] for _ in texts]
        flat = [w for words in texts for w in words]
        h = hashes(flat)
        lengths = np.array([len(w) for w in texts])
        owner = np.repeat(np.arange(len(texts)), lengths)
        first = np.cumsum(lengths) - lengths
        table = filter_.value
        size = 6 + (len(table) - 1).bit_length()
        for k, least in shape.items():
            s = shingles(h, k)
            if not len(s):
                continue
            slot = s >> np.uint64(64 - size)
            hit = (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            hit &= owner[: len(s)] == owner[k - 1 :]
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            # a window of ``least`` words needs so many hits in a row
            breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0)) + 1
            for lo, hi in zip(np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]]), strict=True):
                begin, end = int(at[lo]), int(at[hi - 1]) + k
                if end - begin >= least:
                    d = int(owner[begin])
                    words = b" ".join(flat[begin:end])
                    h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(words), "<i8").tolist()
                    found[d].append({"start": begin - int(first[d]), "k": k, "h1": h1, "h2": h2, "words": words.decode()})
        return found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            begin = 0
            while begin < batch.num_rows:
                part, size, end = [], 0, begin
                while end < batch.num_rows and (size < CHUNK_WORDS or end == begin):
                    part.append(words_of(as_bytes(texts.slice(end, 1))[0]))
                    size += len(part[-1])
                    end += 1
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(begin, end - begin), batch.column("text_key").slice(begin, end - begin),
                    pa.array([len(w) for w in part], pa.int64()), pa.array(search(part), pa.list_(run))],
                    names=["doc_id", "text_key", "n_words", "runs"])
                begin = end

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_key(text_column).alias("text_key"),
                       F.col(text_column).alias("text"))
    return rows.mapInArrow(
        scan, "doc_id long, text_key long, n_words long, runs array<struct<start: int, k: int, h1: long, h2: long, words: string>>")


def contaminated_words(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                       item_column: str = "item_id", item_text: str = "text", window: int = 10,
                       bits: int | None = None) -> DataFrame:
    """Where windows of benchmark items occur in documents.

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer.  Returns
    a row for every row of ``docs``: ``doc_id, text_key, n_words``, ``hits`` (start, length: places of
    windows, in words from 0; overlapping ones stay apart) and ``items`` (ids as strings, sorted).

    ``bits`` sets the size of the filter by hand, as a power of two of at least 6; too small a one makes runs longer.

    Null or empty text has no words, hits or items; so has a text shorter than every window.  Items
    of null id are left out, items of null or empty text have no window.  Repeated rows each get
    their row.  A null document id is kept.  Other columns are not read.
    """
    windows = shared_table(item_windows(items, item_column, item_text, window), "windows")
    scanned = shared_table(document_runs(docs, windows, id_column, text_column, bits), "runs")
    placed = scanned.select("doc_id", "text_key", F.explode("runs").alias("run")).select("doc_id", "text_key", "run.*")

    # each different run once, however many documents hold it; only this step reads their words
    run = ["h1", "h2", "k"]
    runs = placed.groupBy(*run).agg(F.count("*").alias("copies"), F.first("words").alias("words"))
    known = runs.mapInArrow(
        lambda batches: _run_shingles(batches, window),
        "h1 long, h2 long, k int, copies long, s long, pos int, context string, before int")
    rarity = known.groupBy("k", "s").agg(F.sum("copies").alias("held_by"))

    # the necessary shingle of each window: its rarest one; a window with an absent shingle occurs nowhere
    parts = windows.select("words", "n", "k", F.posexplode("shingles").alias("offset", "s"))
    rarest = F.struct("held_by", "s", "offset")
    prefix = (
        parts.join(unsized(rarity), ["k", "s"], "left").groupBy("words", "n", "k")
        .agg(F.min(rarest).alias("rarest"), F.count_if(F.col("held_by").isNull()).alias("absent"))
        .where(F.col("absent") == 0)
        .select(F.col("words").alias("window"), "n", "k", "rarest.s", "rarest.offset"))
    candidates = known.join(unsized(prefix), ["k", "s"])
    start = F.col("pos") - F.col("offset")
    inside = candidates.where((start >= 0) & (F.col("before") >= F.col("offset")))
    same = F.array_join(F.slice(F.split("context", " "), F.col("before") - F.col("offset") + 1, F.col("n")), " ") == F.col("window")
    verified = inside.where(same).select(*run, start.alias("start"), "n", "window")
    named = verified.join(windows.select(F.col("words").alias("window"), "items"), "window")
    by_run = named.groupBy(*run).agg(
        F.collect_set(F.struct("start", F.col("n").alias("length"))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # written, so that the join below reads rows and not sums, and the partition of a run of many documents may be cut
    by_run = shared_table(by_run, "found-runs")

    hits = placed.drop("words").join(unsized(by_run), run).select(
        "doc_id", "text_key", "items",
        F.transform("places", lambda p: F.struct((p["start"] + F.col("start")).alias("start"), p["length"].alias("length"))).alias("hits"))
    by_doc = hits.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return join_null_safe(scanned.select("doc_id", "text_key", "n_words"), by_doc, ["doc_id", "text_key"], "left").select(
        "doc_id", "text_key", "n_words",
        F.coalesce("hits", F.expr("cast(array() as array<struct<start: int, length: int>>)")).alias("hits"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def _run_shingles(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each shingle of a run with the words around it that a window through it can reach."""
    for batch in batches:
        for row in batch.to_pylist():
            words = row["words"].encode().split(b" ")
            s = shingles(hashes(words), row["k"]).view(np.int64)
            for begin in range(0, len(s), RUN_ROWS):
                at = range(begin, min(begin + RUN_ROWS, len(s)))
                low = [max(0, i - window + row["k"]) for i in at]
                yield pa.RecordBatch.from_arrays([
                    *[pa.array([row[c]] * len(at), t) for c, t in (("h1", pa.int64()), ("h2", pa.int64()), ("k", pa.int32()), ("copies", pa.int64()))],
                    pa.array(s[begin : begin + len(at)]), pa.array(at, pa.int32()),
                    pa.array([b" ".join(words[a : i + window]).decode() for i, a in zip(at, low, strict=True)], pa.string()),
                    pa.array([i - a for i, a in zip(at, low, strict=True)], pa.int32())],
                    names=["h1", "h2", "k", "copies", "s", "pos", "context", "before"])


def hit_words(hits: Column) -> Column:
    """Number of different words inside any of the places in ``hits``."""
    spans = F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))
    return F.size(F.array_distinct(F.flatten(spans))).cast("long")
