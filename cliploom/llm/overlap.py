"""Near copies by the Jaccard similarity of word shingles, with no pair lost.

The recorder that this library follows keeps no text, so the operator is general: it works on any
table with an integer id column and a text column.

Method: similarity fingerprints and their grid, then a prefix-filtered set join.  Every text has a fingerprint of its
shingles; texts that the grid of ``simhash`` links are candidates, verified by the exact similarity of their sets.
Fingerprints of texts that are similar enough may lie farther apart than the grid finds, so the join finds what is left.
A text is the set of its shingles of ``size`` words.  Shingles are put in
one order, those that fewest rows hold first.  Two sets of similarity ``least`` or more share a shingle among
the first ``n - ceil(least * n) + 1`` of each, so texts meet only there (a cell), and a shingle that one text
alone holds makes no cell.  Candidates are verified by the exact similarity of the sets, of which shingles of
one text alone need not be kept.

Pairs are not all written out where many texts resemble each other: each text is first verified against
its neighbours in the grid and a few texts drawn from its cells, and only cells whose texts are not connected by then are
looked at in full, by pairs of blocks.  Such a work item has its texts' sets at hand, verifies its pairs by itself and gives a spanning
forest of the links, never its pairs.

Copies of a text are left out where they are read, so that a task sends one of them.  Shingles that a 256th of all
texts hold come last in the order, whatever their number; which those are is read off an even sample of the
texts.  Nothing but the order depends on it, and their rows are dealt by text, not by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import LOWER_BYTES, as_bytes, released, shared_table, unsized
from cliploom.llm.contamination import hashes, shingles
from cliploom.llm.simhash import components, fingerprint
from cliploom.llm.simhash import links as grid_links

SIZE = 5
LEAST = 0.8
DRAWN = 8  # texts of its cells that a text is verified against before pairs are made
MOST = 65_536  # a shingle's count of texts ends here, so that counting holds no more rows
ROWS = 65_536  # shingles of a record batch, or those of one text
SEEN = 200_000  # texts of a task that are known to have been read
SAMPLE = 4_096  # texts of the sample that finds common shingles
SHARE = 256  # a shingle is common from this fraction of the texts on
COMMON = 65_536  # common shingles that are known as such; any more are dealt like the rest
BLOCK = 512  # texts of a cell in one block; a work item holds two blocks
COLUMNS = 4_096  # different shingles of a work item that are compared at a time
EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)  # the lowest bit of a shingle tells that it is common
EDGE = 1e-6  # bounds stay on the safe side of rounding


def words_of(text: bytes) -> list[bytes]:
    """Words as fingerprints take them: between white space, A-Z as a-z."""
    return text.translate(LOWER_BYTES).split()


def shingle_set(words: list[bytes], size: int = SIZE) -> np.ndarray:
    """Different shingles as even numbers; fewer words than ``size`` are one shingle, no words none."""
    return np.unique(shingles(hashes(words), min(size, len(words))) & EVEN) if words else np.zeros(0, np.uint64)


def text_keys(docs: DataFrame, id_column: str, text_column: str, size: int = SIZE) -> DataFrame:
    """(doc_id, key, fingerprint): texts of the same words have the same key and the same fingerprint of ``size``-word shingles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            keys, prints = [], []
            for text in as_bytes(batch.column(1)):
                key = _key(words_of(text))
                if key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[key] = fingerprint(text, size)
                keys.append(key)
                prints.append(seen[key])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(np.array(v, np.uint64).view(np.int64)) for v in (keys, prints)]],
                names=["doc_id", "key", "fingerprint"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column).mapInArrow(
        released(scan), "doc_id long, key long, fingerprint long")


def _key(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def _shingle_rows(docs: DataFrame, text_column: str, size: int, common: np.ndarray) -> DataFrame:
    """(s, key, n): every different shingle of every text, which has ``n`` of them; odd numbers are in ``common``."""
    known = docs.sparkSession.sparkContext.broadcast(common)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held: list[tuple[int, np.ndarray]] = []
            total = 0
            for i in range(batch.num_rows):
                words = words_of(as_bytes(batch.column(0).slice(i, 1))[0])
                key = _key(words)
                if key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    found = shingle_set(words, size)
                    held.append((key, found | np.isin(found, known.value)))
                    total += len(found)
                if held and (total >= ROWS or i + 1 == batch.num_rows):
                    lengths = [len(s) for _, s in held]
                    keys = np.repeat(np.array([k for k, _ in held], np.uint64), lengths).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([s for _, s in held]).view(np.int64)), pa.array(keys),
                         pa.array(np.repeat(np.array(lengths, np.int32), lengths))], names=["s", "key", "n"])
                    held, total = [], 0

    return docs.select(text_column).mapInArrow(released(scan), "s long, key long, n int")


def common_shingles(docs: DataFrame, text_column: str, size: int) -> np.ndarray:
    """Shingles that about a ``SHARE``-th of the texts hold, by a sample of about ``SAMPLE`` rows; sorted."""
    n = docs.count()
    sample = docs.select(text_column) if n <= SAMPLE else docs.select(text_column).where(F.rand(5) < SAMPLE / n)
    rows = _shingle_rows(sample, text_column, size, np.zeros(0, np.uint64)).select("s", "key").distinct()
    counts = rows.groupBy("s").agg(F.count("*").alias("held_by")).where(F.col("held_by") >= max(16, min(n, SAMPLE) // SHARE))
    most = counts.orderBy(F.desc("held_by"), "s").limit(COMMON).toArrow()
    return np.sort(most.column("s").to_numpy().view(np.uint64))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (s, key) those whose shingle several texts hold, each once; ``held_by`` ends at ``MOST``.

    Common shingles are those of several texts, however few of their rows are in this task.
    """
    held = {k: np.zeros(0, t) for k, t in (("s", np.int64), ("key", np.int64), ("n", np.int32))}
    crowded = None  # the shingle of ``MOST`` texts or more that is passing

    def emit(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], rows["s"][1:] != rows["s"][:-1]])) if len(rows["s"]) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(rows["s"])))
        many = (sizes >= MOST) | (rows["s"][starts] == crowded) | (rows["s"][starts] & 1 == 1)
        by = np.repeat(np.where(many, MOST, sizes), sizes).astype(np.int32)
        out = by > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[k][out]) for k in ("s", "key", "n")] + [pa.array(by[out])], names=["s", "key", "n", "held_by"])

    for batch in batches:
        rows = {k: np.concatenate([v, batch.column(k).to_numpy()]) for k, v in held.items()}
        again = np.zeros(len(rows["s"]), bool)  # rows of texts with the same words
        again[1:] = (rows["s"][1:] == rows["s"][:-1]) & (rows["key"][1:] == rows["key"][:-1])
        rows = {k: v[~again] for k, v in rows.items()}
        if not len(rows["s"]):
            continue
        cut = int(np.searchsorted(rows["s"], rows["s"][-1]))
        if len(rows["s"]) - cut > MOST or rows["s"][-1] == crowded:
            # the last row waits, since the next one may be the same
            last = rows["s"][-1]
            whole, part = {k: v[:cut] for k, v in rows.items()}, {k: v[cut:-1] for k, v in rows.items()}
            yield emit(whole)
            crowded = last
            yield emit(part)
            held = {k: v[-1:] for k, v in rows.items()}
        else:
            yield emit({k: v[:cut] for k, v in rows.items()})
            held = {k: v[cut:] for k, v in rows.items()}
    yield emit(held)


def common_counts(sets: pa.Array) -> np.ndarray:
    """How many shingles every two of some sets have in common."""
    sizes = sets.value_lengths().to_numpy()
    _, column = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, row = column[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    counts = np.zeros((len(sizes), len(sizes)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (first, first + COLUMNS)))
        held = np.zeros((len(sizes), COLUMNS), np.float32)
        held[row[part], column[part] - first] = 1
        counts += held @ held.T
    return counts


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that ``links`` joins, found breadth first."""
    left = np.ones(len(links), bool)
    a, b = [], []
    while left.any():
        front = np.array([int(np.argmax(left))])
        left[front] = False
        while len(front):
            met = links[front] & left
            new = np.flatnonzero(met.any(0))
            a.append(front[np.argmax(met[:, new], axis=0)])
            b.append(new)
            left[new] = False
            front = new
    return np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*b, np.zeros(0, np.int64)]).astype(np.int64)


def _block_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by work item to links between texts of different parts; work items may go over batch borders."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        names = ("s", "low", "high", "own", "part", "key", "n")
        column = {k: rows.column(k).to_numpy() for k in names}
        sets = rows.column("shared").combine_chunks()
        change = np.zeros(rows.num_rows, bool)
        for k in ("s", "low", "high"):
            change[1:] |= column[k][1:] != column[k][:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)]) if rows.num_rows else np.zeros(0, np.int64)
        out = [np.zeros((2, 0), np.int64)]
        for lo, hi in zip(starts, [*starts[1:], rows.num_rows]):
            part = column["part"][lo:hi]
            if hi - lo < 2 or (part == part[0]).all():
                continue
            counts = common_counts(sets.slice(lo, hi - lo))
            n = column["n"][lo:hi].astype(np.float64)
            links = counts >= least * (n[:, None] + n[None, :] - counts) - EDGE
            links &= counts / np.maximum(n[:, None] + n[None, :] - counts, 1) >= least
            links &= part[:, None] != part[None, :]
            a, b = _forest(links)
            key = column["key"][lo:hi]
            out.append(np.stack([np.minimum(key[a], key[b]), np.maximum(key[a], key[b])]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        last = np.ones(rows.num_rows, bool)
        for k in ("s", "low", "high"):
            v = rows.column(k).to_numpy()
            last &= v == v[-1]
        cut = rows.num_rows - int(last.sum())
        if cut:
            yield found(rows.slice(0, cut))
        held = rows.slice(cut).combine_chunks()
    if held is not None:
        yield found(held)


def _cell_links(named: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join the texts of each cell that are in different parts (s, part, key, n) and so similar.

    A cell of any size is cut into blocks; each pair of blocks is a work item of bounded size.
    """
    crowd = named.groupBy("s").agg(F.count("*").alias("texts"), F.min("part").alias("p"), F.max("part").alias("q")).where("p < q")
    shared = named.join(crowd.select("s", F.ceil(F.col("texts") / BLOCK).cast("int").alias("blocks")), "s").withColumn(
        "own", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    items = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "s", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "part", "key", "n")
    full = items.join(sets.select("key", "shared"), "key")
    dealt = full.repartition("s", "low", "high").sortWithinPartitions("s", "low", "high")
    return dealt.mapInArrow(released(lambda b: _block_links(b, least)), "a long, b long").distinct()


def _sizes_allow(a: Column, b: Column, least: float) -> Column:
    return F.least(a, b) >= least * F.greatest(a, b) - EDGE


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have the similarity."""
    one = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")) >= least).select("a", "b")


def _grid_pairs(prints: DataFrame) -> DataFrame:
    """Candidates (a < b): texts of one fingerprint with the smallest of them, and what the grid links, up to ``DRAWN`` of a text.

    ``prints``: key, fingerprint of every text, each once.
    """
    distinct = shared_table(prints.groupBy("fingerprint").agg(F.min("key").alias("node")), "prints")
    same = prints.join(unsized(distinct), "fingerprint").where(F.col("key") > F.col("node")).select(F.col("node").alias("a"), F.col("key").alias("b"))
    near = grid_links(distinct).withColumn("at", F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b"))))
    return same.unionByName(near.where(F.col("at") <= DRAWN).drop("at")).distinct()


def _drawn_pairs(cells: DataFrame, least: float) -> DataFrame:
    """Candidates (a < b): each text with a few texts drawn from its cells."""
    hubs = cells.groupBy("s").agg(F.min_by(F.struct("key", "n"), F.xxhash64("key", "s")).alias("hub"))
    drawn = cells.join(unsized(hubs), "s").where((F.col("key") != F.col("hub.key")) & _sizes_allow(F.col("n"), F.col("hub.n"), least))
    drawn = drawn.select("key", F.col("hub.key").alias("hub")).distinct().withColumn(
        "at", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("hub", "key"))))
    return drawn.where(F.col("at") <= DRAWN).select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def similar_texts(docs: DataFrame, text_column: str = "text", size: int = SIZE, least: float = LEAST,
                  prints: DataFrame | None = None) -> DataFrame:
    """Links (a < b) between keys of different texts of similarity ``least`` or more.

    Linked texts are so similar, and all texts that are so similar are connected by links; links that only close
    circles may be left out.  ``prints`` are the (key, fingerprint) of all texts, each once, where they are known.
    """
    if not 0 < least <= 1:
        raise ValueError("the similarity is above 0 and at most 1")
    if prints is None:
        prints = text_keys(docs.select(F.lit(0).alias("id"), text_column), "id", text_column, size).select("key", "fingerprint").distinct()
    near = shared_table(_grid_pairs(prints), "grid-pairs")
    rows = _shingle_rows(docs, text_column, size, common_shingles(docs, text_column, size))
    by = F.when(F.col("s").bitwiseAND(F.lit(1)) == 1, F.xxhash64("key")).otherwise(F.col("s"))
    dealt = rows.repartition(by).sortWithinPartitions("s", "key")
    shared = dealt.mapInArrow(released(_shared), "s long, key long, n int, held_by int")
    by_text = Window.partitionBy("key")
    need = F.ceil(least * F.col("n") - EDGE)
    ranked = shared.select(
        "s", "key", "n", F.row_number().over(by_text.orderBy("held_by", "s")).alias("rank"), F.count("*").over(by_text).alias("held"))
    # shingles of one text alone come first in the order; where they fill the prefix, no other text is so similar
    stored = shared_table(ranked.where(F.col("held") >= need), "shared-shingles")
    cells = stored.where(F.col("rank") <= F.col("held") - need + 1).select("s", "key", "n")
    sets = stored.groupBy("key", "n").agg(F.collect_list("s").alias("shared"))

    first = near.unionByName(_drawn_pairs(cells, least)).distinct()
    linked = shared_table(_verified(first, sets, least), "drawn-links")

    found = components(linked, "drawn").withColumnRenamed("node", "key")
    named = cells.join(found, "key", "left").withColumn("part", F.coalesce("component", "key"))
    return linked.unionByName(_cell_links(named.select("s", "part", "key", "n"), sets, least))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE,
                least: float = LEAST) -> DataFrame:
    """``doc_id`` and ``component_id`` of every row of ``docs``: the smallest id that similar texts connect to it.

    Texts of the same words are copies whatever their white space and case; so are texts without words.  Repeated
    rows stay.  A row of null id gets the component of its text, null if no row with an id has that text.
    """
    keys = shared_table(text_keys(docs, id_column, text_column, size), "text-keys")
    nodes = keys.where(F.col("doc_id").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("node"))
    prints = keys.where(F.col("doc_id").isNotNull()).select("key", "fingerprint").distinct()
    links = similar_texts(docs.where(F.col(id_column).isNotNull()), text_column, size, least, prints)
    one, two = (nodes.select(F.col("key").alias(k), F.col("node").alias(f"{k}_node")) for k in ("a", "b"))
    ends = links.join(unsized(one), "a").join(unsized(two), "b").where("a_node <> b_node")
    ends = ends.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    found = components(ends.distinct(), "copies")
    classes = nodes.join(found, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    return keys.join(unsized(classes), "key", "left").select("doc_id", "component_id")
