"""Near-duplicate documents by 64-bit similarity fingerprints.

The recorder that this library follows keeps no text, so the operator is general: it works on any
table with an integer id column and a text column.

Method: a fingerprint is cut into 32 segments of two bits and mapped to its 32 bit counts.  The Manhattan
distance of two count vectors is never more than the number of differing bits.  The counts form eight
octets of four; vectors within Manhattan distance four differ in four octets at most, so they agree on
some four of the eight.  Each distinct fingerprint is written to the 70 grid cells that fix the counts of
four octets, cells are joined, and pairs that share a cell are verified bit by bit.  Nothing is lost: the
grid only adds candidates.

Cells may be crowded.  A cell of n fingerprints is cut into blocks, and each pair of blocks is a work
item of bounded size; from a work item comes a spanning forest of its links, not every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import LOWER_BYTES, as_bytes, mix, shared_table, text_key, unsized

SEED = 42
RADIUS = 4  # the grid is built for this many differing bits
BLOCK = 2048  # fingerprints of a cell in one block; a work item holds two blocks
SMALL = 48  # work items up to this size compare all their pairs directly


def fingerprint(text: bytes, size: int = 4) -> int:
    """A bit is 1 where more than half of the shingles' hashes have it; no words give 0."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(size, len(words))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(as_bytes(batch.column(1).slice(i, 1))[0], size) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column).mapInArrow(
        scan, "doc_id long, fingerprint long")


OCTETS = [sum(0xFF << (8 * octet) for octet in four) for four in combinations(range(8), 4)]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints to their grid cells: the bit counts of any four octets, named by a hash."""
    odd = np.uint64(0x5555555555555555)
    for batch in batches:
        prints = batch.column("fingerprint").to_numpy().view(np.uint64)
        counts = prints - ((prints >> np.uint64(1)) & odd)  # two bits each: ones in every segment of two bits
        for mask in OCTETS:
            cell = mix(mix(counts & np.uint64(mask)) ^ np.uint64(mask))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.view(np.int64)), batch.column("fingerprint"), batch.column("node")],
                names=["cell", "fingerprint", "node"])


def _forest(prints: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the connected points of one crowded work item, found breadth first."""
    left = np.arange(len(prints))
    out = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= radius
            if near.any():
                got = left[near]
                out.append((np.full(len(got), nodes[at]), nodes[got]))
                queue.extend(got.tolist())
                left = left[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by work item to verified links; work items may go over batch borders."""
    keys = ("cell", "low", "high")

    def emit(rows: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        n = len(rows["cell"])
        change = np.zeros(n, bool)
        for k in keys:
            change[1:] |= rows[k][1:] != rows[k][:-1]
        item = np.cumsum(change)
        sizes = np.bincount(item)
        prints, nodes = rows["fingerprint"].view(np.uint64), rows["node"]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.flatnonzero((sizes[item] > 1) & (sizes[item] <= SMALL))
        step = 1
        while len(at):
            at = at[at + step < n]
            at = at[item[at] == item[at + step]]
            near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= radius]
            out.append((nodes[near], nodes[near + step]))
            step += 1
        starts = np.cumsum(sizes) - sizes
        for big in np.flatnonzero(sizes > SMALL):
            span = slice(starts[big], starts[big] + sizes[big])
            out += _forest(prints[span], nodes[span], radius)
        a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([y for _, y in out]) if out else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {k: batch.column(k).to_numpy() for k in (*keys, "fingerprint", "node")}
        if held is not None:
            rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
        last = np.ones(len(rows["cell"]), bool)
        for k in keys:
            last &= rows[k] == rows[k][-1]
        cut = len(last) - int(last.sum())
        if cut:
            yield emit({k: v[:cut] for k, v in rows.items()})
        held = {k: v[cut:] for k, v in rows.items()}
    if held is not None:
        yield emit(held)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a < b) that connect all of ``distinct`` (fingerprint, node) within ``radius`` bits.

    Fingerprints within the radius end in one component; links that would only close circles inside a
    crowded cell are left out.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the grid finds up to {RADIUS} differing bits")
    # fingerprints are few bytes each but make 70 rows: spread them over all tasks
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fingerprint")
    cells = spread.mapInArrow(_cells, "cell long, fingerprint long, node long")
    crowd = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    shared = cells.join(unsized(crowd), "cell").withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("fingerprint", F.lit(1)), F.col("blocks")).cast("int"))
    items = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fingerprint", "node")
    dealt = items.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", "fingerprint")
    return dealt.mapInArrow(lambda b: _links(b, radius), "a long, b long").distinct()


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for nodes that have any.

    Large-star and small-star steps by turns: every node is tied to the smallest of its neighbours,
    until all edges lead to the smallest node of their component.  Each round is written to the shared
    folder, so its work is bounded by the edges left and a lost executor costs one round at most.
    """
    edges = shared_table(edges, name)
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours move to the smallest neighbour
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        large = shared_table(large, f"{name}-large")
        # small star: smaller neighbours, and the node itself, move to the smallest one
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("b"), F.col("m").alias("a")), F.struct(F.col("v").alias("b"), F.col("m").alias("a")))).alias("e"))
        following = shared_table(small.select("e.a", "e.b").where("a <> b").distinct(), f"{name}-round")
        # a forest of stars: every node has one parent, and no parent has a parent
        parents = following.groupBy("b").agg(F.count("*").alias("n"))
        branched = parents.where("n > 1").limit(1).count()
        if not branched:
            chained = following.join(parents.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
            if not chained:
                centres = following.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
                return following.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(centres)
        edges = following


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 4,
                    radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint`` (signed long) and ``component_id`` of every row of ``docs``.

    Fingerprints are taken over ``size``-word shingles of the whole text; two documents are linked when
    theirs differ in at most ``radius`` bits, and a component's id is the smallest ``doc_id`` in it.

    Null, empty or blank texts have no words and fingerprint 0; they link like any others.  Repeated
    rows stay.  A row of null id gets its fingerprint and, where other rows share its component, that
    component; alone, its component is null.  Other columns are not read.
    """
    prints = shared_table(fingerprints(docs, id_column, text_column, size), "fingerprints")
    distinct = prints.where(F.col("doc_id").isNotNull()).groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    found = components(links(distinct, radius))
    classes = distinct.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return prints.join(unsized(classes), "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that stay: of each component the row of the smallest id.

    Rows that repeat an id are one document: one of them stays, of several texts the one whose
    ``text_key`` is smallest.  Rows of null id stay.
    """
    return smallest_of_each(docs, near_duplicates(docs, id_column, text_column, **options), id_column, text_column)


def smallest_of_each(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``representatives`` by components (doc_id, component_id) that are known."""
    chosen = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_key(text_column).alias("text_key"))
    keys = texts.join(unsized(chosen), "doc_id", "left_semi").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    keys = keys.groupBy("doc_id").agg(F.min(F.struct("text_key", "n")).alias("least"))
    keep = shared_table(keys.select(F.col("doc_id").alias("__id"), F.col("least.text_key").alias("__key"), F.col("least.n").alias("__n")), "kept")
    on = (F.col(id_column).cast("long") == F.col("__id")) & (text_key(text_column) == F.col("__key"))
    single = docs.join(unsized(keep.where("__n = 1")), on, "left_semi")
    repeated = docs.join(unsized(keep.where("__n > 1")), on, "left_semi").dropDuplicates([id_column])
    return single.unionByName(repeated).unionByName(docs.where(F.col(id_column).isNull()))
