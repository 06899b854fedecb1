"""Packets to blocks, clusters and container roll-ups; NAL splitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cliploom.functions import rates, sound
from cliploom.operators import segments
from cliploom.operators.segments import Scan
from cliploom.session import cut_lineage

# Fixed values.
CLUSTER_SPAN_NS = 1_000_000_000

CHUNK_BITS = 14  # packets to a chunk
FAN_BITS = 6  # chunk functions composed at a time
LEVELS = 2  # of the tree: one function per 2**26 packets is left for a clip's last walk
SCAN = 256  # packets looked at in one go for the next opening
SEARCH_BYTES = 4 << 20  # of packets that are searched for start codes together


def full_blocks(samples: DataFrame, size: int = sound.BLOCK_FRAMES) -> DataFrame:
    """Samples of whole blocks, with ``block``; the window partition is one block."""
    blocked = samples.withColumn("block", sound.idiv(F.col("n"), F.lit(size)))
    filled = F.count(F.lit(1)).over(W.partitionBy("clip_id", "ch", "block"))
    return blocked.withColumn("__filled", filled).filter(F.col("__filled") == size).drop("__filled")


# --- clusters -------------------------------------------------------------------------------
#
# A packet opens a cluster if there is none, if it is a video keyframe away from the current base,
# or if it lies more than a second from the base; the base is the time of the packet that opened
# the cluster.  The base going into a packet thus depends on the whole clip before it.
#
# A clip is cut into chunks by arrival.  A chunk acts as a function from base-in to base-out and to the
# number of clusters it opens.  After any packet the base lies within a second of that packet's time, so
# the possible bases into a chunk are the distinct times within a second of the last packet before it: a
# small set.  Functions of chunks are tabulated on that set, composed up a tree, and resolved down again;
# last, every chunk is replayed once with its true base and cluster number.


def openings(rel: np.ndarray, hard: np.ndarray, base: int | None, span: int) -> list[int]:
    """Packets that open a cluster, given the base going in (None: no cluster yet).

    Between two openings the base stands still, so the next one is found by array comparison, a stretch
    of packets at a time.
    """
    out, i = [], 0
    if base is None and len(rel):
        out, base, i = [0], int(rel[0]), 1
    while i < len(rel):
        i = _next_opening(rel, hard, base, i, span)
        if i < len(rel):
            out.append(i)
            base = int(rel[i])
            i += 1
    return out


def _next_opening(rel: np.ndarray, hard: np.ndarray, base: int, start: int, span: int) -> int:
    for i in range(start, len(rel), SCAN):
        part = rel[i : i + SCAN]
        hit = (hard[i : i + SCAN] & (part != base)) | (np.abs(part - base) > span)
        if hit.any():
            return i + int(hit.argmax())
    return len(rel)


_MAP_SCHEMA = "clip_id long, chunk long, base_in long, base_out long, opens long"


def _chunk_maps(span: int):
    """Per chunk: rows with kind 0 are packets, kind 1 candidate bases; result is base-in to base-out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        packets = pdf[pdf["kind"] == 0].sort_values("arrival")
        rel, hard = packets["rel_ns"].to_numpy(), packets["hard"].to_numpy().astype(bool)
        clip, chunk = pdf["clip_id"].iloc[0], pdf["chunk"].iloc[0]
        if bool(pdf["starts"].iloc[0]):
            opened = openings(rel, hard, None, span)
            return pd.DataFrame({"clip_id": [clip], "chunk": [chunk], "base_in": pd.array([None], "Int64"),
                                 "base_out": [int(rel[opened[-1]])], "opens": [len(opened)]})
        # what follows an opening does not depend on the base before it: walked once for all bases
        known: dict[int, tuple[int, int]] = {}

        def after(base: int, start: int) -> tuple[int, int]:
            trail, i = [], _next_opening(rel, hard, base, start, span)
            while i < len(rel) and i not in known:
                trail.append(i)
                i = _next_opening(rel, hard, int(rel[i]), i + 1, span)
            end = known[i] if i < len(rel) else None
            for at in reversed(trail):
                end = (int(rel[at]), 1) if end is None else (end[0], end[1] + 1)
                known[at] = end
            return (base, 0) if end is None else end

        bases = np.unique(pdf.loc[pdf["kind"] == 1, "rel_ns"].to_numpy())
        ends = [after(int(b), 0) for b in bases]
        return pd.DataFrame({"clip_id": clip, "chunk": chunk, "base_in": pd.array(bases, "Int64"),
                             "base_out": [e[0] for e in ends], "opens": [e[1] for e in ends]})

    return run


def _walk(pdf: pd.DataFrame, starts: list) -> list:
    """Follow chunk maps in order from each (base, clusters so far); list of (chunk, those before it)."""
    trail, now = [], list(starts)
    for chunk, part in pdf.sort_values("chunk").groupby("chunk", sort=True):
        trail.append((chunk, list(now)))
        out, opens = part["base_out"].astype("int64").tolist(), part["opens"].astype("int64").tolist()
        if part["base_in"].isna().any():
            now = [(out[0], n + opens[0]) for _, n in now]
        else:
            table = dict(zip(part["base_in"].astype("int64").tolist(), zip(out, opens, strict=True), strict=True))
            now = [(table[b][0], n + table[b][1]) for b, n in now]
    trail.append((None, now))
    return trail


def _compose(bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        clip, group = pdf["clip_id"].iloc[0], int(pdf["chunk"].iloc[0]) >> bits
        first = pdf[pdf["chunk"] == pdf["chunk"].min()]
        entries = [None] if first["base_in"].isna().any() else first["base_in"].astype("int64").tolist()
        ends = _walk(pdf, [(b, 0) for b in entries])[-1][1]
        return pd.DataFrame({"clip_id": clip, "chunk": group, "base_in": pd.array(entries, "Int64"),
                             "base_out": [e[0] for e in ends], "opens": [e[1] for e in ends]})

    return run


def _resolve(maps: DataFrame, bits: int, levels: int) -> DataFrame:
    """True base into every chunk and clusters before it: clip_id, chunk, base_in, before."""
    schema = "clip_id long, chunk long, base_in long, before long"

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        entry = pdf["entry"].iloc[0] if "entry" in pdf else None
        before = int(pdf["entry_before"].iloc[0]) if "entry" in pdf else 0
        trail = _walk(pdf, [(None if pd.isna(entry) else int(entry), before)])[:-1]
        return pd.DataFrame({"clip_id": pdf["clip_id"].iloc[0], "chunk": [c for c, _ in trail],
                             "base_in": pd.array([b[0][0] for _, b in trail], "Int64"), "before": [b[0][1] for _, b in trail]})

    if levels == 0:
        return maps.groupBy("clip_id").applyInPandas(follow, schema)
    group = F.shiftright("chunk", bits)
    above = maps.groupBy("clip_id", group.alias("g")).applyInPandas(_compose(bits), _MAP_SCHEMA)
    entries = _resolve(above, bits, levels - 1).select(
        "clip_id", F.col("chunk").alias("g"), F.col("base_in").alias("entry"), F.col("before").alias("entry_before"))
    return (
        maps.withColumn("g", group).join(entries, ["clip_id", "g"])
        .groupBy("clip_id", "g").applyInPandas(follow, schema)
    )


def assign_clusters(
    packets: DataFrame, span_ns: int = CLUSTER_SPAN_NS, bits: int = CHUNK_BITS, fan_bits: int = FAN_BITS, levels: int = LEVELS
) -> DataFrame:
    """Add ``base_ns`` and ``cluster`` (0-based number in the clip).

    ``packets``: clip_id, arrival, is_audio, is_key, rel_ns; ``arrival`` is unique per clip.
    """
    rows = packets.withColumn("hard", ~F.col("is_audio") & F.col("is_key")).withColumn("chunk", F.shiftright("arrival", bits))
    thin = rows.select("clip_id", "arrival", "rel_ns", "hard", "chunk")
    chunks = thin.groupBy("clip_id", "chunk").agg(F.max_by("rel_ns", "arrival").alias("last_rel"))
    info = segments.scan(chunks, ["clip_id"], ["chunk"], {"prior_rel": Scan("last", F.col("last_rel"), strict=True)}, levels=1).select(
        "clip_id", "chunk", "prior_rel", F.col("prior_rel").isNull().alias("starts"))

    # candidate bases of every chunk but a clip's first
    second = lambda c: sound.idiv(c, F.lit(span_ns))
    asking = info.filter("NOT starts").select(
        "clip_id", "chunk", "prior_rel",
        F.explode(F.sequence(second(F.col("prior_rel")) - 1, second(F.col("prior_rel")) + 1)).alias("sec"))
    times = thin.select("clip_id", "rel_ns", second(F.col("rel_ns")).alias("sec")).join(
        asking.select("clip_id", "sec").distinct(), ["clip_id", "sec"], "left_semi").distinct()
    candidates = asking.join(times, ["clip_id", "sec"]).filter(F.abs(F.col("rel_ns") - F.col("prior_rel")) <= span_ns)

    work = thin.withColumn("kind", F.lit(0)).unionByName(
        candidates.select("clip_id", "chunk", "rel_ns", F.lit(1).alias("kind")), allowMissingColumns=True
    ).join(info.select("clip_id", "chunk", "starts"), ["clip_id", "chunk"])
    # a few rows per chunk, read again at every level of the tree: written once
    maps = cut_lineage(work.groupBy("clip_id", "chunk").applyInPandas(_chunk_maps(span_ns), _MAP_SCHEMA))
    entries = _resolve(maps, fan_bits, levels).select(
        "clip_id", "chunk", F.col("base_in").alias("__base"), F.col("before").alias("__before"))

    names = packets.columns

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arrival")
        rel, base = pdf["rel_ns"].to_numpy(), pdf["__base"].iloc[0]
        opened = openings(rel, pdf["hard"].to_numpy().astype(bool), None if pd.isna(base) else int(base), span_ns)
        place = np.searchsorted(opened, np.arange(len(rel)), side="right")
        bases = np.concatenate([[0 if pd.isna(base) else int(base)], rel[opened]]).astype(np.int64)
        return pdf[names].assign(base_ns=bases[place], cluster=int(pdf["__before"].iloc[0]) + place - 1)

    schema = StructType(packets.schema.fields).add("base_ns", "long").add("cluster", "long")
    return rows.join(entries, ["clip_id", "chunk"]).groupBy("clip_id", "chunk").applyInPandas(replay, schema)


def cluster_rollup(clustered: DataFrame) -> DataFrame:
    """One row per cluster: packets, bytes, base, time span, and the cue (its first packet)."""
    return clustered.groupBy("clip_id", "cluster").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum("size").alias("bytes"),
        F.min_by("rel_ns", "arrival").alias("base_ns"),
        (F.max("rel_ns") - F.min("rel_ns")).alias("span_ns"),
        F.min("arrival").alias("cue_arrival"),
        F.min_by("is_audio", "arrival").alias("cue_is_audio"),
    )


def clip_durations(packets: DataFrame) -> DataFrame:
    return packets.groupBy("clip_id").agg(F.max("rel_ns").alias("duration_ns"), F.count(F.lit(1)).alias("packets"),
                                          F.sum("size").alias("bytes"))


# --- NAL units ------------------------------------------------------------------------------


def unit_places(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packet, first byte, byte behind the last) of every unit in packets that lie behind each other and end at ``ends``."""
    zero = raw == 0
    at = np.flatnonzero(zero[:-2] & zero[1:-1] & (raw[2:] == 1)) if len(raw) > 2 else np.zeros(0, np.int64)
    packet = np.searchsorted(ends, at, side="right")
    begins = np.concatenate([[0], ends[:-1]])
    whole = at + 2 < ends[packet] if len(at) else np.zeros(0, bool)  # a code lies in one packet
    at, packet = at[whole], packet[whole]
    wide = (at > begins[packet]) & zero[at - 1]  # a zero before it belongs to the code
    first = at + 3
    last = ends[packet]
    follows = np.flatnonzero(packet[1:] == packet[:-1])
    last[follows] = (at - wide)[follows + 1]
    full = last > first
    return packet[full], first[full], last[full]


def split_nals(packets: DataFrame, key: str = "packet_id") -> DataFrame:
    """``(key, payload)`` to one row per unit: key, ord, size, first_byte.

    Units lie between three- or four-byte start codes; bytes before the first code and empty units are left out.
    Packets are searched together, some megabytes at a time; a null payload has no units.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, begin = batch.column(1), 0
            while begin < batch.num_rows:
                part, size = [], 0
                while begin + len(part) < batch.num_rows and size < SEARCH_BYTES:
                    part.append(payloads[begin + len(part)].as_py() or b"")
                    size += len(part[-1])
                raw = np.frombuffer(b"".join(part), np.uint8)
                packet, first, last = unit_places(raw, np.cumsum([len(p) for p in part]))
                opens = np.flatnonzero(np.concatenate([[True], packet[1:] != packet[:-1]])) if len(packet) else packet
                order = np.arange(len(packet)) - np.repeat(opens, np.diff(np.append(opens, len(packet))))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, len(part)).take(pa.array(packet)), pa.array(order, pa.int64()), pa.array(last - first),
                    pa.array(raw[first].astype(np.int32))], names=[key, "ord", "size", "first_byte"])
                begin += len(part)

    kind = packets.schema[key].dataType.simpleString()
    return packets.select(key, "payload").mapInArrow(split, f"{key} {kind}, ord long, size long, first_byte int")


def classify_nals(nals: DataFrame) -> DataFrame:
    """Unit type, and its name for parameter sets; units under two bytes are skipped."""
    kind = rates.nal_type(F.col("first_byte"))
    name = F.lit("SLICE")
    for code, label in rates.PARAMETER_SETS.items():
        name = F.when(kind == code, label).otherwise(name)
    return nals.filter("size >= 2").withColumn("nal_type", kind.cast("int")).withColumn("name", name)


def framed_sizes(nals: DataFrame, key: str = "packet_id") -> DataFrame:
    """Length-prefixed size of each packet: four bytes and the unit, for every unit."""
    return nals.groupBy(key).agg(F.sum(F.col("size") + 4).alias("framed_size"), F.count(F.lit(1)).alias("units"))


def parameter_sets(nals: DataFrame, clip: str = "clip_id") -> DataFrame:
    """Parameter-set counts per clip; a clip needs both an SPS and a PPS."""
    named = classify_nals(nals)
    out = named.groupBy(clip).agg(*[
        F.count_if(F.col("name") == label).alias(label.lower()) for label in rates.PARAMETER_SETS.values()])
    return out.withColumn("valid", (F.col("sps") > 0) & (F.col("pps") > 0))


def first_config(nals: DataFrame, clip: str = "clip_id", order: str = "packet_id") -> DataFrame:
    """The earliest packet of each clip that carries a whole configuration; later ones are ignored."""
    named = classify_nals(nals)
    whole = named.groupBy(clip, order).agg(
        F.bool_or(F.col("name") == "SPS").alias("s"), F.bool_or(F.col("name") == "PPS").alias("p")).filter("s AND p")
    return whole.groupBy(clip).agg(F.min(order).alias("config_packet"))
