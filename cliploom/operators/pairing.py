"""Joins of capture streams: by timestamp, as-of, gated, shifted, positional."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions import sound
from cliploom.operators import segments
from cliploom.operators.segments import Scan

VALUE_BITS = 30  # about a second of nanoseconds


def pair_captures(images: DataFrame, results: DataFrame, indexes: DataFrame) -> DataFrame:
    """Image, capture result and burst index with the same sensor timestamp, whatever their arrival order."""
    return images.join(results, "ts_ns").join(indexes, "ts_ns")


def stray_captures(images: DataFrame, results: DataFrame, wanted: int) -> DataFrame:
    """Halves that never pair, and frames beyond the ``wanted`` first ones of a session.

    ``images``: session_id, ts_ns; ``results``: ts_ns.  Result: ts_ns, reason.
    """
    ranked = segments.position(images, ["session_id"], ["ts_ns"], "__rank")
    beyond = ranked.filter(F.col("__rank") >= wanted).select("ts_ns", F.lit("beyond").alias("reason"))
    held = ranked.filter(F.col("__rank") < wanted)
    no_result = held.join(results, "ts_ns", "left_anti").select("ts_ns", F.lit("no_result").alias("reason"))
    no_image = results.join(held, "ts_ns", "left_anti").select("ts_ns", F.lit("no_image").alias("reason"))
    return beyond.unionByName(no_result).unionByName(no_image)


def pair_shots(log: DataFrame, **kw) -> DataFrame:
    """Pairs of image and result in a session where arming the next shot throws pending halves away.

    A half belongs to the shot armed last before it, and pairs only with a half of the same shot; the
    first ``wanted`` images of a shot count, as its arming says.  Halves before the first arming have no
    shot.  ``log``: session_id, arrival, kind (``arm`` | ``image`` | ``result``), ts_ns, wanted.
    Result: session_id, shot (from 1), ts_ns, image_arrival, result_arrival.
    """
    arm = F.col("kind") == "arm"
    seen = segments.scan(log, ["session_id"], ["arrival"], {
        "shot": Scan("sum", arm.cast("long")), "limit": Scan("last", F.when(arm, F.col("wanted")))}, **kw)
    halves = seen.filter((F.col("shot") > 0) & ~arm)
    images = segments.position(halves.filter("kind = 'image'"), ["session_id", "shot"], ["arrival"], "__rank", **kw)
    counted = images.filter(F.col("__rank") < F.col("limit")).select("session_id", "shot", "ts_ns", F.col("arrival").alias("image_arrival"))
    results = halves.filter("kind = 'result'").select("session_id", "shot", "ts_ns", F.col("arrival").alias("result_arrival"))
    return counted.join(results, ["session_id", "shot", "ts_ns"])


def enrich_frames(frames: DataFrame, devices: DataFrame) -> DataFrame:
    """Static device tags, overridden per shot: black and neutral when present, white when above zero."""
    tags = devices.select(
        "device", F.col("black").alias("__black"), F.col("neutral").alias("__neutral"), F.col("white").alias("__white")
    )
    joined = segments.attach(frames, tags, ["device"], F.col("frame_id"))
    return joined.select(
        *[c for c in frames.columns if c not in ("black", "neutral", "white")],
        F.coalesce("black", "__black").alias("black"),
        F.coalesce("neutral", "__neutral").alias("neutral"),
        F.coalesce(F.when(F.col("white") > 0, F.col("white")), F.col("__white")).alias("white"),
    )


def newest_neutral(events: DataFrame, values: list[str], **kw) -> DataFrame:
    """Each frame with the newest neutral seen; frames before the first neutral take the first.

    ``events``: clip_id, arrival, is_neutral, is_frame and the neutral ``values``.
    """
    seen = F.when(F.col("is_neutral"), F.struct(*values))
    scanned = segments.scan(
        events, ["clip_id"], ["arrival"], {"__before": Scan("last", seen), "__after": Scan("next", seen)}, **kw
    )
    got = F.coalesce("__before", "__after")
    return scanned.filter("is_frame").select("clip_id", "arrival", *[got[v].alias(v) for v in values])


def interleave_tracks(packets: DataFrame, **kw) -> DataFrame:
    """Output order of audio gated by video.

    An audio packet leaves just before the first later-arriving video packet at which the largest
    video time so far reaches the largest audio time so far (a waiting packet holds back those
    behind it).  ``gate`` is that video packet's arrival; null means after the last video.
    ``out_pos`` is the place in the written stream.

    ``packets``: clip_id, arrival, is_audio, ts_ns.
    """
    keys = ["clip_id"]
    audio = F.col("is_audio")
    video = ~audio
    rows = segments.scan(
        packets.select("clip_id", "arrival", "is_audio", "ts_ns"),
        keys,
        ["arrival"],
        {
            "v_max": Scan("max", F.when(video, F.col("ts_ns"))),
            "a_max": Scan("max", F.when(audio, F.col("ts_ns"))),
            "v_before": Scan("sum", video.cast("long"), strict=True),
            "a_before": Scan("sum", audio.cast("long"), strict=True),
            "v_next": Scan("next", F.when(video, F.col("arrival")), strict=True),
        },
        **kw,
    ).na.fill(0, ["v_before", "a_before"])

    # The two running maxima are staircases that meet on one value axis, a row for each of their steps.
    # An audio step asks for the first video step that reaches it; a video step asks how many
    # audio packets it has reached.  A step may be as long as the clip, so rows find theirs by stretch of arrival.
    marked = rows.select(
        "*",
        F.when(audio, 0).otherwise(1).alias("kind"),
        F.when(audio, F.col("a_max")).otherwise(F.col("v_max")).alias("value"),
        F.shiftright("arrival", segments.SEGMENT_BITS).alias("part"),
    )
    step = ["clip_id", "value", "kind"]
    parts = marked.groupBy(*step, "part").agg(
        F.min(F.when(video, F.col("arrival"))).alias("at"),
        F.min(F.when(video, F.col("v_before"))).alias("rank"),  # grows with arrival, so it belongs to the same packet
        F.sum(audio.cast("long")).alias("released"),
    )
    stairs = parts.groupBy(*step).agg(F.min("at").alias("at"), F.min("rank").alias("rank"), F.sum("released").alias("released")).withColumn(
        "hit", F.when(F.col("at").isNotNull(), F.struct(F.col("at").alias("arrival"), F.col("rank").alias("v_before"))))
    met = segments.scan(
        stairs, keys, ["value", "kind"],
        {"__hit": Scan("next", F.col("hit")), "__released": Scan("sum", F.col("released"))}, bits=VALUE_BITS,
    ).select(*step, "__hit", "__released")
    met = parts.select(*step, "part").join(met, step)
    axis_key = [*step, "part"]
    totals = packets.groupBy("clip_id").agg(F.sum(video.cast("long")).alias("__videos"))
    joined = segments.attach(marked.join(met, axis_key), totals, keys, F.col("arrival"))

    caught_up = F.coalesce(F.col("v_max") >= F.col("a_max"), F.lit(False))
    gate = F.when(caught_up, F.col("v_next")).otherwise(F.col("__hit.arrival"))
    gate_rank = F.when(gate.isNull(), F.col("__videos")).when(caught_up, F.col("v_before")).otherwise(
        F.col("__hit.v_before"))
    # video: every audio packet so far when it has caught up (or none has come), else those it has reached
    behind = F.coalesce(F.col("v_max") < F.col("a_max"), F.lit(False))
    ahead = F.when(behind, F.col("__released")).otherwise(F.col("a_before"))
    return joined.select(
        "clip_id", "arrival", "is_audio", F.when(audio, gate).alias("gate"),
        F.when(audio, F.col("a_before") + gate_rank).otherwise(F.col("v_before") + ahead).alias("out_pos"),
    )


def band_dimension(spark, widths: list[int] = sound.BAND_WIDTHS) -> DataFrame:
    """One row per frequency bin with its band: a fixed table of ``sum(widths)`` rows."""
    one = spark.range(1).select(F.posexplode(
        F.flatten(F.array(*[F.array_repeat(F.struct(F.lit(b).alias("band"), F.lit(w).alias("width")), w)
                            for b, w in enumerate(widths)]))).alias("k", "b"))
    return one.select("k", "b.band", "b.width")


def with_band(spec: DataFrame, widths: list[int] = sound.BAND_WIDTHS) -> DataFrame:
    """Band and band width of each bin ``k``; the broadcast side is a constant of a few hundred rows."""
    return spec.join(F.broadcast(band_dimension(spec.sparkSession, widths)), "k")


def shifted_overlap(ref: DataFrame, mov: DataFrame, dx: Column | int, dy: Column | int) -> DataFrame:
    """``ref(x, y)`` beside ``mov(x + dx, y + dy)``; places outside ``mov`` are dropped.

    Both sides: pair_id, y, x, v.  The shift is part of an equi key.
    """
    want = ref.select("pair_id", "y", "x", F.col("v").alias("ref_v"), (F.col("y") + dy).alias("__my"),
                      (F.col("x") + dx).alias("__mx"))
    have = mov.select("pair_id", F.col("y").alias("__my"), F.col("x").alias("__mx"), F.col("v").alias("mov_v"))
    return want.join(have, ["pair_id", "__my", "__mx"]).select("pair_id", "y", "x", "ref_v", "mov_v")


def chunk_with_warmup(
    frames: DataFrame, chunk: int = sound.CHUNK_FRAMES, warmup: int = sound.WARMUP_FRAMES
) -> DataFrame:
    """Copy each frame into its chunk and into every later existing chunk that warms up on it.

    ``keep`` marks the frame's own chunk.  ``frames``: clip_id, t.
    """
    last = frames.groupBy("clip_id").agg(F.max("t").alias("__last"))
    joined = segments.attach(frames, last, ["clip_id"], F.col("t"))
    size = F.lit(chunk)
    own = sound.idiv(F.col("t"), size)
    until = F.least(sound.idiv(F.col("t") + warmup, size), sound.idiv(F.col("__last"), size))
    return joined.withColumn("chunk", F.explode(F.sequence(own, until))).withColumn(
        "keep", F.col("chunk") == sound.idiv(F.col("t"), size)
    ).drop("__last")


def fifo_names(log: DataFrame, **kw) -> DataFrame:
    """Pair queued names with delivered images in order; a failed capture uses up the oldest name.

    ``log``: session_id, arrival, kind (``name`` | ``image`` | ``fail``).  A take from an empty queue
    gives no name and uses none up.  With P takes and N names so far, the takes that found the queue
    empty number max(0, running max of P - N), so every name's place is known without replaying.
    Result: session_id, arrival (of the image), name_arrival (null = none queued).
    """
    keys = ["session_id"]
    take = F.col("kind") != "name"
    step = F.when(take, 1).otherwise(-1)
    counted = segments.scan(
        log.select("session_id", "arrival", "kind"), keys, ["arrival"],
        {"__excess": Scan("sum", step), "__takes": Scan("sum", take.cast("long")),
         "__names": Scan("sum", (~take).cast("long"))},
        **kw,
    )
    missed = segments.scan(
        counted, keys, ["arrival"],
        {"__missed": Scan("max", F.col("__excess")), "__before": Scan("max", F.col("__excess"), strict=True)}, **kw,
    )
    zero = F.lit(0)
    now, before = F.greatest("__missed", zero), F.greatest(F.coalesce("__before", zero), zero)
    names = missed.filter(~take).select("session_id", F.col("__names").alias("__k"), F.col("arrival").alias("name_arrival"))
    takes = missed.filter(take).select(
        "session_id", "arrival", "kind", F.when(now == before, F.col("__takes") - now).alias("__k"))
    paired = takes.filter(F.col("kind") == "image").join(names, ["session_id", "__k"], "left")
    return paired.select("session_id", "arrival", "name_arrival")
