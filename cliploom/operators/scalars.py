"""Row-level operators that need more than one column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions import pixel, rates, sound, tags
from cliploom.operators import segments


def anchor_audio(reads: DataFrame, latency_ns: int = sound.INPUT_LATENCY_NS) -> DataFrame:
    """``base_ns`` per clip: the instant of the first read in arrival order, less the input latency."""
    return reads.groupBy("clip_id").agg((F.min_by("read_ns", "arrival") - latency_ns).alias("base_ns"))


def valid_audio_format(formats: DataFrame) -> DataFrame:
    """Keep usable formats; ``subset`` tells whether any decoder must accept the rate."""
    ok = sound.valid_format(F.col("sample_rate"), F.col("channels"), F.col("bit_depth"))
    return formats.filter(ok).withColumn("subset", sound.streamable_subset(F.col("sample_rate")))


def rebase_clock(frames: DataFrame) -> DataFrame:
    """Shift ``ts_ns`` of every frame by one offset per clip, decided by the clip's first frame.

    ``frames``: clip_id, arrival, ts_ns, mono_ns, boot_ns (clock readings at arrival).
    """
    first = frames.groupBy("clip_id").agg(*[F.min_by(c, "arrival").alias(c) for c in ("ts_ns", "mono_ns", "boot_ns")])
    offset = rates.clock_offset(F.col("ts_ns"), F.col("mono_ns"), F.col("boot_ns"))
    offsets = first.select("clip_id", offset.cast("long").alias("offset_ns"))
    return segments.attach(frames, offsets, ["clip_id"], F.col("arrival")).withColumn(
        "ts_ns", F.col("ts_ns") - F.col("offset_ns")
    )


def relative_time(packets: DataFrame) -> DataFrame:
    """``rel_ns``: time since the first packet seen (either track), never negative."""
    anchors = packets.groupBy("clip_id").agg(F.min_by("ts_ns", "arrival").alias("__anchor"))
    joined = segments.attach(packets, anchors, ["clip_id"], F.col("arrival"))
    return joined.withColumn("rel_ns", F.greatest(F.col("ts_ns") - F.col("__anchor"), F.lit(0))).drop("__anchor")


def drop_before_open(packets: DataFrame) -> DataFrame:
    """Only packets from the clip's first ``is_config`` row on; a clip without one keeps nothing."""
    opened = packets.filter("is_config").groupBy("clip_id").agg(F.min("arrival").alias("__open"))
    rows = segments.attach(packets, opened, ["clip_id"], F.col("arrival"))
    return rows.filter(F.col("arrival") >= F.col("__open")).drop("__open")


def first_event(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column]) -> DataFrame:
    """Values of the earliest row per key (partial aggregation before the shuffle)."""
    return df.groupBy(*keys).agg(*[F.min_by(v, order).alias(n) for n, v in values.items()])


def geometry_guard(frames: DataFrame, scope: str, w: int | None = None, h: int | None = None) -> DataFrame:
    """``row``: keep frames of the expected size.  ``burst``: keep bursts whose frames all share
    one size and are all full (``bytes >= 2*w*h``)."""
    if scope == "row":
        return frames.filter((F.col("w") == w) & (F.col("h") == h))
    good = (
        frames.groupBy("burst")
        .agg(
            (
                (F.min("w") == F.max("w"))
                & (F.min("h") == F.max("h"))
                & F.bool_and(F.col("bytes") >= 2 * F.col("w").cast("long") * F.col("h"))
            ).alias("__ok")
        )
    )
    joined = segments.attach(frames, good, ["burst"], few=False)
    return joined.filter("__ok").drop("__ok")


def linearize(pixels: DataFrame, reference_white: Column) -> DataFrame:
    """Per pixel: drop clipped, subtract black, weigh by exposedness.

    ``pixels``: y, x, v, black ARRAY, white (a white of zero or less reads as the reference white).
    """
    white = F.when(F.col("white") > 0, F.col("white")).otherwise(reference_white)
    value = F.col("v").cast("double")
    black = pixel.black_at(F.col("black"), F.col("y"), F.col("x"))
    return (
        pixels.filter(~pixel.is_clipped(value, white))
        .withColumn("lin", pixel.linear_value(value, black))
        .withColumn("weight", pixel.exposure_weight(value, black, white))
    )


def yuv_frames_to_rgb(luma: DataFrame, chroma: DataFrame) -> DataFrame:
    """Full-size luma (image_id, y, x, luma) with half-size chroma (image_id, y, x, u, v)."""
    half = chroma.select("image_id", F.col("y").alias("__cy"), F.col("x").alias("__cx"), "u", "v")
    sited = luma.withColumn("__cy", F.shiftright("y", 1)).withColumn("__cx", F.shiftright("x", 1))
    r, g, b = pixel.yuv_to_rgb(F.col("luma"), F.col("u"), F.col("v"))
    return sited.join(half, ["image_id", "__cy", "__cx"]).select(
        "image_id", "y", "x", r.alias("r"), g.alias("g"), b.alias("b")
    )


def merge_tracks(audio: DataFrame, video: DataFrame) -> DataFrame:
    """One packet queue from nanosecond audio and microsecond video packets."""
    a = audio.select("clip_id", "arrival", F.col("ts").alias("ts_ns"), F.lit(True).alias("is_audio"), "size")
    v = video.select("clip_id", "arrival", (F.col("ts") * 1000).alias("ts_ns"), F.lit(False).alias("is_audio"), "size")
    return a.unionByName(v)


def plan_outputs(requests: DataFrame) -> DataFrame:
    """Files a still request leaves: mode 0 one source; 1 merged only; 2 three sources and the merged one."""
    shots = F.when(F.col("mode") == 0, F.array(F.lit(0))).otherwise(F.array(*[F.lit(i) for i in range(3)]))
    sources = F.when(F.col("mode") == 1, F.array().cast("array<string>")).otherwise(
        F.transform(
            shots,
            lambda i: F.when(F.col("mode") == 0, F.concat("base", F.lit(".dng"))).otherwise(
                F.concat("base", F.lit("_"), i.cast("string"), F.lit(".dng"))
            ),
        )
    )
    merged = F.when(F.col("mode") == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat("base", F.lit(".dng")))
    )
    return requests.select("request_id", "mode", F.explode(F.concat(sources, merged)).alias("path"))


def select_modes(devices: DataFrame) -> DataFrame:
    """Audio source, video mode, codec and still kind from a capability row."""
    usb = (F.col("usb_fd") > 0) & F.col("usb_capture")
    raw = (F.col("raw_w") > 0) & (F.col("raw_h") > 0) & F.col("encoder_ok")
    return devices.select(
        "device",
        F.when(usb, "USB").when(F.col("has_mic"), "INTERNAL").otherwise("NONE").alias("audio"),
        F.when(raw, "RAW_PQ").otherwise("LEGACY_HLG").alias("video"),
        F.when(F.col("has_hevc"), "HEVC").otherwise("AVC").alias("codec"),
        F.when(F.col("has_raw_reader"), "RAW")
        .when(~F.col("raw_video_mode") & F.col("has_yuv_reader"), "YUV")
        .otherwise("NONE")
        .alias("still"),
    )


def _nine(name: str) -> list[Column]:
    return [F.col(name)[i] for i in range(9)]


def derive_colour_matrix(devices: DataFrame) -> DataFrame:
    """``ccm`` ARRAY(9): sensor RGB to linear BT.2020 with every row summing to one.

    ``devices``: device, forward2, illuminant2, forward1, colour1 (row-major arrays, null = not
    reported).  Each step is its own projection, so a step is computed once per device.
    """
    identity = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    # inverse = transposed cofactors over the determinant; a singular matrix reads as the identity
    usable = F.abs("__det") >= 1e-12
    inverse = F.when(usable, F.array(*[F.col("__cofactors")[3 * c + r] / F.col("__det") for r in range(3) for c in range(3)]))
    chosen = (
        F.when(F.col("forward2").isNotNull() & (F.col("illuminant2") == tags.ILLUMINANT_D65), F.col("forward2"))
        .when(F.col("forward1").isNotNull(), F.col("forward1"))
        .otherwise(F.coalesce(inverse, identity))
    )
    a, b = tags.XYZ_D65_TO_BT2020, tags.BRADFORD_D50_TO_D65
    adapt = [F.lit(sum(a[3 * r + k] * b[3 * k + c] for k in range(3))) for r in range(3) for c in range(3)]
    sums = [F.col("__full")[3 * r] + F.col("__full")[3 * r + 1] + F.col("__full")[3 * r + 2] for r in range(3)]
    scale = [F.when(F.abs(s) < 1e-9, 1.0).otherwise(s) for s in sums]
    return (
        devices.withColumn("__cofactors", F.array(*tags.cofactors(_nine("colour1"))))
        .withColumn("__det", sum((F.col("colour1")[i] * F.col("__cofactors")[i] for i in (1, 2)),
                                 F.col("colour1")[0] * F.col("__cofactors")[0]))
        .select("device", chosen.alias("__chosen"))
        .withColumn("__full", F.array(*tags.matrix_product(adapt, _nine("__chosen"))))
        .withColumn("__scale", F.array(*scale))
        .select("device", F.array(*[F.col("__full")[i] / F.col("__scale")[i // 3] for i in range(9)]).alias("ccm"))
    )


def develop_colour(rgb: DataFrame, devices: DataFrame) -> DataFrame:
    """White balance, colour matrix, scale linear 1.0 to a tenth, PQ.  Device values are joined, not recomputed.

    ``rgb``: device, r, g, b (linear).  ``devices``: device, gains ARRAY(3), ccm ARRAY(9).
    """
    balanced = [F.col(n) * F.col("gains")[i] for i, n in enumerate("rgb")]
    known = devices.select("device", "gains", "ccm", F.lit(True).alias("__known"))
    joined = segments.attach(rgb, known, ["device"], few=False).filter("__known")
    mixed = joined.select(
        *[c for c in rgb.columns if c not in "rgb"],
        *[
            (tags.PQ_SCALE * (F.col("ccm")[3 * r] * balanced[0] + F.col("ccm")[3 * r + 1] * balanced[1]
                              + F.col("ccm")[3 * r + 2] * balanced[2])).alias(f"__{n}")
            for r, n in enumerate("rgb")
        ],
    )
    return mixed.select(
        *[c for c in rgb.columns if c not in "rgb"], *[tags.pq_encode(F.col(f"__{n}")).alias(f"{n}_pq") for n in "rgb"]
    )
