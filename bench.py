"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cliploom import catalog  # noqa: E402
from cliploom.session import build_session  # noqa: E402

HEADLINE = [
    "s1_read_pcm", "s2_explode_raw16", "p3_sample_time", "p8_relative_time", "p12_linearize", "p15_yuv_to_rgb",
    "p19_develop_colour", "t5_largest_encodable", "j1_pair_captures", "j4_newest_neutral", "j5_interleave_tracks",
    "j8_chunk_with_warmup", "j9_fifo_names", "a1_bracket_merge", "a3_complete_bursts", "a8_align",
    "a10_telemetry_windows", "a14_cluster_rollup", "a16_overlap_add", "m1_resample_linear",
    "m2_resample_band_limited", "m3_spectra", "m4_features", "m5_resynthesize", "m7_burst_merge",
    "m8_develop_frames", "m11_smooth_chroma", "m12_split_nals", "w6_running_mean", "w9_assign_clusters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = [n for n in HEADLINE if len(sys.argv) < 2 or n in sys.argv[1:]]
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the JVM and the Python workers once
    times = {}
    for name in names:
        begin = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
