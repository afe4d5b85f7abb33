"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8)
the cores. Each query is written to a no-op sink, so every row and column is
computed; the session is warmed with one query on the smallest data first.
"""

from __future__ import annotations

import json
import os
import time

from termindex.plans.registered import QUERIES
from termindex.session import local_session

HEADLINE = [
    "matcher_inventory", "present_tags", "distinct_tokens", "strip_clike", "strip_dispatch",
    "token_offsets", "mask_regions", "mask_regions_inline", "region_spans", "context_match",
    "extract_symbols", "present_or_same_file", "group_counts", "group_fingerprint", "chunk_members",
    "sort_tags_by_name", "resolve_project", "registry_fold", "emit_on_change", "enabled_gate",
    "latest_wins", "emit_on_change_by_batch", "incremental_index", "scan_tags_gzip",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder), "sf0.001")
    if os.path.isdir(small):
        QUERIES["matcher_inventory"](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    scale = os.path.basename(folder)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale[2:]) if scale.startswith("sf") else scale,
        "cores": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
