"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "discovery_order glob_filter detect_eol checksum create_manifest bundle_job format_plain "
    "format_fence parse_plain parse_fence parse_detected validate_report round_trip "
    "convert_profile extract_plan_skip extract_plan_rename extract_stats session_summary "
    "stream_session_counts diff_changes diff_moved stability source_catalog catalog_commands"
).split()


def main() -> None:
    from sheaf.session import build_session
    from workload import QUERIES, flagship

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.driver.memory": "20g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or ["flagship", *HEADLINE]
    times = {}
    for name in chosen:
        fn = flagship if name == "flagship" else QUERIES[name]
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
        print(f"{name} {best:.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
