"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3, the median counts), BENCH_ALL=1 for every registered query.

The landed tables (updates, reference data, stored series and alerts) are built first and
timed on their own; the queries read them, as they would read an ingested archive.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from routescope.plans import catalog, q_features, q_hijack  # noqa: E402
from routescope.session import local_session  # noqa: E402
from routescope.sources import adapters  # noqa: E402

HEADLINE = (
    "A1_read_update_dump", "A20_build_documents", "B19_leak_fold", "C2_longest_prefix_match", "C4_fake_links",
    "D2_feature_series", "D2_feature_series_global_state", "D11_pair_frequency", "D12_connection_frequency_verdict",
    "D16_common_endings", "E8_gap_sessions", "E10_ewma_band", "F1_origin_hijack", "F2_forged_path", "F4_interception_patterns",
    "F5_leaks", "F7_outage_job", "F11_event_feature_job", "F15_combined_without_forest", "F19_quick_screening",
    "F27_core_links", "J2_tumbling_counts",
)
INGEST = {
    "ingest_paths": adapters.paths, "ingest_updates": adapters.updates, "ingest_prefix2as": adapters.prefix2as,
    "ingest_asrel": adapters.asrel, "ingest_asprob": adapters.asprob, "ingest_traffic": adapters.traffic,
    "ingest_feed": adapters.feed_path, "ingest_feature_series": q_features.series, "ingest_alerts": q_hijack.all_alerts,
}
# Queries whose work is one pass over all updates, for rows per second.
PER_ROW = ("A1_read_update_dump", "D2_feature_series", "C4_fake_links", "B19_leak_fold")


def run(df) -> None:
    """Compute every row and column without bringing them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", cpus, partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name, build in INGEST.items():
        t0 = time.perf_counter()
        build(spark, folder)
        times[name] = round(time.perf_counter() - t0, 3)
    names = catalog.QUERIES if os.environ.get("BENCH_ALL") else HEADLINE
    for name in names:
        took = []
        for _ in range(runs):
            t0 = time.perf_counter()
            run(catalog.QUERIES[name](spark, folder))
            took.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(took), 3)
    rows = adapters.updates(spark, folder).count()
    print(json.dumps({
        "metric": "seconds_headline_queries",
        "value": round(sum(times[n] for n in names), 3),
        "unit": "sec",
        "queries": times,
        "rows_per_sec": {n: round(rows / times[n]) for n in PER_ROW if n in times},
        "update_rows": rows,
        "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
