"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and fully executed (``noop`` sink: every row computed,
nothing collected to the driver).  One untimed warm-up pass over the
same queries first, so JVM start-up and JIT warm-up are not charged to
whichever query happens to run first; then ``BENCH_RUNS`` (default 3) timed
passes, reporting each query's median; caches are cleared before each timed
query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "page", "viewer_filter", "flat_table", "mask_text", "stats", "apps", "method_rollup",
    "call_pairs", "open_calls", "tree_thread", "grouped_table", "call_durations", "decode_batch",
    "quota_audit", "drop_repeats", "issues", "latency", "breadcrumbs", "timeline", "anomalies",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["BENCH_CPUS"] = cpus
    from calltrail.session import get_spark
    from calltrail.plans.catalog import QUERIES

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    for n in names:  # warm-up pass: JIT and codegen caches, untimed
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    samples = {n: [] for n in names}
    for _ in range(runs):
        for n in names:
            spark.catalog.clearCache()  # no query reads another's cached data
            t0 = time.perf_counter()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples[n].append(time.perf_counter() - t0)
    times = {n: round(sorted(v)[len(v) // 2], 3) for n, v in samples.items()}  # median
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
