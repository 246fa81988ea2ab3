"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder with the benchmark tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline set)
BENCH_RUNS     timed runs per query after one warm-up, the median counts (default 1)
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from larderline.queries import REGISTRY
from larderline.session import build_session

HEADLINE = [
    "keyword_flags",
    "having_window",
    "left_join_person",
    "left_join_skewed",
    "label_rejoin",
    "agg_numeric_sum",
    "two_level_sum_mean",
    "person_day_totals",
    "cohort_means",
    "topn_global",
    "topn_per_class",
    "restrict_to_topn",
    "exact_quantiles",
    "box_stats",
    "locf",
    "text_scan_cast",
    "diary_deduplicated",
    "person_diets",
    "supply_protein_by_diet",
    "enriched_diary",
    "intake_by_cohort",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = build_session(
        "larderline-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run_once(spark, name, sf_dir)
        timed = [run_once(spark, name, sf_dir) for _ in range(runs)]
        seconds[name] = round(statistics.median(timed), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    result = {
        "metric": "total warm seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
