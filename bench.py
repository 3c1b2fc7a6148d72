"""Time the headline queries: ``BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, one JSON line.

Every query is run once to warm up and then ``BENCH_RUNS`` times, rows going to the noop sink; the
median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from access_engine.session import local_session
from checks import QUERIES

HEADLINES = [
    "lgu_band_share",
    "province_band_share",
    "overlay_union_or",
    "catch_uncovered",
    "catch_by_facility",
    "summary_grouping_sets",
    "season_compare_zone",
    "polygonize_components",
    "uncovered_boundary",
    "geojson_features",
    "ridge_density_season",
    "chart_lgu_bands",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1))))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, partitions=cores)
    times = {}
    for name in HEADLINES:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    scale = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_median_warm_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
