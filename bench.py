"""Time the headline queries: one warm run each, then the median of three, into the ``noop`` sink.

Prints one JSON line.  ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from gridcanopy.plans import catalogue

HEADLINE = (
    "metric_flagship",
    "metric_percentiles",
    "metric_cover_above_mean",
    "stratum_cover",
    "csm_footprint",
    "csm_smooth_fill",
    "zonal_rumple",
    "intensity_mean",
    "dem_bilinear",
    "normalize_heights",
    "topo_aspect",
    "topo_tpi",
    "tao_candidates",
    "tao_segments",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
