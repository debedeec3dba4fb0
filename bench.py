"""Median seconds of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import math
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from ledgerlake import registry

PLAIN = {"q04_exists", *(f"q{i:02d}" for i in range(1, 23))}  # queries of the newest state
SKIP = {"stream_epochs", "stream_user_state"}  # timed by their trigger, not by their plan


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found: dict[str, float] = {}
    registry.QUERIES["q01"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up isn't timed
    for name, query in registry.QUERIES.items():
        if name in SKIP:
            continue
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        found[name] = round(statistics.median(took), 4)
    total = sum(v for n, v in found.items() if n in PLAIN)
    mean = math.exp(statistics.fmean(math.log(v) for n, v in found.items() if n in PLAIN))
    print(json.dumps({"metric": "sum of median seconds, 22 analytical queries and one variant", "value": round(total, 3), "unit": "sec", "geometric_mean": round(mean, 4), "queries": found, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
