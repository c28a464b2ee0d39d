"""Warm timings of the headline operations; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from assayer.operators import anomaly, inference, normalize, temporal  # noqa: E402
from assayer.operators import profile as P  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]


def session() -> SparkSession:
    return (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
            .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            # Column call sites are recorded for error messages only and cost a stack walk per expression.
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            # A profile has more generated classes than the default cache of 100 keeps, so every run would compile anew.
            .config("spark.sql.codegen.cache.maxEntries", "5000")
            .getOrCreate())


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    n = int(CPUS)
    # The reference table of the published numbers: 100,000 rows, two normal columns, one label.
    small = spark.range(0, 100_000, 1, n).select(
        "id", F.randn(42).alias("a"), F.randn(43).alias("b"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.floor(F.rand(44) * 3) + 1).cast("int")).alias("segment")).persist()
    small.count()
    columns = small.drop("id")
    line = normalize.normalize(spark.read.parquet(f"{FOLDER}/lineitem.parquet")).repartition(n).persist()
    line.count()
    small_profile, line_profile = P.profile(columns).cache(), P.profile(line).cache()
    line_profile.count(), small_profile.count()

    def series():
        made = temporal.calendar_series(line, "l_shipdate", "l_quantity", ["l_returnflag"], frequency="MS")
        temporal.trend(made).collect()

    queries = {
        "profile_100k": lambda: P.profile(columns).collect(),
        "tests_100k_sample5000": lambda: inference.test_pairs(small, small_profile, ["a", "b", "segment"], key=["id"], sample=5000).collect(),
        "tests_100k_all_rows": lambda: inference.test_pairs(columns, small_profile, ["a", "b", "segment"]).collect(),
        "forest_100k_all_rows": lambda: anomaly.flag_summary(anomaly.isolation_forest(small, ["a", "b"], ["id"], rows=100_000)).collect(),
        "profile_lineitem": lambda: P.profile(line).collect(),
        "tests_lineitem": lambda: inference.test_pairs(line, line_profile, LINE).collect(),
        "series_lineitem": series,
    }
    took = {}
    for name, run in queries.items():
        times = []
        for _ in range(RUNS + 1):  # the first run compiles
            started = time.perf_counter()
            run()
            times.append(time.perf_counter() - started)
        took[name] = round(min(times[1:]), 3)
    print(json.dumps({"metric": "headline_operations", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(FOLDER.rstrip("/")), "cpus": n, "warm": True}))
    spark.stop()


if __name__ == "__main__":
    main()
