"""Independent Spark jobs side by side, so that their fixed costs and stragglers overlap."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def run_together(spark: SparkSession, *jobs):
    """Results of the callables, in order; the first error is raised."""
    if len(jobs) == 1:
        return [jobs[0]()]
    share = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=min(8, max(1, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(share(job)) for job in jobs]]
