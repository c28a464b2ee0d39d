"""Deterministic samples and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.digests import key_hash


def stable_sample(df: DataFrame, key, n: int, strata=None) -> DataFrame:
    """The n rows (per stratum) first in md5 order of the key: the same rows on every run.

    Both forms keep n rows per task before anything moves, so no task sees a whole stratum.
    """
    hashed = df.withColumn("__hash", key_hash(key))
    if strata is None:
        return hashed.orderBy("__hash", *key).limit(n).drop("__hash")
    first = Window.partitionBy(*strata).orderBy("__hash", *key)
    return (hashed.withColumn("__place", F.row_number().over(first)).filter(F.col("__place") <= n)
            .drop("__hash", "__place"))


def page(df: DataFrame, key, offset: int, limit: int) -> DataFrame:
    """Rows offset+1 .. offset+limit in key order with the total row count."""
    rows = df.orderBy(*key).offset(offset).limit(limit)
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("total")).withColumn("__all", F.lit(0)))  # a single row
    return rows.withColumn("__all", F.lit(0)).join(total, "__all").drop("__all")


def scatter(df: DataFrame, x: str, y: str, key, n: int | None = 600) -> DataFrame:
    """Complete pairs of two columns as x and y, sampled to n points unless n is None."""
    if x == y:
        raise ValueError("A scatter needs two different number columns.")
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if n is not None:
        pairs = stable_sample(pairs.select(*dict.fromkeys([*key, x, y])), key, n)
    return pairs.select(F.col(x).alias("x"), F.col(y).alias("y"))


def first_points(df: DataFrame, x: str, y: str, key, n: int = 500) -> DataFrame:
    """The first n complete pairs in key order as x and y."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pairs.orderBy(*key).limit(n).select(F.col(x).alias("x"), F.col(y).alias("y"))
