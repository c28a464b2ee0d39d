"""Positions, running totals, ranks and gaps over an order, without one task seeing all rows.

Every operator cuts the order into buckets, works inside the buckets and adds what lies
before each bucket. A hash order is cut by the leading digits of the hash, a value order
by approximate quantiles; neither changes the answer, only how the work is spread.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.digests import key_hash

# Up to this many rows one bucket is used; beyond it a bucket has about BUCKET_ROWS distinct values
# until MOST_BUCKETS are reached.
HASH_ROWS = 20_000  # rows of a bucket of leading hash digits
SMALL_ROWS, BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 250_000, 65_536


def _before(totals: DataFrame, by, bucket, names) -> DataFrame:
    """Totals of the earlier buckets. One row per bucket, so the window stays short."""
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, bucket, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__before_{n}") for n in names])


def hash_positions(df: DataFrame, key, within=(), salt: str = "", name: str = "position", rows: int | None = None) -> DataFrame:
    """1-based position of each row in md5 order of its key, counted per ``within`` group.

    The leading hash digits spread even a group that holds most of the rows; there are as many as the
    rows need for buckets of some ``HASH_ROWS``. ``rows``, if known, spares a count.
    """
    rows = df.count() if rows is None else rows
    digits = max(1, math.ceil(math.log(max(1, rows / HASH_ROWS), 16)))
    groups = [*within, "__bucket"]
    hashed = df.withColumn("__hash", key_hash(key, salt)).withColumn("__bucket", F.substring("__hash", 1, digits))
    totals = hashed.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")).withColumn("__all", F.lit(0))
    offsets = _before(totals, ["__all", *within], "__bucket", ["__n"]).drop("__all")
    numbered = hashed.withColumn("__local", F.row_number().over(
        Window.partitionBy(*groups).orderBy("__hash", *key)))
    return (join_groups(numbered, offsets, groups)
            .withColumn(name, F.col("__local") + F.col("__before___n"))
            .drop("__hash", "__bucket", "__local", "__before___n"))


def join_groups(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Inner join on keys in which null equals null; each key comes out once."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, on).drop(*[f"__r_{k}" for k in keys])


def value_buckets(df: DataFrame, value: str, buckets: int, name: str = "__bucket", source: DataFrame | None = None) -> DataFrame:
    """Number of the range bucket of each value, cut at approximate quantiles of all values (of ``source``, if given).

    The cuts are one short list on the driver; groups share them, so no group can have more
    than a bucket's share of the rows in one bucket.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = (df if source is None else source).agg(F.percentile_approx(F.col(value).cast("double"), shares, 4 * buckets)).first()[0] or []
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(edges) == 2:
        return df.withColumn(name, F.lit(0))
    cut = Bucketizer(splits=edges, inputCol="__value", outputCol="__place", handleInvalid="keep")
    placed = cut.transform(df.withColumn("__value", F.col(value).cast("double")))
    return placed.withColumn(name, F.col("__place").cast("int")).drop("__value", "__place")


def bucketed(df: DataFrame, value: str, rows: int | None = None, buckets: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """``__bucket`` for a table of ``rows`` rows at most (counted when not given)."""
    rows = df.count() if rows is None else rows
    if rows <= SMALL_ROWS:
        return df.withColumn("__bucket", F.lit(0))
    return value_buckets(df, value, buckets or min(MOST_BUCKETS, max(16, rows // BUCKET_ROWS)), source=source)


def running_totals(df: DataFrame, value: str, amounts, by=(), rows: int | None = None, buckets: int | None = None,
                   descending: bool = False, source: DataFrame | None = None) -> DataFrame:
    """Adds ``upto_<a>``: the sum of each amount over all rows up to and including equal values.

    The table should be pre-aggregated, so that a value held by a third of all source rows
    is a single row here. ``source``, the rows it was made of, spares making it once more for the cuts.
    """
    by = list(by)
    cut = bucketed(df, value, rows, buckets, source)
    if descending:
        cut = cut.withColumn("__bucket", -F.col("__bucket"))
    key = by or ["__all"]
    cut = cut if by else cut.withColumn("__all", F.lit(0))
    totals = cut.groupBy(*key, "__bucket").agg(*[F.sum(a).alias(a) for a in amounts])
    offsets = _before(totals, key, "__bucket", amounts)
    order = F.col(value).desc() if descending else F.col(value).asc()
    local = Window.partitionBy(*key, "__bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut.withColumns({f"__upto_{a}": F.sum(a).over(local) for a in amounts})
    if rows is not None and rows <= SMALL_ROWS:
        out = summed.withColumns({f"upto_{a}": F.col(f"__upto_{a}") for a in amounts})
    else:
        out = join_groups(summed, offsets, [*key, "__bucket"]).withColumns(
            {f"upto_{a}": F.col(f"__upto_{a}") + F.col(f"__before_{a}") for a in amounts})
    return out.drop("__bucket", "__all", *[f"__upto_{a}" for a in amounts], *[f"__before_{a}" for a in amounts])


def average_ranks(df: DataFrame, value: str, by=(), split=(), rows: int | None = None, buckets: int | None = None) -> DataFrame:
    """Distinct values with their count ``n``, the count ``ties`` over all splits and the average rank.

    One row per (by, value, split); the rank is taken per ``by`` group over all splits.
    """
    by, split = list(by), list(split)
    rows = df.count() if rows is None else rows
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value, *split).agg(F.count(F.lit(1)).alias("n"))
    summed = running_totals(counted, value, ["n"], by, rows, buckets, source=df)
    if not split:
        return summed.withColumn("ties", F.col("n")).withColumn(
            "avg_rank", F.col("upto_n") - (F.col("n") - 1) / 2).drop("upto_n")
    # Few rows per value: one per split label.
    same = Window.partitionBy(*by, value)
    return (summed.withColumn("ties", F.sum("n").over(same))
            .withColumn("avg_rank", F.col("upto_n") - (F.col("ties") - 1) / 2).drop("upto_n"))


def gaps(df: DataFrame, ts: str, by=(), rows: int | None = None, buckets: int | None = None) -> DataFrame:
    """Distinct instants with the seconds since the previous one (null for the first)."""
    by = list(by)
    key = by or ["__all"]
    at = df.filter(F.col(ts).isNotNull()).select(*by, F.unix_micros(F.col(ts).cast("timestamp")).alias("__at"), ts).distinct()
    cut = bucketed(at, "__at", df.count() if rows is None else rows, buckets)
    cut = cut if by else cut.withColumn("__all", F.lit(0))
    ends = cut.groupBy(*key, "__bucket").agg(F.max("__at").alias("__end"))
    ends = ends.withColumn("__prior", F.lag("__end").over(Window.partitionBy(*key).orderBy("__bucket"))).drop("__end")
    ends = ends if by else F.broadcast(ends)  # MOST_BUCKETS rows at most; else Spark may take the instants for the smaller side
    local = Window.partitionBy(*key, "__bucket").orderBy("__at")
    previous = F.coalesce(F.col("__lag"), F.col("__prior"))
    return (cut.withColumn("__lag", F.lag("__at").over(local)).transform(lambda d: join_groups(d, ends, [*key, "__bucket"]))
            .withColumn("gap_seconds", (F.col("__at") - previous) / F.lit(1e6))
            .drop("__bucket", "__all", "__lag", "__prior", "__at"))
