"""Demonstration tables whose rows follow from a key table, so they grow with it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.digests import uniform


def _pick(u, values, weights=None):
    weights = weights or [1 / len(values)] * len(values)
    edge, chosen = 1.0, F.lit(values[-1])
    for value, weight in reversed(list(zip(values[:-1], weights[:-1]))):
        edge = sum(weights[: values.index(value) + 1])
        chosen = F.when(u < edge, value).otherwise(chosen)
    return chosen


def _normal(key, salt):
    u = F.greatest(uniform(key, salt + "a"), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(key, salt + "b"))


def _poisson(u, rate, top=12):
    total = term = math.exp(-rate)
    value = F.lit(top)
    steps = [(0, total)]
    for k in range(1, top):
        term *= rate / k
        total += term
        steps.append((k, total))
    for k, edge in reversed(steps):
        value = F.when(u < edge, k).otherwise(value)
    return value


def churn(ids: DataFrame, key: str = "id") -> DataFrame:
    """Customers with a churn label whose odds follow tenure, price, contract and tickets."""
    k = [key]
    rows = ids.select(
        F.col(key),
        F.format_string("CUS-%05d", F.col(key).cast("long")).alias("customer_id"),
        (F.floor(uniform(k, "tenure") * 72) + 1).cast("long").alias("tenure_months"),
        F.round(20 + uniform(k, "charge") * 100, 2).alias("monthly_charges"),
        _pick(uniform(k, "contract"), ["Monthly", "Annual", "Two year"], [0.55, 0.3, 0.15]).alias("contract_type"),
        _poisson(uniform(k, "tickets"), 1.2).cast("long").alias("support_tickets"),
        # A gamma of shape 3 is the sum of three exponentials.
        F.when(uniform(k, "gap") >= 55 / 2200, F.round(
            -8 * sum(F.log(F.greatest(uniform(k, f"usage{i}"), F.lit(1e-12))) for i in range(3)), 1)).alias("usage_gb"),
        _pick(uniform(k, "payment"), ["Card", "Bank transfer", "Electronic check"]).alias("payment_method"))
    score = (-0.4 - F.col("tenure_months") / 35 + (F.col("monthly_charges") - 60) / 55
             + F.when(F.col("contract_type") == "Monthly", 1.1).otherwise(0.0) + F.col("support_tickets") * 0.45)
    label = F.when(uniform(k, "churn") < 1 / (1 + F.exp(-score)), "Yes").otherwise("No")
    return rows.withColumn("churn", label)


def revenue(ids: DataFrame, key: str = "id") -> DataFrame:
    """Shops whose revenue is linear in spend, size and staff, with noise."""
    k = [key]
    rows = ids.select(
        F.col(key),
        F.round(100 + uniform(k, "spend") * 9900, 2).alias("advertising_spend"),
        (F.floor(uniform(k, "size") * 3600) + 400).cast("long").alias("store_size"),
        _pick(uniform(k, "region"), ["North", "South", "East", "West"]).alias("region"),
        (F.floor(uniform(k, "staff") * 27) + 3).cast("long").alias("employees"))
    return rows.withColumn("monthly_revenue", F.round(
        F.col("advertising_spend") * 3.2 + F.col("store_size") * 12 + F.col("employees") * 450
        + _normal(k, "noise") * 6000, 2))


def monthly_panel(regions: DataFrame, region: str, start: str = "2022-01-01", months: int = 48) -> DataFrame:
    """One row per month and region with a falling trend and a level per region."""
    first = F.to_date(F.lit(start))
    grid = regions.select(F.col(region).alias("region")).select(
        F.explode(F.sequence(first, F.add_months(first, months - 1), F.expr("interval 1 month"))).alias("order_date"), "region")
    k = ["region", "order_date"]
    step = F.months_between(F.col("order_date"), first)
    level = (uniform(["region"], "level") - 0.5) * 30
    return grid.select(
        F.col("order_date").cast("timestamp").alias("order_date"), "region",
        F.round(10 + uniform(k, "price") * 20, 2).alias("price"),
        F.round(240 - step * 120 / (months - 1) + level + _normal(k, "sales") * 5, 2).alias("sales"))


def generate(spark: SparkSession, kind: str = "churn", rows: int = 2200) -> DataFrame:
    """A demonstration table on a plain number range."""
    if kind == "temporal":
        names = spark.range(4).select(F.element_at(F.array(*[F.lit(n) for n in ("North", "South", "East", "West")]),
                                                   (F.col("id") + 1).cast("int")).alias("name"))
        return monthly_panel(names, "name")
    build = {"churn": churn, "sales": revenue}[kind]
    return build(spark.range(rows)).drop("id")
