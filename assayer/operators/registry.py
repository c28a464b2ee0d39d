"""Scoring, scenarios and tables about runs and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.normalize import valid_inputs

CONTRACT = ["task", "target", "metric", "split"]


def score(df: DataFrame, key, model, required, numeric) -> DataFrame:
    """Valid rows of an input table with the model's output columns; no row limit."""
    return model(valid_inputs(df, key, required, numeric))


def scenarios(df: DataFrame, key, changes: dict[str, dict], model, allowed) -> DataFrame:
    """Each row scored as it is and with every named set of changed inputs, side by side."""
    wrong = {c for change in changes.values() for c in change} - set(allowed)
    if wrong:
        raise ValueError("A scenario changes columns that the model does not read: " + ", ".join(sorted(wrong)))
    types = dict(df.dtypes)

    def variant(name, change):
        cells = [(F.lit(change[c]).cast(types[c]) if c in change else F.col(c)).alias(c) for c in df.columns if c not in key]
        return F.struct(F.lit(name).alias("scenario"), *cells)
    rows = df.select(*key, F.inline(F.array(variant("baseline", {}), *[variant(n, c) for n, c in changes.items()])))
    scored = model(rows)
    wide = scored.groupBy(*key).agg(F.max(F.when(F.col("scenario") == "baseline", F.col("score"))).alias("baseline"),
                                    *[F.max(F.when(F.col("scenario") == n, F.col("score"))).alias(n) for n in changes])
    return wide


def input_schema(profile_table: DataFrame, features, most: int = 30) -> DataFrame:
    """Name, type, example and sorted categories (``most`` at most) of each model input."""
    text = F.col("kind") == "categorical"
    return profile_table.filter(F.col("column").isin(list(features))).select(
        "column", F.when(F.col("kind") == "numeric", "number").otherwise("string").alias("type"), F.get("examples", F.lit(0)).alias("example"),
        F.when(text, F.slice(F.array_sort(F.map_keys("category_counts")), 1, most)).alias("categories"))


def leaderboard(runs: DataFrame, by: str = "experiment") -> DataFrame:
    """Best completed run per experiment by selection score, only where all contracts agree.

    ``runs`` has run, status, task, target, metric, split and selection_score; test scores play no part.
    """
    done = runs.filter((F.col("status") == "completed") & F.col("selection_score").isNotNull())
    directed = F.when(F.col("task") == "regression", F.col("selection_score")).otherwise(-F.col("selection_score"))
    best = F.min_by(F.struct("run", "selection_score"), F.struct(directed.alias("d"), F.col("run")))
    one = done.groupBy(by).agg(F.count(F.lit(1)).alias("comparable_runs"), F.count_distinct(F.to_json(F.struct(*CONTRACT))).alias("contracts"), best.alias("best"))
    return one.select(by, "comparable_runs", "contracts", F.when(F.col("contracts") == 1, F.col("best.run")).alias("best_run"),
                      F.when(F.col("contracts") == 1, F.col("best.selection_score")).alias("best_score"))


def dashboard(tables: DataFrame, runs: DataFrame) -> DataFrame:
    """Tables, rows, mean quality; completed models and active runs."""
    t = tables.agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"), F.round(F.avg("quality_score"), 1).alias("average_quality")).withColumn("__all", F.lit(0))
    r = runs.agg(F.count_if((F.col("status") == "completed") & (F.col("task") != "descriptive")).alias("models"),
                 F.count_if(F.col("status").isin("queued", "running")).alias("active_runs")).withColumn("__all", F.lit(0))
    return t.join(F.broadcast(r), "__all").drop("__all")  # single rows


def newest(runs: DataFrame, created: str, key, n: int = 50) -> DataFrame:
    return runs.orderBy(F.desc(created), *key).limit(n)


def referenced(tables: DataFrame, runs: DataFrame, key: str, other: str, negate: bool = False) -> DataFrame:
    """Tables that runs refer to, or that none does."""
    return tables.join(runs.select(F.col(other).alias(key)), key, "left_anti" if negate else "left_semi")


def with_runs(experiments: DataFrame, runs: DataFrame, key: str, facts) -> DataFrame:
    """Experiments with aggregates over their runs; runs are reduced before they meet the experiments."""
    return experiments.join(runs.groupBy(key).agg(*facts), key, "left")
