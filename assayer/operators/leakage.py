"""Review of columns that may carry the outcome. Columns are flagged, never dropped."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import dates, text
from assayer.operators import inference
from assayer.operators.normalize import long_form
from assayer.operators.profile import types_of
from assayer.operators.together import run_together

# Thresholds of suspicion.
CORRELATION, ASSOCIATION, SEPARATION, LATE_SHARE, LEAST_ROWS = 0.97, 0.98, 0.995, 0.1, 20


def named_like_outcome(columns: DataFrame, column: str = "column") -> DataFrame:
    """Columns whose name speaks of the outcome or of something after the event."""
    return columns.filter(F.col(column).rlike(text.OUTCOME_LIKE_NAME))


def prediction_time(names) -> str | None:
    """The first column that names a prediction or observation time."""
    return next((n for n in names if re.search(text.PREDICTION_TIME_NAME, n)), None)


def target_correlations(df: DataFrame, target: str, columns) -> DataFrame:
    """Pearson r with the target and complete rows, for all columns in one scan."""
    found = inference.pearson(df, [(c, target) for c in columns])
    return found.select(F.col("left").alias("feature"), "n", F.col("coefficient").alias("correlation"))


def target_associations(df: DataFrame, target: str, columns) -> DataFrame:
    """Cramer's V with the target for columns of 2 to 20 values."""
    found = inference.chi_square(inference.contingency(df, [(c, target) for c in columns]))
    return found.select(F.col("left").alias("feature"), "n", "cramers_v")


def target_separation(df: DataFrame, target: str, columns, rows: int | None = None) -> DataFrame:
    """Rank AUC of each numeric column against a target with two labels, whichever way round."""
    return (inference.mann_whitney(inference.rank_rows(df, [(target, c) for c in columns], rows))
            .select(F.col("numeric").alias("feature"), "n",
                    F.greatest((1 + F.col("rank_biserial")) / 2, (1 - F.col("rank_biserial")) / 2).alias("separation")))


def after_reference(df: DataFrame, events, reference: str) -> DataFrame:
    """Share of complete rows whose event time lies after the reference time, per event column."""
    types = types_of(df)
    at = df.select(*[dates.instant(F.col(f"`{c}`"), types[c].simpleString()).alias(f"t_{c}") for c in [*events, reference]])
    wide = at.selectExpr(*[f"avg(double(`t_{c}` > `t_{reference}`)) AS `a_{c}`" for c in events],
                         *[f"count_if(`t_{c}` IS NOT NULL AND `t_{reference}` IS NOT NULL) AS `n_{c}`" for c in events])
    return long_form(wide, {c: {"n": f"`n_{c}`", "after_share": f"`a_{c}`"} for c in events}, "feature")


def leakage(df: DataFrame, target: str, profile_table: DataFrame) -> DataFrame:
    """One row per suspicious column and reason, with the measured value."""
    meta = {r["column"]: r for r in profile_table.collect()}  # a row per column
    spark, rows = df.sparkSession, next(iter(meta.values()))["total_rows"]
    others = [c for c in df.columns if c != target]
    types = types_of(df)

    def number(c):
        return isinstance(types[c], T.NumericType)

    plain = [c for c in others if not meta[c]["possible_id"]]
    linear = [c for c in plain if number(c) and number(target) and meta[c]["unique"] > 1]
    coded = [c for c in plain if c not in linear and 2 <= meta[c]["unique"] <= 20] if 2 <= meta[target]["unique"] <= 20 else []
    apart = [c for c in plain if c not in linear and c not in coded and number(c)] if meta[target]["unique"] == 2 else []
    reference = prediction_time(df.columns)
    events = [c for c in others if reference and c != reference and meta[c]["kind"] == "datetime"]
    jobs = []

    def add(found, value, reason, limit):
        jobs.append(lambda: [(r["feature"], reason, r[value], r["n"]) for r in found.collect()
                             if r["n"] >= LEAST_ROWS and r[value] is not None and limit(r[value])])

    if linear:
        add(target_correlations(df, target, linear), "correlation", "near-perfect correlation", lambda v: abs(v) >= CORRELATION)
    if coded:
        add(target_associations(df, target, coded), "cramers_v", "near-perfect association", lambda v: v >= ASSOCIATION)
    if apart:
        add(target_separation(df, target, apart, rows), "separation", "separates the outcome alone", lambda v: v >= SEPARATION)
    if events:
        found = after_reference(df, events, reference)
        jobs.append(lambda: [(r["feature"], "after the prediction time", r["after_share"], r["n"]) for r in found.collect()
                             if r["n"] and r["after_share"] > LATE_SHARE])
    flags = [(c, "outcome-like name", None, None) for c in others if re.search(text.OUTCOME_LIKE_NAME, c)]
    for part in run_together(spark, *jobs) if jobs else []:
        flags += part
    return spark.createDataFrame(flags, "feature string, reason string, value double, rows long").withColumn("target", F.lit(target))
