"""Multivariate anomaly scores with the columns that drive them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import numbers
from assayer.operators import quantiles as q
from assayer.operators.normalize import quoted
from assayer.operators.together import run_together

TREES_TOGETHER = 8  # trees grown by one call
ROBUST = 1.4826  # fixed value: median absolute deviation to standard deviation


def _q(name: str):
    return F.col(f"`{name}`")


def column_review(df: DataFrame, columns, most: int | None = None) -> DataFrame:
    """One row per column in the given order: finite cells, whether it is scored, and why not.

    A column takes part if it has two different finite values, the table has 20 rows, and no more than
    ``most`` columns come before it.
    """
    cells = [f"named_struct('feature', {quoted(c)}, 'place', {k}, 'cells', count({numbers.finite_sql(c)}), 'varies', coalesce(min({numbers.finite_sql(c)}) < max({numbers.finite_sql(c)}), false))"
             for k, c in enumerate(columns)]
    one = df.selectExpr("count(1) AS rows", f"array({', '.join(cells)}) AS c").selectExpr("rows", "inline(c)")
    ahead = F.sum(F.col("varies").cast("int")).over(Window.partitionBy(F.lit(0)).orderBy("place"))  # a row per column
    reason = F.when(F.col("rows") < 20, "fewer than 20 rows").when(~F.col("varies"), "constant or empty").when(ahead > F.lit(most if most is not None else len(columns)), "beyond the number of columns")
    return one.withColumn("omitted", reason).select("feature", "cells", F.col("omitted").isNull().alias("scored"), "omitted")


def varying_columns(df: DataFrame, columns, most: int | None = None) -> list[str]:
    """The columns that ``column_review`` lets take part."""
    return [r["feature"] for r in column_review(df, columns, most).collect() if r["scored"]] if columns else []


def scaled_columns(df: DataFrame, columns, rows: int | None = None):
    """Columns over their largest magnitude (one at least) with gaps at the median.

    Returns the table with the scaled columns added as s0, s1, ... and the facts per column.
    """
    rows = df.count() if rows is None else rows
    names = [f"s{i}" for i in range(len(columns))]
    clean = df.selectExpr(*[f"{numbers.finite_sql(c)} AS {s}" for c, s in zip(columns, names)])
    top, middle = run_together(df.sparkSession, clean.selectExpr(*[f"max(abs({s})) AS {s}" for s in names]).first, q.medians(clean, names, rows=rows).first)
    factor = {c: max(top[s] or 0.0, 1.0) for c, s in zip(columns, names)}
    middle = {s: None if middle[s] is None else middle[s] / factor[c] for c, s in zip(columns, names)}
    scaled = df.select("*", *[(numbers.finite(_q(c)) / F.lit(factor[c])).alias(s) for c, s in zip(columns, names)])
    filled = scaled.withColumns({s: F.coalesce(F.col(s), F.lit(middle[s])) for s in names})
    return filled, {c: (factor[c], middle[s]) for c, s in zip(columns, names)}


def deviations(df: DataFrame, columns, key, rows: int | None = None) -> DataFrame:
    """Robust deviation of each cell: distance to the median over the scaled median distance.

    A column whose median distance is zero uses its standard deviation.
    """
    rows = df.count() if rows is None else rows
    scaled, facts = scaled_columns(df, columns, rows)
    names = [f"s{i}" for i in range(len(columns))]
    # The median of the filled column is the median it was filled with.
    away = scaled.select(*[F.abs(F.col(s) - F.lit(facts[c][1])).alias(s) for c, s in zip(columns, names)])
    mad = q.medians(away, names, rows=rows).first()
    sd = scaled.agg(*[F.stddev_pop(s).alias(s) for s in names]).first()
    scale = {c: mad[s] * ROBUST if mad[s] > 0 else sd[s] + 1e-9 for c, s in zip(columns, names)}
    return scaled.withColumns({f"d_{c}": F.abs(F.col(s) - F.lit(facts[c][1])) / F.lit(scale[c]) for c, s in zip(columns, names)}).drop(*names)


def drivers(scored: DataFrame, columns, n: int = 3) -> DataFrame:
    """The n strongest deviations per row as (feature, deviation), largest first."""
    listed = F.array(*[F.struct((-_q(f"d_{c}")).alias("d"), F.lit(c).alias("feature")) for c in columns])
    top = F.transform(F.slice(F.array_sort(listed), 1, n), lambda s: F.struct(s["feature"].alias("feature"), (-s["d"]).alias("deviation")))
    return scored.withColumn("drivers", top).drop(*[f"d_{c}" for c in columns])


def worst_rows(scored: DataFrame, key, n: int = 12) -> DataFrame:
    """The n lowest scores among the flagged rows."""
    return scored.filter(F.col("score") < 0).orderBy("score", *key).limit(n)


def flag_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score") < 0).alias("flagged_rows")).withColumn(
        "flagged_pct", numbers.ratio("flagged_rows", "rows") * 100)


def _expected_depth(n):
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(sample: np.ndarray, rng, limit: int):
    """One isolation tree as flat arrays: feature (-1 at a leaf), cut, left child, leaf depth."""
    feature, cut, left, depth = [-1], [0.0], [0], [0.0]
    queue = [(0, np.arange(len(sample)), 0)]
    while queue:
        node, rows, level = queue.pop()
        part = sample[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_columns = np.flatnonzero(high > low)
        if level >= limit or len(rows) <= 1 or not len(open_columns):
            depth[node] = level + float(_expected_depth(len(rows)))
            continue
        j = int(rng.choice(open_columns))
        at = float(rng.uniform(low[j], high[j]))
        goes_left = part[:, j] <= at
        feature[node], cut[node], left[node] = j, at, len(feature)
        for side in (goes_left, ~goes_left):
            feature.append(-1), cut.append(0.0), left.append(0), depth.append(0.0)
            queue.append((len(feature) - 1, rows[side], level + 1))
    return feature, cut, left, depth


def tree_samples(scaled: DataFrame, key, names, trees: int, rows_per_tree: int, rows: int) -> DataFrame:
    """(tree, row values): for every tree the ``rows_per_tree`` rows first in md5 order of its own, out of all rows.

    A row is offered to as many trees as it takes for each to have twice its share on offer, so a
    large table is dealt out once and a small one goes to every tree. Each task keeps
    ``rows_per_tree`` rows per tree before anything moves.
    """
    offers = min(trees, max(1, math.ceil(2 * trees * rows_per_tree / max(rows, 1))))
    first = F.pmod(F.xxhash64(*[_q(k) for k in key]), F.lit(trees))
    offered = scaled.select(*[_q(k) for k in key], *names, F.explode(F.transform(F.sequence(F.lit(0), F.lit(offers - 1)), lambda i: (first + i) % trees)).alias("tree"))
    order = F.md5(F.concat_ws("|", F.col("tree").cast("string"), *[_q(k).cast("string") for k in key]))
    place = Window.partitionBy("tree").orderBy("__order", *key)
    return (offered.withColumn("__order", order).withColumn("__place", F.row_number().over(place)).filter(F.col("__place") <= rows_per_tree)
            .select("tree", "__place", *names))


def isolation_forest(df: DataFrame, columns, key, trees: int = 80, rows_per_tree: int = 256, seed: int = 42, rows: int | None = None) -> DataFrame:
    """All rows with an isolation score: below zero is unusual, the lower the stranger.

    Every tree has its own draw out of all rows and is grown in a task of its own; the finished
    trees are a few hundred kilobytes and every task scores its rows in Arrow batches.
    """
    spark = df.sparkSession
    rows = df.count() if rows is None else rows
    scaled, _ = scaled_columns(df, columns, rows)
    names = [f"s{i}" for i in range(len(columns))]
    psi = max(1, min(rows_per_tree, rows))
    limit = math.ceil(math.log2(max(psi, 2)))

    def build(lot: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, part in lot.groupby("tree"):
            grown = _grow(part.sort_values("__place")[names].to_numpy(dtype=float), np.random.default_rng([seed, int(tree)]), limit)
            out.append((int(tree), *[list(map(float, v)) for v in grown]))
        return pd.DataFrame(out, columns=["tree", "feature", "cut", "left", "depth"])

    drawn = tree_samples(scaled, key, names, trees, rows_per_tree, rows)
    lots = max(1, trees // TREES_TOGETHER)  # a few trees of ``rows_per_tree`` rows each
    grown = drawn.groupBy(F.col("tree") % lots).applyInPandas(build, "tree long, feature array<double>, cut array<double>, left array<double>, depth array<double>").toPandas()
    forest = spark.sparkContext.broadcast([
        (np.array(r.feature, dtype=int), np.array(r.cut), np.array(r.left, dtype=int), np.array(r.depth))
        for r in grown.sort_values("tree").itertuples()])
    usual = float(_expected_depth(psi))

    @F.pandas_udf("double")
    def score(values: pd.DataFrame) -> pd.Series:
        x = values.to_numpy(dtype=float)
        every, total = np.arange(len(x)), np.zeros(len(x))
        for feature, cut, left, depth in forest.value:
            node = np.zeros(len(x), dtype=int)
            for _ in range(limit):
                f = feature[node]
                inner = f >= 0
                right = x[every, np.where(inner, f, 0)] > cut[node]
                node = np.where(inner, left[node] + right, node)
            total += depth[node]
        return pd.Series(0.5 - 2 ** (-total / len(forest.value) / max(usual, 1e-9)))

    return scaled.withColumn("score", score(F.struct(*names))).drop(*names)


def detect(df: DataFrame, columns, key, n: int = 3) -> DataFrame:
    """Every row with score, flag and its strongest deviations."""
    kept = varying_columns(df, columns)
    if not kept:
        raise ValueError("At least 20 rows and one varying numeric column are needed.")
    rows = df.count()
    scored = isolation_forest(deviations(df, kept, key, rows), kept, key, rows=rows)
    return drivers(scored, kept, n).withColumn("flagged", F.col("score") < 0)
