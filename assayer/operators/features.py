"""Model inputs: exclusions, date parts, imputation, scaling and category codes."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import dates, numbers, text
from assayer.operators import metrics
from assayer.operators import quantiles as q
from assayer.operators.profile import frequencies, types_of

MOST_CATEGORIES, ENCODED, MOST_FEATURES, WIDEST, CELLS = 100, 24, 100, 1200, 512 * 1024 * 1024 // 8


def _q(name: str):
    return F.col(f"`{name}`")


def row_accounting(df: DataFrame, target: str) -> DataFrame:
    """Original, distinct and usable rows with the numbers removed on the way."""
    copies = df.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    return copies.agg(F.sum("__copies").alias("original_rows"), F.count(F.lit(1)).alias("distinct_rows"), F.count(_q(target)).alias("usable_rows")).select(
        "original_rows", (F.col("original_rows") - F.col("distinct_rows")).alias("removed_exact_duplicates"),
        (F.col("distinct_rows") - F.col("usable_rows")).alias("excluded_target_rows"), "usable_rows")


def usable_rows(df: DataFrame, target: str | None) -> DataFrame:
    """Distinct rows with a target."""
    out = df.dropDuplicates()
    return out if target is None else out.filter(_q(target).isNotNull())


def exclusions(profile_table: DataFrame, target: str | None, group: str | None = None) -> DataFrame:
    """Each column with ``reason`` null where it is a model input."""
    named = F.col("column").rlike(text.IDENTIFIER_NAME) & (F.col("cardinality_ratio") > 0.8)
    reason = F.when(F.col("unique") <= 1, "constant or empty column").when(named, "unique identifier").when(
        (F.col("kind") == "categorical") & (F.col("unique") > MOST_CATEGORIES), "high-cardinality text")
    if group is not None:
        reason = F.when(F.col("column") == group, "group split identifier").otherwise(reason)
    rest = profile_table if target is None else profile_table.filter(F.col("column") != target)
    return rest.select("column", "kind", "unique", reason.alias("reason"))


def positive_class(df: DataFrame, target: str, requested: str | None = None) -> str:
    """The requested label or the less frequent of two."""
    counts = {r["class"]: r["rows"] for r in metrics.class_balance(df, target).collect()}  # labels of the target
    if requested is not None:
        if requested not in counts:
            raise ValueError("The requested positive class is not among the labels.")
        return requested
    return min(counts, key=lambda c: (counts[c], c))


def class_guard(df: DataFrame, target: str) -> DataFrame:
    """Can the target be classified: 2 to 20 classes, eight rows each, 40 rows in all."""
    return metrics.class_balance(df, target).agg(
        F.count(F.lit(1)).alias("classes"), F.min("rows").alias("rarest"), F.sum("rows").alias("rows")).withColumn(
        "usable", F.col("classes").between(2, 20) & (F.col("rarest") >= 8) & (F.col("rows") >= 40))


def encoded_width(profile_table: DataFrame, target: str | None) -> DataFrame:
    """Usable inputs and the width of the encoded matrix."""
    usable = ~F.col("constant") & ~F.col("possible_id") & ~((F.col("kind") == "categorical") & (F.col("unique") > MOST_CATEGORIES))
    rest = profile_table if target is None else profile_table.filter(F.col("column") != target)
    width = F.when(F.col("kind") == "datetime", 10).when(F.col("kind") == "numeric", 2).otherwise(F.least(F.lit(ENCODED), F.col("unique")))
    return rest.agg(F.count_if(usable).alias("features"), F.coalesce(F.sum(F.when(usable, width)), F.lit(0)).alias("width"), F.max("total_rows").alias("rows"))


def eligibility(task: str, rows, width, rarest=None):
    """One (family, eligible) pair per model family from table facts given as columns."""
    enough = F.lit(True) if rarest is None else F.coalesce(rarest >= 12, F.lit(True))
    families = {"baseline": F.lit(True), "linear": F.lit(True), "tree": F.lit(True), "ensemble": width <= WIDEST,
                "neural_network": (rows >= 100) & (width <= 256) & enough, "centroid": width <= 800, "probabilistic": width <= 800}
    wanted = ["baseline", "centroid", "probabilistic"] if task == "clustering" else ["baseline", "linear", "tree", "ensemble", "neural_network"]
    if task == "clustering":
        families["baseline"] = F.lit(True)
    return F.array(*[F.struct(F.lit(f).alias("family"), families[f].alias("eligible")) for f in wanted])


def readiness(profile_table: DataFrame, target: str, task: str) -> DataFrame:
    """One row: may a model be trained on this target, and the first reason if not."""
    t = profile_table.filter(F.col("column") == target).select(
        F.col("unique").alias("t_unique"), F.col("kind").alias("t_kind"), F.col("usable_non_missing_rows").alias("t_rows"),
        F.coalesce("usable_minimum_class_count", "minimum_class_count", F.lit(8)).alias("t_least"), (F.col("total_rows") - F.col("duplicates")).alias("distinct_rows"))
    huge = profile_table.agg(F.bool_or("extreme_magnitude").alias("extreme"))
    one = (t.withColumn("__all", F.lit(0)).join(F.broadcast(encoded_width(profile_table, target).withColumn("__all", F.lit(0))), "__all")
           .join(F.broadcast(huge.withColumn("__all", F.lit(0))), "__all").drop("__all"))
    classes = (F.col("t_unique") > 20) | (F.col("t_least") < 8)
    reason = (F.when(F.col("distinct_rows") < 40, "fewer than 40 distinct rows")
              .when((F.col("t_unique") < 2) | (F.lit(task == "classification") & classes), "constant target or too few class examples")
              .when(F.col("t_rows") < 40, "fewer than 40 rows with a target")
              .when(F.lit(task == "regression") & (F.col("t_kind") != "numeric"), "regression needs a numeric target")
              .when((F.col("features") < 1) | (F.col("features") > MOST_FEATURES) | (F.col("width") > WIDEST), "unsupported feature set")
              .when(F.col("extreme"), "extreme magnitudes"))
    return one.select(F.lit(target).alias("target"), F.lit(task).alias("task"), reason.isNull().alias("ready"), reason.alias("reason"), "features", "width")


# ---- transformations ------------------------------------------------------------------------

def date_features(df: DataFrame, columns) -> DataFrame:
    """Year, month, weekday and cyclic month instead of each date column; booleans as numbers."""
    types = types_of(df)
    parts = {}
    for c in columns:
        parts.update(dates.calendar_parts(c, dates.instant(_q(c), types[c].simpleString())))
    clash = sorted(p for p in parts if p in df.columns)
    if clash:
        raise ValueError("Derived date columns would overwrite: " + ", ".join(clash))
    bools = {c: _q(c).cast("double") for c, t in types.items() if isinstance(t, T.BooleanType)}
    return df.withColumns({**bools, **parts}).drop(*columns)


def numeric_facts(df: DataFrame, columns, rows: int | None = None) -> dict[str, tuple[float, bool]]:
    """Median and whether values are missing, per numeric column."""
    clean = df.selectExpr(*[f"{numbers.finite_sql(c)} AS `{c}`" for c in columns])
    middle = q.medians(clean, columns, rows=rows).first()
    gaps = clean.selectExpr(*[f"count_if(`{c}` IS NULL) > 0 AS `{c}`" for c in columns]).first()
    return {c: (middle[c] if middle[c] is not None else 0.0, gaps[c]) for c in columns}


def scaled_numbers(df: DataFrame, columns, facts=None) -> DataFrame:
    """Median-imputed columns and their missing indicators, centred and divided by the population deviation."""
    facts = facts or numeric_facts(df, columns)
    filled = {}
    for c in columns:
        v = numbers.finite(_q(c))
        filled[c] = F.coalesce(v, F.lit(facts[c][0]))
        if facts[c][1]:
            filled[f"{c}__missing"] = v.isNull().cast("double")
    wide = df.withColumns(filled)
    stats = wide.selectExpr(*[e for i, c in enumerate(filled) for e in (f"avg(`{c}`) AS m{i}", f"stddev_pop(`{c}`) AS s{i}")]).first()
    return wide.withColumns({c: (_q(c) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) for i, c in enumerate(filled)})


def category_codes(df: DataFrame, columns, most: int = ENCODED) -> DataFrame:
    """(column, value, code): the most frequent labels by rank; beyond ``most`` the rarest share the last code."""
    cleaned = df.select(*[text.clean(_q(c)).alias(c) for c in columns])
    freq = frequencies(cleaned, columns)
    sizes = F.broadcast(freq.groupBy("column").agg(F.count(F.lit(1)).alias("unique")))  # a row per column
    place = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    # Ranks are needed up to ``most`` only, so each task keeps that many labels per column.
    top = freq.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)
    keep = F.when(F.col("unique") <= most, F.lit(most)).otherwise(F.lit(most - 1))
    return top.join(sizes, "column").filter(F.col("place") <= keep).select("column", "value", F.col("n").alias("rows"), (F.col("place") - 1).alias("code"))


def numeric_names(numeric) -> dict[str, str]:
    """Column of the scaled value per source column."""
    return {c: f"n__{re.sub(r'[^A-Za-z0-9_]', '_', c)}" for c in numeric}


def encoded_sources(spark, numeric, categorical) -> DataFrame:
    """(feature, source) of every column that ``feature_stages`` makes, missing indicators included."""
    rows = [(n + tail, c) for c, n in numeric_names(numeric).items() for tail in ("", "__missing")]
    return spark.createDataFrame(rows + [(f"c__{i}", c) for i, c in enumerate(categorical)], "feature string, source string")


def feature_stages(df: DataFrame, numeric, categorical, output: str = "features") -> Pipeline:
    """Spark ML stages: imputed and scaled numbers with missing indicators, grouped one-hot categories.

    Everything learned here (medians, deviations, label ranks) comes from ``df``, the training rows.
    """
    stages, inputs = [], []
    if numeric:
        facts = numeric_facts(df, numeric)
        names = numeric_names(numeric)
        cells = []
        for c in numeric:
            cells.append((names[c], f"coalesce({numbers.finite_sql(c)}, double('{facts[c][0]!r}'))"))
            if facts[c][1]:
                cells.append((names[c] + "__missing", f"double({numbers.finite_sql(c)} IS NULL)"))
        stats = df.selectExpr(*[e for i, (_, v) in enumerate(cells) for e in (f"avg({v}) AS m{i}", f"stddev_pop({v}) AS s{i}")]).first()
        scaled = ", ".join(f"({v} - double('{stats[f'm{i}']!r}')) / double('{(stats[f's{i}'] or 1.0)!r}') AS `{n}`" for i, (n, v) in enumerate(cells))
        stages.append(SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"))
        inputs += [n for n, _ in cells]
    if categorical:
        codes: dict[str, list] = {}
        for r in category_codes(df, categorical).collect():  # ENCODED labels per column
            codes.setdefault(r["column"], []).append((r["code"], r["value"]))
        cells = []
        for i, c in enumerate(categorical):
            labels = [v for _, v in sorted(codes.get(c, []))]
            quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in labels) or "''"
            most = "'" + (labels[0] if labels else "").replace("\\", "\\\\").replace("'", "\\'") + "'"
            value = f"coalesce(trim(string(`{c}`)), {most})"
            cells.append(f"if({value} IN ({quoted}), {value}, '(other)') AS `c__{i}`")
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__"))
        codes_in = [f"c__{i}" for i in range(len(categorical))]
        stages.append(StringIndexer(inputCols=codes_in, outputCols=[f"{c}_i" for c in codes_in], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}_i" for c in codes_in], outputCols=[f"{c}_v" for c in codes_in], dropLast=False, handleInvalid="keep"))
        inputs += [f"{c}_v" for c in codes_in]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep"))
    return Pipeline(stages=stages)
