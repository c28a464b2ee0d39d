"""Computed evidence as one table, and the findings and next steps that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators import metrics

# Order of severities and confidences.
SEVERITY = {"high": 0, "medium": 1, "low": 2}
CONFIDENCE = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
ACTIONS = {
    "data_quality": "Go through missing, invalid and repeated records with the data owner and run the analysis again.",
    "association": "Check the association in other segments or new data; only an experiment shows what causes what.",
    "group_difference": "Check how the groups are defined and confirm the difference on independent data.",
    "trend": "Check that periods are complete and the mix of segments is stable before explaining the trend.",
    "anomaly": "Have the flagged records looked at by someone who knows the domain; keep valid rare events.",
    "risk": "Clear up the leakage or imbalance concern before results are used.",
    "model": "Compare test error, gain over the baseline, stability and calibration with what the use requires.",
}

SCHEMA = """kind string, title string, method string, left string, right string, status string, sample_rows long,
population_rows long, p_value double, q_value double, significant boolean, effect double, measure string, strength string,
sparse boolean, dependent boolean, flagged_rows long, flagged_pct double, minority_share double, severe boolean,
growth_pct double, trend string, frequency string, periods long, missing_periods long, missing_cells long,
missing_pct double, duplicates long, invalid_values long, flags long, metric string, test_score double,
stability string, beats_baseline boolean, features string"""


def shaped(df: DataFrame, **values) -> DataFrame:
    """Rows in the shape of the evidence table."""
    from pyspark.sql import types as T
    return df.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(SCHEMA).fields])


def from_tests(tests: DataFrame) -> DataFrame:
    """Evidence rows of association and group-difference tests."""
    dependent = F.exists("notes", lambda n: n.startswith("Temporal") | n.startswith("Duplicate"))
    group = F.col("kind") == "group_difference"
    title = F.when(group, F.concat_ws(" by ", "right", "left")).otherwise(F.concat_ws(" and ", "left", "right"))
    return shaped(tests, kind=F.col("kind"), title=title, method=F.col("method"), left=F.col("left"), right=F.col("right"), status=F.col("status"),
                  sample_rows=F.col("n"), population_rows=F.col("population"), p_value=F.col("p_value"), q_value=F.col("q_value"), significant=F.col("significant"),
                  effect=F.col("effect"), measure=F.col("measure"), strength=F.col("strength"), sparse=F.coalesce("sparse", F.lit(False)), dependent=dependent)


def from_profile(totals: DataFrame) -> DataFrame:
    """The data-quality row from the table totals."""
    return shaped(totals, kind=F.lit("data_quality"), title=F.lit("Data quality"), method=F.lit("Direct counts and per-column IQR"), status=F.lit("completed"),
                  sample_rows=F.col("rows"), population_rows=F.col("rows"), missing_cells=F.col("missing_cells"), missing_pct=F.col("missing_pct"),
                  duplicates=F.col("duplicates"), invalid_values=F.col("invalid_values"))


def from_temporal(summary: DataFrame, measure: str, date: str) -> DataFrame:
    return shaped(summary, kind=F.lit("temporal"), title=F.lit(f"{measure} over time"), method=F.lit("Calendar aggregation and linear trend"), left=F.lit(date),
                  right=F.lit(measure), status=F.lit("completed"), sample_rows=F.col("usable_rows"), growth_pct=F.col("latest_growth_pct"), trend=F.col("trend"),
                  frequency=F.col("frequency"), periods=F.col("periods"), missing_periods=F.col("missing_periods"))


def from_anomalies(summary: DataFrame) -> DataFrame:
    return shaped(summary, kind=F.lit("anomaly"), title=F.lit("Multivariate anomalies"), method=F.lit("Isolation forest"), status=F.lit("completed"),
                  sample_rows=F.col("rows"), population_rows=F.col("rows"), flagged_rows=F.col("flagged_rows"), flagged_pct=F.col("flagged_pct"))


def from_leakage(flags: DataFrame, target: str) -> DataFrame:
    one = flags.agg(F.count_distinct("feature").alias("flags"), F.array_join(F.sort_array(F.collect_set("feature")), ", ").alias("features"))  # at most the columns of a table
    return shaped(one, kind=F.lit("leakage"), title=F.lit("Target leakage"), method=F.lit("Name, time and association review"), left=F.lit(target),
                  status=F.lit("completed"), flags=F.col("flags"), features=F.col("features"))


def from_balance(balance: DataFrame, target: str) -> DataFrame:
    one = balance.agg(F.min("minority_share").alias("m"), F.bool_or("severe").alias("s"), F.sum("rows").alias("rows"))
    return shaped(one, kind=F.lit("imbalance"), title=F.lit("Class imbalance"), method=F.lit("Class shares"), left=F.lit(target), status=F.lit("completed"),
                  sample_rows=F.col("rows"), minority_share=F.col("m"), severe=F.col("s"))


def from_model(folds: DataFrame, test_scores: DataFrame, winner: str, baseline: str = "Baseline", flags: int = 0) -> DataFrame:
    """The model row: fold scores by name give the stability, (name, score, rows) on the test part the score and the comparison."""
    steady = metrics.stability(folds.filter((F.col("name") == winner) & F.col("score").isNotNull()), ["name", "metric"]).select("metric", F.col("status").alias("steady"))
    scores = test_scores.agg(F.max(F.when(F.col("name") == winner, F.col("score"))).alias("score"), F.max(F.when(F.col("name") == baseline, F.col("score"))).alias("base"),
                             F.max("rows").alias("rows"))
    one = steady.withColumn("__all", F.lit(0)).join(F.broadcast(scores.withColumn("__all", F.lit(0))), "__all")  # a single row
    return shaped(one, kind=F.lit("model"), title=F.lit(winner), method=F.lit("Comparison on folds, one test"), status=F.lit("completed"), sample_rows=F.col("rows"),
                  metric=F.col("metric"), test_score=F.col("score"), stability=F.col("steady"), beats_baseline=metrics.beats_baseline("metric", "score", "base"), flags=F.lit(flags))


def evidence(*results: DataFrame) -> DataFrame:
    """One table with ids e001, e002, ... in the order of the results, then left, right and method."""
    out = None
    for place, r in enumerate(results):
        one = r.withColumn("step", F.lit(place))
        out = one if out is None else out.unionByName(one)
    order = Window.partitionBy(F.lit(0)).orderBy("step", "left", "right", "method")  # one row per computed result
    return out.withColumn("place", F.row_number().over(order)).withColumn("id", F.format_string("e%03d", "place"))


def confidence():
    """HIGH, MEDIUM or LOW by rule, from the columns of the evidence table."""
    kind, n, q, size = F.col("kind"), F.col("sample_rows"), F.coalesce("q_value", F.lit(1.0)), F.coalesce("strength", F.lit("negligible"))
    sparse, dependent = F.coalesce("sparse", F.lit(False)), F.coalesce("dependent", F.lit(False))
    tests = (F.when((q < 0.01) & size.isin("moderate", "large") & (n >= 100) & ~sparse & ~dependent, "HIGH")
             .when((q < 0.05) & (size != "negligible") & (n >= 30) & ~sparse, "MEDIUM").otherwise("LOW"))
    model = (F.when(F.coalesce("flags", F.lit(0)) > 0, "LOW")
             .when((F.col("stability") == "stable") & (n >= 100) & F.coalesce("beats_baseline", F.lit(False)), "HIGH")
             .when(n >= 40, "MEDIUM").otherwise("LOW"))
    temporal = F.when((F.coalesce("missing_periods", F.lit(1)) == 0) & (F.coalesce("periods", F.lit(0)) >= 24), "MEDIUM").otherwise("LOW")
    return (F.when(kind == "data_quality", "HIGH").when(kind.isin("association", "group_difference"), tests)
            .when(kind == "model", model).when(kind == "temporal", temporal).otherwise("LOW"))


def findings(table: DataFrame, most: int | None = 16) -> DataFrame:
    """Findings with severity and confidence, the most severe first."""
    kind = F.col("kind")
    tests = kind.isin("association", "group_difference")
    keep = (F.col("status") == "completed") & (
        kind.isin("data_quality", "temporal", "anomaly", "model") | (tests & F.coalesce("significant", F.lit(False)))
        | ((kind == "leakage") & (F.col("flags") > 0)) | ((kind == "imbalance") & F.col("severe")))
    severity = (F.when(kind == "data_quality", F.when((F.col("missing_pct") > 10) | (F.col("invalid_values") > 0), "high").otherwise("medium"))
                .when(tests, F.when(F.col("strength") == "large", "high").otherwise("medium"))
                .when(kind == "temporal", F.when(F.abs("growth_pct") >= 10, "high").otherwise("medium"))
                .when(kind.isin("leakage", "imbalance"), "high").otherwise("medium"))
    type_ = F.when(kind == "temporal", "trend").when(kind.isin("leakage", "imbalance"), "risk").otherwise(kind)
    finding = (F.when(kind == "data_quality", F.format_string("%,d rows, %,d missing cells, %,d exact duplicates and %,d invalid values.",
                                                              "sample_rows", "missing_cells", "duplicates", "invalid_values"))
               .when(tests, F.concat("title", F.format_string(": adjusted p = %.4g, %s = %.4g; ", "q_value", "measure", "effect"), "strength", F.lit(" observed effect.")))
               .when(kind == "temporal", F.concat("right", F.lit(" has a "), "trend", F.format_string(" trend across %d %s periods.", "periods", "frequency"),
                                                  F.coalesce(F.format_string(" Latest change: %+.2f%%.", "growth_pct"), F.lit(""))))
               .when(kind == "anomaly", F.format_string("%d of %d rows (%.2f%%) were flagged for review.", "flagged_rows", "sample_rows", "flagged_pct"))
               .when(kind == "leakage", F.concat(F.format_string("%d columns may carry the outcome: ", "flags"), F.coalesce("features", F.lit("")), F.lit(".")))
               .when(kind == "imbalance", F.format_string("The smallest class holds %.2f%% of the labelled rows.", F.col("minority_share") * 100))
               .otherwise(F.format_string("%s was selected; test %s = %.4g.", "title", "metric", "test_score")))
    ranks = lambda c, values: F.element_at(F.create_map(*[v for k, r in values.items() for v in (F.lit(k), F.lit(r))]), F.col(c))
    found = table.filter(keep).select(
        F.col("id").alias("evidence_id"), F.col("place").alias("evidence_place"), type_.alias("type"), severity.alias("severity"), confidence().alias("confidence"), finding.alias("finding"))
    out = found.orderBy(ranks("severity", SEVERITY), ranks("confidence", CONFIDENCE), "evidence_place")
    return out if most is None else out.limit(most)


def recommendations(found: DataFrame, most: int = 8) -> DataFrame:
    """The next step of the first finding of each type."""
    rank = {"severity": SEVERITY, "confidence": CONFIDENCE}
    order = [F.element_at(F.create_map(*[v for k, r in rank[c].items() for v in (F.lit(k), F.lit(r))]), F.col(c)) for c in rank]
    first = Window.partitionBy("type").orderBy(*order, "evidence_place")
    texts = F.create_map(*[v for k, a in ACTIONS.items() for v in (F.lit(k), F.lit(a))])
    return (found.withColumn("__place", F.row_number().over(first)).filter(F.col("__place") == 1)
            .withColumn("action", F.coalesce(F.try_element_at(texts, F.col("type")), F.lit("Confirm the finding with independent evidence.")))
            .orderBy(*order, "evidence_place").limit(most).select("type", "evidence_id", "action"))


def hypotheses(table: DataFrame) -> DataFrame:
    """One row per test with q-value: statement, its null, what was observed, conclusion, status and confidence."""
    tests = table.filter(F.col("kind").isin("association", "group_difference") & F.col("q_value").isNotNull())
    statement = F.when(F.col("kind") == "association", F.format_string("%s goes together with %s.", "left", "right")).otherwise(
        F.format_string("%s is not the same in all groups of %s.", "right", "left"))
    null = F.when(F.col("kind") == "association", F.format_string("Knowing %s says nothing about %s.", "left", "right")).otherwise(
        F.format_string("%s is the same in all groups of %s.", "right", "left"))
    seen = F.concat(F.format_string("%d rows", "sample_rows"), F.coalesce(F.format_string(", %s %.4f", "measure", "effect"), F.lit("")))
    order = Window.partitionBy(F.lit(0)).orderBy("place")  # one row per test
    return tests.select(
        F.format_string("h%03d", F.row_number().over(order)).alias("id"), F.col("id").alias("evidence_id"), statement.alias("hypothesis"), null.alias("null_hypothesis"), seen.alias("observation"),
        "method", "p_value", "q_value", "effect", "measure",
        F.when(F.col("significant"), "The adjusted test speaks against chance.").otherwise("Chance is not ruled out.").alias("conclusion"),
        F.when(F.col("significant"), "supported_exploratory").otherwise("inconclusive").alias("status"), confidence().alias("confidence"))


def group_provenance(table: DataFrame) -> DataFrame:
    """Which tests compared groups."""
    groups = table.filter((F.col("kind") == "group_difference") & (F.col("status") == "completed"))
    return groups.agg(F.count(F.lit(1)).alias("tests"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("evidence_ids")).withColumn(  # one id per pair of columns
        "status", F.when(F.col("tests") > 0, "completed").otherwise("skipped"))
