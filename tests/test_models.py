"""Model search: folds and their fallback, judgement beside the baseline, early stopping, dealing of groups."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from assayer.operators import metrics, models, splits


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=600), rng.normal(size=600)
    y = (a + 0.3 * rng.normal(size=600) > 0.5).astype(float)
    rows = [(k, float(p), float(q), float(v), float(3 * p + 0.1 * q), f"2024-01-{1 + k // 20:02d}") for k, (p, q, v) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, label double, amount double, day string").withColumn("day", F.to_timestamp("day")).persist()


def test_search_judges_winner_and_baseline_on_the_same_rows(spark, table):
    parted = splits.random_split(table, ["id"], "label").persist()
    found = models.search(parted, ["id"], "classification", ["a", "b"], [], 2, 2, names=["Baseline", "Logistic regression"])
    assert found.plan.status == "completed" and found.plan.folds == 2 and found.winner == "Logistic regression"
    test = {r.model: r for r in found.test.collect()}
    rows = parted.filter("part = 'test'").count()
    assert test["Baseline"].rows == test[found.winner].rows == rows
    assert test["Baseline"].roc_auc == 0.5 and test[found.winner].roc_auc > 0.9 and test[found.winner].average_precision > test["Baseline"].average_precision + 0.3
    assert [r.threshold for r in found.thresholds.orderBy("threshold").collect()] == list(metrics.THRESHOLDS)


def test_numbers_have_both_metrics(spark, table):
    parted = splits.random_split(table.drop("label").withColumnRenamed("amount", "label"), ["id"])
    found = models.search(parted, ["id"], "regression", ["a", "b"], [], k=2, names=["Baseline", "Ridge regression"])
    test = {r.model: r for r in found.test.collect()}
    assert test["Ridge regression"].r2 > 0.9 and abs(test["Baseline"].r2) < 0.2 and found.thresholds is None


def test_time_folds_without_a_class_fall_back_to_the_validation_part(spark, table):
    late = table.withColumn("label", F.when(F.dayofmonth("day") > 15, F.col("label")).otherwise(0.0))
    parted = splits.chronological_split(late, "day").persist()
    found = models.search(parted, ["id"], "classification", ["a", "b"], [], 2, 3, "chronological", "day", ["Baseline", "Logistic regression"])
    assert found.plan.status == "unavailable" and "validation part" in found.plan.reason and found.plan.folds == 1
    assert {r.fold for r in found.scores.collect()} == {0} and found.winner == "Logistic regression"
    two = splits.fold_plan(table.withColumns({"part": F.lit("train"), "g": F.col("id") % 2}), ["id"], "classification", 3, "group", "g")
    assert two.status == "completed" and two.folds == 2
    one = splits.fold_plan(table.withColumns({"part": F.lit("train"), "g": F.lit(1)}), ["id"], "classification", 3, "group", "g")
    assert one.status == "unavailable" and "groups" in one.reason


def test_a_network_stops_when_the_held_out_rows_say_so(spark, table):
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(table)
    network = models.StoppedNetwork([2, 8, 2])
    fitted = network.fit(ready)
    assert 2 <= len(network.losses) < 12  # it may take twelve steps of ten rounds
    score = models.predictions(fitted, ready, "classification")
    assert metrics.ranking_metrics(score).first()["roc_auc"] > 0.95


def test_groups_are_dealt_to_the_lightest_fold():
    for seed in range(300):
        rng = random.Random(seed)
        k, steps = rng.randint(1, 5), {rng.randint(1, 12): rng.randint(1, 9) for _ in range(rng.randint(0, 7))}
        weight, expected = [0] * k, {}
        for size in sorted(steps, reverse=True):
            for _ in range(steps[size]):
                fold = min(range(k), key=lambda f: (weight[f], f))
                weight[fold] += size
                expected[size, fold] = expected.get((size, fold), 0) + 1
        assert {(s, f): n for s, f, n in splits.dealt_sizes(list(steps.items()), k)} == expected


def test_splits_take_many_classes(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 60 == 7, None).otherwise(F.concat(F.lit("c"), (F.col("id") % 60).cast("string"))).alias("label"))
    parts = {(r.label, r.part): r["count"] for r in splits.random_split(rows, ["id"], "label").groupBy("label", "part").count().collect()}
    assert len(parts) == 180 and {(p, n) for (_, p), n in parts.items()} == {("test", 10), ("validation", 8), ("train", 32)}
    folds = {(r.label, r.fold): r["count"] for r in splits.random_folds(rows, ["id"], 5, "label").groupBy("label", "fold").count().collect()}
    assert len(folds) == 300 and set(folds.values()) == {10}
