"""Exact contributions of tree models against all orders of three features."""

import itertools

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from assayer.operators.sampling import stable_sample
from assayer.operators.tree_paths import tree_contributions


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(300, 3)), 2)
    label = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 2] > 1)
    made = spark.createDataFrame([(k, *map(float, v), float(y)) for k, (v, y) in enumerate(zip(x, label))], "id int, a double, b double, c double, label double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(made).persist()


def scores(model, spark, points):
    """Outputs of the model for many points."""
    df = spark.createDataFrame([(k, list(map(float, p))) for k, p in enumerate(points)], "k int, x array<double>").select("k", array_to_vector("x").alias("features"))
    out = model.transform(df)
    if "probability" not in out.columns:
        column = F.array("prediction")
    elif "GBT" in type(model).__name__:
        column = F.array(F.element_at(vector_to_array("rawPrediction"), 2))
    else:
        column = vector_to_array("probability")
    return np.array([r.s for r in out.select("k", column.alias("s")).orderBy("k").collect()])


ESTIMATORS = {"tree": lambda: DecisionTreeClassifier(maxDepth=4), "forest": lambda: RandomForestClassifier(numTrees=5, maxDepth=4, seed=1),
              "numbers": lambda: RandomForestRegressor(numTrees=4, maxDepth=5, seed=2), "boosted": lambda: GBTClassifier(maxIter=3, maxDepth=3)}


@pytest.mark.parametrize("name", ESTIMATORS)
def test_equal_to_all_orders(spark, rows, tmp_path, name):
    estimator = ESTIMATORS[name]()
    train = rows.withColumn("label", F.least("label", F.lit(1.0))) if isinstance(estimator, GBTClassifier) else rows
    model = estimator.fit(train)
    some = train.filter("id < 6")
    got = tree_contributions(some, train, model, ["a", "b", "c"], ["id"], f"file://{tmp_path}/model", 8).collect()
    x = np.array([r.features.toArray() for r in some.orderBy("id").collect()])
    z = np.array([r.features.toArray() for r in stable_sample(train, ["id"], 8).collect()])
    masks = list(itertools.product([0, 1], repeat=3))
    mixed = np.array([[[np.where(m, p, q) for m in masks] for q in z] for p in x]).reshape(-1, 3)
    table = scores(model, spark, mixed).reshape(len(x), len(z), len(masks), -1).mean(axis=1)
    at = {m: k for k, m in enumerate(masks)}
    expected = np.zeros((len(x), 3, table.shape[2]))
    for order in itertools.permutations(range(3)):
        mask = [0, 0, 0]
        for f in order:
            before = table[:, at[tuple(mask)]]
            mask[f] = 1
            expected[:, f] += (table[:, at[tuple(mask)]] - before) / 6
    found = np.zeros_like(expected)
    for r in got:
        found[r.id, "abc".index(r.feature), r.output] = r.contribution
        assert r.value == x[r.id, "abc".index(r.feature)]
    assert np.allclose(found, expected, atol=1e-9)
    whole, none = table[:, at[1, 1, 1]], table[:, at[0, 0, 0]]
    assert np.allclose(found.sum(axis=1), whole - none, atol=1e-9)


def test_no_rows_and_a_tree_of_one_leaf(spark, rows, tmp_path):
    model = RandomForestRegressor(numTrees=1, maxDepth=0).fit(rows)
    got = tree_contributions(rows.limit(3), rows, model, ["a", "b", "c"], ["id"], f"file://{tmp_path}/leaf", 4)
    assert [r.contribution for r in got.collect()] == [0.0] * 9
    assert tree_contributions(rows.limit(0), rows, model, ["a", "b", "c"], ["id"], f"file://{tmp_path}/leaf", 4).count() == 0
