"""Perceptrons fitted by passes over packed rows: the same weights as the library's, gradients against differences."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler

from assayer.operators import models, networks


def table(spark, rows: int, parts: int):
    x = spark.range(0, rows, 1, parts).selectExpr("sin(id * 1.7) AS a", "cos(id * id) AS b", "double(id % 3 = 0) AS c", "double(sin(id * 1.7) + cos(id * id) * (id % 3) > 0.2) AS label")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(x)


@pytest.mark.parametrize("rows, parts, rounds", [(1000, 3, 15), (90, 2, 40), (20_000, 2, 6)])  # short last blocks, blocks of one part, several matrices
def test_weights_are_those_of_the_library(spark, rows, parts, rounds):
    df = table(spark, rows, parts)
    settings = {"layers": [3, 7, 4, 2], "maxIter": rounds, "seed": 5}
    theirs, ours = MultilayerPerceptronClassifier(**settings).fit(df), networks.Perceptron(**settings).fit(df)
    assert isinstance(ours, MultilayerPerceptronClassificationModel)
    assert np.allclose(ours.weights.toArray(), theirs.weights.toArray(), rtol=1e-5, atol=1e-6)


def test_gradients_are_differences_of_the_loss():
    rng, layers = np.random.default_rng(3), [3, 5, 4, 3]
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 3, 40).astype(np.int32)
    w = rng.normal(size=sum((a + 1) * b for a, b in zip(layers, layers[1:])))

    def at(w):
        sums = networks.Sums(w, layers, 64)
        sums.add(x, y, 1 / 40)
        return sums.loss, np.concatenate([g.ravel() for g in sums.gradients])

    near = [(at(w + e)[0] - at(w - e)[0]) / 2e-5 for e in np.eye(len(w)) * 1e-5]
    assert np.allclose(at(w)[1], near, atol=1e-7)


def test_rows_without_a_known_class_are_refused(spark):
    df = table(spark, 50, 2).withColumn("label", (models.F.col("label") * 5))
    with pytest.raises(Exception, match="labels from 0 to 1"):
        networks.Perceptron(layers=[3, 4, 2], maxIter=2).fit(df)


def test_a_model_runs_once_a_row_for_all_metrics(spark):
    ran = spark.sparkContext.accumulator(0)

    def scored(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 300, 1, 2).selectExpr("double(id % 2) AS label", "double(id % 3 = 0) AS prediction", "id % 7 / 7 AS score")
    out = models.measure(rows.mapInArrow(scored, rows.schema), "classification", 2)
    assert ran.value == 300 and 0 < out["average_precision"] < 1 and out["accuracy"] == pytest.approx(0.5)
