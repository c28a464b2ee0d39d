"""Boosted trees on cells: the same scores as the library's on the rows, from fewer rows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from assayer.operators import boosting


def table(spark, rows: int):
    x = spark.range(0, rows, 1, 3).selectExpr("id", "sin(id * 1.7) AS a", "floor(cos(id * id) * 40) / 8 AS b", "double(id % 3) AS c", "1.0 + id % 5 AS weight")
    x = x.withColumn("label", (F.col("a") * (F.col("c") + 1) + F.col("b") / 5 + F.sin(F.col("id") * 0.37) / 2 > 0.3).cast("double"))
    coded = OneHotEncoder(inputCols=["c"], outputCols=["v"], dropLast=False).fit(x).transform(x)
    return VectorAssembler(inputCols=["a", "b", "v"], outputCol="features").transform(coded)


@pytest.mark.parametrize("rows, most", [(700, 32), (25_000, 32), (700, 5)])  # all rows decide the bins, sampled ones do; few bins
def test_scores_are_those_of_the_library(spark, rows, most):
    df = table(spark, rows)
    settings = {"weightCol": "weight", "maxIter": 3, "maxDepth": 4, "maxBins": most, "seed": 7}
    theirs, ours = GBTClassifier(**settings).fit(df), boosting.CellBoosting(**settings).fit(df)
    assert isinstance(ours, boosting.CellModel) and max(len(c) for c in ours.cuts if c is not None) <= most
    pick = lambda model: np.array([[r["id"], r["p"], r["prediction"]] for r in model.transform(df).select("id", vector_to_array("probability")[1].alias("p"), "prediction").orderBy("id").collect()])
    assert np.allclose(pick(ours), pick(theirs), atol=1e-9)


def test_trees_read_cells_and_not_rows(spark):
    df = table(spark, 20_000).select("features", "label", F.lit(2.0).alias("weight"))
    cuts = [np.array([0.0]), np.array([-1.0, 1.0]), None, None, None]
    cells = boosting.cells_of(df, cuts, df.schema["features"].metadata)
    assert cells.count() <= 2 * 3 * 3 * 2 and cells.agg(F.sum("weight")).first()[0] == 40_000
    assert boosting.bins(np.array([[0.0, 1.5, 1, 0, 0], [0.1, 1.0, 0, 1, 0]]), cuts).tolist() == [[0, 2, 1, 0, 0], [1, 1, 0, 1, 0]]


def test_what_cells_cannot_say_is_fitted_on_rows(spark):
    assert not isinstance(boosting.CellBoosting(maxIter=1, minInstancesPerNode=3).fit(table(spark, 200)), boosting.CellModel)
    with pytest.raises(Exception, match="finite features"):
        boosting.CellBoosting(maxIter=1).fit(VectorAssembler(inputCols=["a", "d"], outputCol="features", handleInvalid="keep").transform(
            table(spark, 200).drop("features").withColumn("d", F.when(F.col("id") != 7, 1.0).otherwise(float("nan")))))
