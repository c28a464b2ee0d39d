"""Boosted trees fitted on the cells of their bins.

A tree asks nothing of a number but its bin, so rows of one cell (bins and class) are one weighted row to it: ``CellBoosting``
finds the library's bins, adds up the weights of the cells in one pass and lets the library fit on the cells. Of numbers in few
columns there are few cells, however many values they have; of many columns there may be as many as rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sampled rows that cuts come from (as in the library), and cells of a part.
CUT_ROWS, CELLS_A_TASK = 10_000, 20_000


class CellBoosting(GBTClassifier):
    """The same estimator; its trees are grown on cells wherever that leaves them as they are."""

    def _fit(self, dataset: DataFrame):
        rowwise = self.getSubsamplingRate() < 1 or self.getMinInstancesPerNode() > 1 or self.isDefined(self.validationIndicatorCol)
        weight = F.col(f"`{self.getWeightCol()}`").cast("double") if self.isDefined(self.weightCol) and self.getWeightCol() else F.lit(1.0)
        rows = dataset.select(F.col(f"`{self.getFeaturesCol()}`").alias("features"), F.col(f"`{self.getLabelCol()}`").cast("double").alias("label"), weight.alias("weight"))
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).first()
        if rowwise or not total["n"]:
            return super()._fit(dataset)
        metadata = rows.schema["features"].metadata
        cuts = bin_cuts(rows, total["n"], total["weight"], self.getMaxBins(), self.getSeed(), categories(metadata))
        cells = cells_of(rows, cuts, metadata).persist()
        try:
            n = cells.count()
            if n < max([2, *categories(metadata).values()]):
                return super()._fit(dataset)
            # No cell is left out of the search for bins, and each bin has its number.
            own = self.copy({self.featuresCol: "features", self.labelCol: "label", self.weightCol: "weight", self.maxBins: max(self.getMaxBins(), math.isqrt(n) + 1, *[len(c) + 1 for c in cuts if c is not None])})
            return CellModel(GBTClassifier._fit(own, cells.coalesce(-(-n // CELLS_A_TASK))), cuts, self.getFeaturesCol(), metadata)
        finally:
            cells.unpersist()


class CellModel:
    def __init__(self, fitted, cuts: list, features: str, metadata: dict):
        self.fitted, self.cuts, self.features, self.metadata = fitted, cuts, features, metadata

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the columns of the model, which sees the bins of the features only."""
        cuts = self.cuts

        @F.pandas_udf("array<double>")
        def binned(x: pd.Series) -> pd.Series:
            return pd.Series(list(bins(np.stack(x), cuts))) if len(x) else pd.Series([], dtype=object)

        ready = df.withColumn("__bins", array_to_vector(binned(vector_to_array(F.col(f"`{self.features}`")))).alias("__bins", metadata=self.metadata))
        return self.fitted.copy({self.fitted.featuresCol: "__bins"}).transform(ready).drop("__bins")


def categories(metadata: dict) -> dict[int, int]:
    """Number of values of each feature that is no number, by position."""
    attributes = metadata.get("ml_attr", {}).get("attrs", {})
    return {**{a["idx"]: 2 for a in attributes.get("binary", [])}, **{a["idx"]: len(a.get("vals", [])) or a.get("num_vals", 2) for a in attributes.get("nominal", [])}}


def bin_cuts(rows: DataFrame, n: int, weight: float, most: int, seed: int, fixed: dict) -> list[np.ndarray | None]:
    """Ends of the bins of every number, as the library finds them: from a sample of rows, cut at even steps of weight."""
    spark, share = rows.sparkSession, min(1.0, max(most * most, CUT_ROWS) / n)
    sampled = rows.select("features", "weight")
    if share < 1:  # the very rows that the library draws
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        drawn = sampled._jdf.rdd().sample(False, share, draw)
        sampled = DataFrame(spark._jsparkSession.createDataFrame(drawn, sampled._jdf.schema()), spark)
    got = sampled.collect()  # CUT_ROWS or so
    x, w = np.array([r["features"].toArray() for r in got]), np.array([r["weight"] for r in got])
    return [None if k in fixed else cuts_of(x[:, k], w, share * weight, min(most, n) - 1) for k in range(x.shape[1])]


def cuts_of(values: np.ndarray, weights: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most ``most`` cuts of one number; zeros weigh what the other values leave of the expected weight."""
    there = values != 0
    distinct, place = np.unique(values[there], return_inverse=True)
    mass = np.bincount(place, weights[there], len(distinct))
    if not len(distinct):
        return np.empty(0)
    if expected - mass.sum() > np.finfo(float).eps * there.sum() * 100:
        at = np.searchsorted(distinct, 0.0)
        distinct, mass = np.insert(distinct, at, 0.0), np.insert(mass, at, expected - mass.sum())
    if len(distinct) - 1 <= most:
        return (distinct[:-1] + distinct[1:]) / 2
    out, step = [], expected / (most + 1)
    upto, wanted = mass[0], step
    for k in range(1, len(distinct)):
        before, upto = upto, upto + mass[k]
        if abs(before - wanted) < abs(upto - wanted):
            out.append((distinct[k - 1] + distinct[k]) / 2)
            wanted += step
    return np.array(out)


def bins(x: np.ndarray, cuts: list) -> np.ndarray:
    """Number of the bin of every value; a value on a cut belongs to the lower bin."""
    return np.column_stack([x[:, k] if c is None else np.searchsorted(c, x[:, k]).astype(float) for k, c in enumerate(cuts)])


def cells_of(rows: DataFrame, cuts: list, metadata: dict) -> DataFrame:
    """features (bins), label and summed weight of every cell; a batch is added up before it moves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight"))
            if len(x) != batch.num_rows or not np.isfinite(x).all() or not (w >= 0).all():
                raise ValueError("Trees need finite features and a weight in every row.")
            table, code = np.column_stack((bins(x, cuts), y)), np.zeros(len(y), np.int64)
            for column in table.T:  # cells seen so far by number, so the numbers stay small
                part, values = pd.factorize(column, use_na_sentinel=False)
                code = pd.factorize(code * len(values) + part)[0]
            keys = table[np.unique(code, return_index=True)[1]]
            features = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * len(cuts)), pa.array(keys[:, :-1].ravel()))
            yield pa.RecordBatch.from_arrays([features, pa.array(keys[:, -1]), pa.array(np.bincount(code, w))], ["b", "label", "weight"])

    added = rows.select(vector_to_array("features").alias("x"), "label", "weight").mapInArrow(run, "b array<double>, label double, weight double")
    summed = added.groupBy("b", "label").agg(F.sum("weight").alias("weight"))
    return summed.select(array_to_vector("b").alias("features", metadata=metadata), "label", "weight")
