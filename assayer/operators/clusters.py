"""Centroid clusters from several starts and diagonal Gaussian mixtures.

A round is one pass over all rows: every task adds up the sums of its rows, one more task those of the tasks,
and the driver sees one number per start, group and column. All starts of k-means move in the same
pass, and so do all fits of ``fit_together``. First centres are drawn from a sample of bounded size;
every round covers all rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which the first centres are drawn.
FIRST_ROWS = 2_000
VARIANCE_FLOOR = 1e-4


def as_array(df: DataFrame, features: str):
    """The features as an array column; they may be a vector."""
    column = F.col(f"`{features}`")
    return column.cast("array<double>") if df.schema[features].dataType.typeName() == "array" else vector_to_array(column)


def added_up(df: DataFrame, features: str, wanted: list[tuple[Callable, int]]) -> list[np.ndarray]:
    """Sums over all rows of what each kernel makes of a matrix of rows, from one pass; rows without features do not count."""
    ends = np.cumsum([size for _, size in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ends[-1])
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total += np.concatenate([kernel(x) for kernel, _ in wanted])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ends[-1])
        for batch in batches:
            for one in batch.column("s"):
                total += np.frombuffer(one.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["s"])

    rows = df.select(as_array(df, features).alias("x")).filter("x IS NOT NULL").mapInArrow(run, "s binary")
    tasks = rows.repartition(1).mapInArrow(add, "s binary")  # a row a task
    return np.split(sum((np.frombuffer(r["s"]) for r in tasks.collect()), np.zeros(ends[-1])), ends[:-1])


def in_step(df: DataFrame, features: str, fits: list[Generator]) -> list:
    """Results of the fits, which ask for a (kernel, size) and get its sum; what they ask for in a round comes from one pass."""
    done, asked = [None] * len(fits), dict.fromkeys(range(len(fits)))
    answers: dict[int, np.ndarray | None] = dict(asked)
    while answers:
        asked = {}
        for k, answer in answers.items():
            try:
                asked[k] = fits[k].send(answer)
            except StopIteration as end:
                done[k] = end.value
        answers = dict(zip(asked, added_up(df, features, list(asked.values())), strict=True)) if asked else {}
    return done


def fit_together(estimators: list, df: DataFrame) -> list:
    """Models of several estimators of the same features, as their own fits make them."""
    features, = {e.features for e in estimators}
    drawn = functools.cache(lambda rows, seed: first_rows(df, features, rows, seed))
    return in_step(df, features, [e.steps(df, drawn) for e in estimators])


def first_rows(df: DataFrame, features: str, rows: int, seed: int) -> np.ndarray:
    """Rows in the order of a seeded hash of their features: the same ones whatever the partitions."""
    x = df.select(as_array(df, features).alias("x")).filter("x IS NOT NULL")
    return np.array([r["x"] for r in x.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(rows).collect()])


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def spread_out(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of the sample, each drawn with a chance in proportion to its distance from those before."""
    chosen = [sample[rng.integers(len(sample))]]
    while len(chosen) < k:
        far = distances(sample, np.array(chosen)).min(axis=1)
        chosen.append(sample[rng.choice(len(sample), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(sample))])
    return np.array(chosen)


# ---- centroids ------------------------------------------------------------------------------------

def lloyd_steps(centres: np.ndarray) -> Generator:
    starts, k, width = centres.shape
    flat = centres.reshape(starts * k, width)

    def kernel(x: np.ndarray) -> np.ndarray:
        far = distances(x, flat).reshape(len(x), starts, k)
        near = far.argmin(axis=2)[:, :, None]
        mine = (near == np.arange(k)).reshape(len(x), starts * k).astype(float)
        return np.concatenate((mine.sum(axis=0), (mine.T @ x).ravel(), np.take_along_axis(far, near, axis=2).sum(axis=(0, 2))))

    got = yield kernel, starts * k * (1 + width) + starts
    n, sums, inertia = got[:starts * k].reshape(starts, k), got[starts * k:-starts].reshape(centres.shape), got[-starts:]
    means = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], centres)
    return n, means, inertia


def lloyd_round(df: DataFrame, features: str, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, means, inertia) of the groups around ``centres`` (start, group, column), for all starts at once.

    A group without rows keeps its centre.
    """
    return in_step(df, features, [lloyd_steps(centres)])[0]


class Centroids:
    """k-means: ``starts`` sets of first centres move together, the one with the least inertia is kept."""

    def __init__(self, k: int, featuresCol: str = "features", starts: int = 10, rounds: int = 100, tolerance: float = 1e-4, seed: int = 42, first: int = FIRST_ROWS):
        self.k, self.features, self.starts, self.rounds, self.tolerance, self.seed, self.first = k, featuresCol, starts, rounds, tolerance, seed, first

    def fit(self, df: DataFrame) -> CentroidModel:
        return fit_together([self], df)[0]

    def steps(self, df: DataFrame, drawn: Callable) -> Generator:
        sample = drawn(self.first, self.seed)
        centres = np.stack([spread_out(sample, self.k, np.random.default_rng([self.seed, s])) for s in range(self.starts)])
        limit, moving = self.tolerance * sample.var(axis=0).mean(), np.ones(self.starts, bool)
        inertia = np.full(self.starts, np.inf)
        for _ in range(self.rounds):
            _, means, inertia[moving] = yield from lloyd_steps(centres[moving])
            still = ((means - centres[moving]) ** 2).sum(axis=(1, 2)) > limit
            centres[moving] = means
            moving[np.flatnonzero(moving)[~still]] = False
            if not moving.any():
                break
        _, _, inertia = yield from lloyd_steps(centres)  # of the last centres
        return CentroidModel(centres[inertia.argmin()], self.features, inertia)


class CentroidModel:
    def __init__(self, centres: np.ndarray, features: str, inertia: np.ndarray):
        self.centres, self.features, self.inertia = centres, features, inertia  # inertia of every start

    def transform(self, df: DataFrame) -> DataFrame:
        """df with ``prediction``, the number of the nearest centre; null without features."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(x: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(x), dtype="Int32")
            there = x.notna().to_numpy()
            if there.any():
                out[there] = distances(np.stack(x[there]), centres).argmin(axis=1)
            return out

        return df.withColumn("prediction", nearest(as_array(df, self.features)))


# ---- mixtures -------------------------------------------------------------------------------------

class Mixture:
    """Weights, means and variances of k groups whose columns are independent."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, variances: np.ndarray):
        self.weights, self.means, self.variances = weights, means, variances

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of every row in every group."""
        inverse = 1 / self.variances
        square = (x * x) @ inverse.T - 2 * x @ (self.means * inverse).T + (self.means * self.means * inverse).sum(axis=1)
        with np.errstate(divide="ignore"):
            return np.log(self.weights) - 0.5 * (np.log(2 * np.pi * self.variances).sum(axis=1) + square)

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of every group in every row, and the log density of the rows."""
        parts = self.log_parts(x)
        most = parts.max(axis=1, keepdims=True)
        total = most + np.log(np.exp(parts - most).sum(axis=1, keepdims=True))
        return np.exp(parts - total), total[:, 0]


def mixture_steps(shares_of, k: int, width: int, floor: float) -> Generator:
    def kernel(x: np.ndarray) -> np.ndarray:
        shares, density = shares_of(x)
        return np.concatenate((shares.sum(axis=0), (shares.T @ x).ravel(), (shares.T @ (x * x)).ravel(), [density.sum()]))

    got = yield kernel, k * (1 + 2 * width) + 1
    n = got[:k] + 10 * np.finfo(float).eps
    means = got[k:k + k * width].reshape(k, width) / n[:, None]
    variances = np.maximum(got[k + k * width:-1].reshape(k, width) / n[:, None] - means * means, 0) + floor
    return Mixture(n / n.sum(), means, variances), float(got[-1])


def mixture_of(shares_of, df: DataFrame, features: str, k: int, width: int, floor: float) -> tuple[Mixture, float]:
    """The mixture that fits the shares best, and the sum of the log densities, from one pass."""
    return in_step(df, features, [mixture_steps(shares_of, k, width, floor)])[0]


class DiagonalMixture:
    """Expectation-maximisation with a variance per group and column, begun from the groups of k-means."""

    def __init__(self, k: int, featuresCol: str = "features", rounds: int = 100, tolerance: float = 1e-3, floor: float = VARIANCE_FLOOR, seed: int = 42):
        self.k, self.features, self.rounds, self.tolerance, self.floor, self.seed = k, featuresCol, rounds, tolerance, floor, seed

    def fit(self, df: DataFrame) -> MixtureModel:
        return fit_together([self], df)[0]

    def steps(self, df: DataFrame, drawn: Callable) -> Generator:
        begun = yield from Centroids(self.k, self.features, starts=1, seed=self.seed).steps(df, drawn)
        centres, width = begun.centres, begun.centres.shape[1]
        rows = df.filter(F.col(f"`{self.features}`").isNotNull()).count()
        mixture, _ = yield from mixture_steps(lambda x: ((distances(x, centres).argmin(axis=1)[:, None] == np.arange(len(centres))).astype(float), np.zeros(len(x))), self.k, width, self.floor)
        likelihood: list[float] = []
        for _ in range(self.rounds):
            better, total = yield from mixture_steps(mixture.shares, self.k, width, self.floor)
            likelihood.append(total / max(rows, 1))  # of the mixture that made the shares
            if len(likelihood) > 1 and abs(likelihood[-1] - likelihood[-2]) < self.tolerance:
                break
            mixture = better
        return MixtureModel(mixture, self.features, likelihood)


class MixtureModel:
    def __init__(self, mixture: Mixture, features: str, likelihood: list[float]):
        self.mixture, self.features, self.likelihood = mixture, features, likelihood  # mean log density of every round

    def transform(self, df: DataFrame) -> DataFrame:
        """df with ``prediction``, the group with the largest share, and ``membership``, all shares; null without features."""
        mixture = self.mixture

        @F.pandas_udf("array<double>")
        def shares(x: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(x), dtype=object)
            there = np.flatnonzero(x.notna().to_numpy())
            if len(there):
                for k, row in zip(there, mixture.shares(np.stack(x.iloc[there]))[0]):
                    out[k] = row
            return out

        most = F.array_position("membership", F.array_max("membership")) - 1
        return df.withColumn("membership", shares(as_array(df, self.features))).withColumn("prediction", most.cast("int"))
