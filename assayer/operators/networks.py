"""Perceptrons fitted by passes over packed rows.

``Perceptron`` minimises what ``MultilayerPerceptronClassifier`` minimises, by the same steps (L-BFGS with a strong Wolfe
search, as in Breeze), and leaves the same kind of model. Only the sums of a pass are made differently: rows are packed
into matrices once, and a task multiplies whole matrices. The driver sees one number per weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.models import even_parts

#: Blocks of rows in a packed matrix, and rows multiplied at once.
BLOCKS, AT_ONCE = 64, 1_024


class SearchFailed(ArithmeticError):
    """No step along the direction is good enough."""


class Perceptron(MultilayerPerceptronClassifier):
    """The same estimator; its rows are read as packed matrices."""

    def _fit(self, dataset: DataFrame):
        if self.getSolver() != "l-bfgs":
            return super()._fit(dataset)
        layers, block = self.getLayers(), self.getBlockSize()
        rows = even_parts(dataset.select(vector_to_array(F.col(f"`{self.getFeaturesCol()}`")).alias("x"), F.col(f"`{self.getLabelCol()}`").cast("double").alias("y")))
        packed, one = rows.mapInArrow(lambda batches: pack(batches, block, layers), "x binary, y binary").persist(), dataset.limit(1).persist()
        try:
            weights = lbfgs(lambda w: loss_and_gradient(packed, w, layers, block), self._known(one, None).weights.toArray(), self.getMaxIter(), self.getTol())
            return self._known(one, weights)
        finally:
            packed.unpersist()
            one.unpersist()

    def _known(self, one: DataFrame, weights: np.ndarray | None):
        """The model of these weights, or of those that a fit begins with."""
        still = self.copy({self.maxIter: 0, **({} if weights is None else {self.initialWeights: Vectors.dense(weights)})})
        return MultilayerPerceptronClassifier._fit(still, one)


# ---- passes ---------------------------------------------------------------------------------------

def pack(batches: Iterator[pa.RecordBatch], block: int, layers: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows as matrices of whole blocks; only the last one of a task may end in a shorter block."""
    size, width = BLOCKS * block, layers[0]
    left_x, left_y = np.empty((0, width)), np.empty(0)

    def packed(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.astype(np.int32).tobytes()], pa.binary())], ["x", "y"])

    for batch in batches:
        if not batch.num_rows:
            continue
        y = batch.column("y").to_numpy(zero_copy_only=False)
        if batch.column("x").null_count or not np.isin(y, np.arange(layers[-1])).all():
            raise ValueError(f"A perceptron needs features and labels from 0 to {layers[-1] - 1} in every row.")
        x = np.concatenate((left_x, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)))
        y = np.concatenate((left_y, y))
        whole = len(x) - len(x) % size
        for k in range(0, whole, size):
            yield packed(x[k:k + size], y[k:k + size])
        left_x, left_y = x[whole:], y[whole:]
    if len(left_x):
        yield packed(left_x, left_y)


class Sums:
    """Sums of loss and gradient for one set of weights, in buffers that are used again: rows are columns here.

    A last row of ones stands for the offsets, so that a layer is one product.
    """

    def __init__(self, weights: np.ndarray, layers: list[int], most: int):
        self.layers, self.matrices, at = layers, [], 0
        for inputs, outputs in zip(layers, layers[1:]):
            self.matrices.append(weights[at:at + (inputs + 1) * outputs].reshape(inputs + 1, outputs))
            at += (inputs + 1) * outputs
        # Hidden layers need the exponential of the negative.
        self.forward = [np.ascontiguousarray(m.T if k == len(layers) - 2 else -m.T) for k, m in enumerate(self.matrices)]
        self.back = [np.ascontiguousarray(m[:-1]) for m in self.matrices]
        self.given = [np.ones((n + 1, most)) for n in layers]
        self.errors = [np.empty((n, most)) for n in layers]
        self.loss, self.gradients = 0.0, [np.zeros_like(m) for m in self.matrices]

    def add(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        """Cross entropy of the rows and its gradient by the weights, times ``share``."""
        n, last = len(y), len(self.matrices)
        given, errors = [g[:, :n] for g in self.given], [e[:, :n] for e in self.errors]
        given[0][:-1] = x.T
        for k in range(1, last):
            h = given[k][:-1]
            np.matmul(self.forward[k - 1], given[k - 1], out=h)
            np.exp(h, out=h)
            h += 1.0
            np.reciprocal(h, out=h)
        z, own = np.matmul(self.forward[-1], given[last - 1], out=errors[last]), (y, np.arange(n))
        z -= z.max(axis=0)
        np.exp(z, out=z)
        z /= z.sum(axis=0)
        # An impossible class leaves the loss undefined, as where zeros are multiplied by their logarithms.
        self.loss += -np.log(z[own]).sum() * share if (z > 0).all() else np.nan
        z[own] -= 1.0
        z *= share
        for k in range(last - 1, -1, -1):
            self.gradients[k] += given[k] @ errors[k + 1].T
            if k:
                h, e = given[k][:-1], np.matmul(self.back[k], errors[k + 1], out=errors[k])
                e *= h
                np.subtract(1.0, h, out=h)
                e *= h


def loss_and_gradient(packed: DataFrame, weights: np.ndarray, layers: list[int], block: int) -> tuple[float, np.ndarray]:
    """Mean over the blocks of the mean loss of their rows, and its gradient, from one pass."""
    size = 2 + len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, blocks = Sums(weights, layers, AT_ONCE), 0
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            for batch in batches:
                for a, b in zip(batch.column("x"), batch.column("y")):
                    x, y = np.frombuffer(a.as_buffer()).reshape(-1, layers[0]), np.frombuffer(b.as_buffer(), np.int32)
                    whole = len(y) - len(y) % block
                    cuts = [*range(0, whole, AT_ONCE), *range(whole, len(y), AT_ONCE), len(y)]
                    for start, end in zip(cuts, cuts[1:]):
                        if start < end:
                            sums.add(x[start:end], y[start:end], 1.0 / (block if end <= whole else len(y) - whole))
                    blocks += -(-len(y) // block)
        total = np.concatenate(([blocks, sums.loss], *[g.ravel() for g in sums.gradients]))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for one in batch.column("s"):
                total += np.frombuffer(one.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    tasks = packed.mapInArrow(run, "s binary").repartition(1).mapInArrow(add, "s binary")  # a row a task
    total = sum((np.frombuffer(r["s"]) for r in tasks.collect()), np.zeros(size))
    return total[1] / total[0], total[2:] / total[0]


# ---- steps ----------------------------------------------------------------------------------------

def lbfgs(f: Callable, x: np.ndarray, rounds: int, tolerance: float, memory: int = 10, remembered: int = 20) -> np.ndarray:
    """Weights after ``rounds`` rounds at most: fewer where values or gradients no longer change, or no step is found."""
    last: list = [None, None]

    def value(at: np.ndarray) -> tuple[float, np.ndarray]:
        if last[0] is None or not np.array_equal(last[0], at):
            last[:] = [at, f(at)]
        return last[1]

    loss, gradient = value(x)
    first, history, seen, failed, done = loss, [], [np.inf], False, 0
    while done < rounds and not np.linalg.norm(gradient) < max(tolerance * loss, 1e-8):
        if len(seen) >= 2 and abs(loss - max(seen)) <= tolerance * first:
            break
        try:
            direction = descent(history, gradient)

            def along(t: float) -> tuple[float, float]:
                v, g = value(x + direction * t)
                return v, float(g @ direction)

            step = strong_wolfe(along, 1.0 / np.linalg.norm(direction) if done == 0 else 1.0)
            if step * np.linalg.norm(gradient) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                break
            failed, history = True, []
            continue
        new = x + direction * step
        loss, after = value(new)
        history = [(new - x, after - gradient), *history][:memory]
        x, gradient, seen, failed, done = new, after, [*seen, loss][-remembered:], False, done + 1
    return x


def descent(history: list, gradient: np.ndarray) -> np.ndarray:
    """Minus the gradient times the inverse Hessian that the last (step, change of gradient) suggest."""
    out, scales = gradient.copy(), []
    if history and not history[0][0] @ history[0][1] >= 0:
        raise SearchFailed
    for step, change in history:
        scales.append(step @ out / (step @ change))
        if np.isnan(scales[-1]):
            raise SearchFailed
        out -= scales[-1] * change
    if history:
        step, change = history[0]
        out *= step @ change / (change @ change)
    for (step, change), scale in zip(history[::-1], scales[::-1]):
        out += (scale - change @ out / (step @ change)) * step
    return -out


def between(left: tuple, right: tuple) -> float:
    """Where the cubic through two (t, value, slope) is least, away from the ends."""
    (a, fa, da), (b, fb, db) = left, right
    d1 = da + db - 3 * (fa - fb) / (a - b)
    with np.errstate(invalid="ignore", divide="ignore"):
        d2 = np.sqrt(d1 * d1 - da * db)
        t = float(b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2))
    low, high = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return low if t < low else high if t > high else t


def strong_wolfe(f: Callable, t: float, tries: int = 10, least: float = 1e-4, slope_share: float = 0.9) -> float:
    """A step with enough descent and a flat enough end; ``f`` gives value and slope."""
    low = start = (0.0, *f(0.0))
    _, begun, slope = start
    if slope > 0:
        raise SearchFailed

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(tries):
            at = between(high, low) if low[0] > high[0] else between(low, high)
            c = (at, *f(at))
            if c[1] > begun + least * at * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= slope_share * abs(slope):
                return at
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed

    for k in range(tries):
        c = (t, *f(t))
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > begun + least * t * slope or (c[1] >= low[1] and k > 0):
            return zoom(low, c)
        if abs(c[2]) <= slope_share * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed
