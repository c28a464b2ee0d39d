"""Exact Shapley values of tree models, from the paths of their leaves.

A path is a leaf with the conditions on the way to it, one per feature. Between a row and a background
row a path is worth something only where each of its conditions holds for one of the two: with a
features that need the row and b that need the background row, a feature of the first kind gains
(a - 1)! b! / (a + b)! of the leaf's value and one of the second kind loses a! (b - 1)! / (a + b)!.
Summed over paths and averaged over the background this is the interventional Shapley value, without
walking through orders or scoring any mixed row, for every output of the model at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.sampling import stable_sample

#: Paths compared at once with all background rows.
PATHS_AT_ONCE = 2_000


class Paths(NamedTuple):
    """Leaves by number: their values per output, and their conditions in a row."""

    values: np.ndarray  # leaf x output
    begin: np.ndarray  # of the leaf's conditions
    feature: np.ndarray
    low: np.ndarray  # the condition is low < x <= high
    high: np.ndarray
    allowed: dict[int, list[float]]  # conditions on categories: number of the condition -> categories


def _leaf_value(node, kind: str, weight: float) -> list[float]:
    if kind == "probability":
        stats = np.array(node["impurityStats"])
        return (weight * stats / stats.sum()).tolist()
    return [weight * node["prediction"]]


def _leaves(nodes: dict, at: int, ways: dict, out: list, kind: str, weight: float) -> None:
    """Adds (value, conditions) of all leaves below a node; ``ways`` has what holds so far per feature."""
    node = nodes[at]
    if node["leftChild"] < 0:
        out.append((_leaf_value(node, kind, weight), dict(ways)))
        return
    f, split = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"]
    low, high, allowed = ways.get(f, (-np.inf, np.inf, None))
    if node["split"]["numCategories"] < 0:
        left, right = (low, min(high, split[0]), None), (max(low, split[0]), high, None)
    else:
        every = allowed if allowed is not None else set(map(float, range(node["split"]["numCategories"])))
        left, right = (low, high, every & set(split)), (low, high, every - set(split))
    for child, way in ((node["leftChild"], left), (node["rightChild"], right)):
        _leaves(nodes, child, {**ways, f: way}, out, kind, weight)


def paths_of(model, folder: str) -> Paths:
    """The paths of a fitted tree, forest or boosted trees, read from the model's own saved form in ``folder``.

    Outputs are class probabilities for trees and forests of classes, the value for numbers, and the
    raw margin for boosted classes. A path has as many numbers as its tree is deep; all fit where the
    model does.
    """
    model.write().overwrite().save(folder)
    table = SparkSession.active().read.parquet(f"{folder}/data")
    forest = "treeID" in table.columns
    rows = table.select("treeID", "nodeData.*").collect() if forest else table.collect()
    weights = list(getattr(model, "treeWeights", [1.0]))
    boosted = type(model).__name__.startswith("GBT")
    kind = "probability" if "Classification" in type(model).__name__ and not boosted else "value"
    trees: dict[int, dict] = {}
    for r in rows:
        trees.setdefault(r["treeID"] if forest else 0, {})[r["id"]] = r
    leaves: list = []
    for t, nodes in sorted(trees.items()):
        _leaves(nodes, 0, {}, leaves, kind, weights[t] if boosted else 1 / len(trees))
    feature, low, high, allowed, begin = [], [], [], {}, []
    for _, ways in leaves:
        begin.append(len(feature))
        for f, (a, b, categories) in ways.items():
            if categories is not None:
                allowed[len(feature)] = sorted(categories)
            feature.append(f)
            low.append(a)
            high.append(b)
    return Paths(np.array([v for v, _ in leaves]), np.array([*begin, len(feature)]), np.array(feature, np.int64), np.array(low), np.array(high), allowed)


def holds(paths: Paths, x: np.ndarray) -> np.ndarray:
    """Which conditions hold for which rows: condition x row."""
    v = x.T[paths.feature]
    out = (v > paths.low[:, None]) & (v <= paths.high[:, None])
    for k, categories in paths.allowed.items():
        out[k] = np.isin(v[k], categories)
    return out


def part_of(paths: Paths, begin: int, end: int) -> Paths:
    a, b = paths.begin[begin], paths.begin[end]
    return Paths(paths.values[begin:end], paths.begin[begin:end + 1] - a, paths.feature[a:b], paths.low[a:b], paths.high[a:b], {k - a: v for k, v in paths.allowed.items() if a <= k < b})


def gains(paths: Paths, x: np.ndarray, ground: np.ndarray) -> np.ndarray:
    """Contribution of every feature to every output of every row: row x feature x output, averaged over ``ground``."""
    out = np.zeros((len(x), x.shape[1], paths.values.shape[1]))
    depth = int(np.diff(paths.begin).max(initial=0))
    factorial = np.cumprod(np.append(1.0, np.arange(1, depth + 1)))
    at = np.arange(depth + 1)
    # Share of a condition that needs the row, by the numbers a and b of both kinds; 0 where there is none.
    share = np.where((at[:, None] > 0) & (at[:, None] + at <= depth), factorial[np.maximum(at[:, None] - 1, 0)] * factorial[at] / factorial[np.minimum(at[:, None] + at, depth)], 0.0)
    for begin in range(0, len(paths.values), PATHS_AT_ONCE):
        part = part_of(paths, begin, min(begin + PATHS_AT_ONCE, len(paths.values)))
        size = np.diff(part.begin)
        if not size.any():  # a tree of one leaf
            continue
        used = np.flatnonzero(size)  # leaves with conditions, whose sums start at these places
        starts, leaf = part.begin[used], np.repeat(np.arange(len(used)), size[used])
        mine, theirs = holds(part, x), holds(part, ground)
        for i in range(len(x)):
            own = mine[:, i][:, None]
            need, lack = own & ~theirs, ~own & theirs
            a, b = (np.add.reduceat(s, starts, axis=0, dtype=np.int64) for s in (need, lack))
            open_ = ~np.logical_or.reduceat(~own & ~theirs, starts, axis=0)
            up, down = np.where(open_, share[a, b], 0), np.where(open_, share[b, a], 0)
            weight = (need * up[leaf] - lack * down[leaf]).mean(axis=1)
            np.add.at(out[i], part.feature, weight[:, None] * part.values[used][leaf])
    return out


def tree_contributions(df: DataFrame, background: DataFrame, model, features: list[str], key, folder: str, background_rows: int = 100) -> DataFrame:
    """(key, output, feature, value, contribution) of every row, by the first ``background_rows`` of the background in md5 order of the key.

    ``df`` and ``background`` have the model's feature vector; ``features`` names its places. Per row and
    output the contributions add up to the score minus the mean score of the background. The model and
    the background rows travel to the tasks, the rows stay where they are. Rows without features have none.
    """
    column = model.getFeaturesCol()
    paths = paths_of(model, folder)
    few = stable_sample(background, key, background_rows).select(vector_to_array(column).alias("x"))
    ground = np.array([r["x"] for r in few.collect()]).reshape(-1, len(features))  # ``background_rows`` at most
    shared = df.sparkSession.sparkContext.broadcast((paths, ground))
    rows = df.filter(F.col(column).isNotNull()).select(*key, vector_to_array(column).alias("__x"))
    names = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, ground = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found = gains(paths, x, ground)
            many, outputs = len(features), found.shape[2]
            take = pa.array(np.repeat(np.arange(batch.num_rows), many * outputs))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(take) for k in key], pa.array(np.tile(np.repeat(np.arange(outputs), many), batch.num_rows), pa.int32()), pa.array(features * (batch.num_rows * outputs)),
                 pa.array(np.repeat(x, outputs, axis=0).ravel()), pa.array(found.transpose(0, 2, 1).ravel())], [*key, "output", "feature", "value", "contribution"])

    return rows.mapInArrow(run, f"{names}, output int, feature string, value double, contribution double")
