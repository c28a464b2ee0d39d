"""What drives a score: permutation importance, linear and permutation Shapley values.

A model is given as a function from a DataFrame to the same rows with a ``score`` column, so a
formula, an ML model or a rule can be explained alike.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import numbers
from assayer.operators import ranking
from assayer.operators.normalize import quoted
from assayer.operators.sampling import stable_sample


def _q(name: str):
    return F.col(f"`{name}`")


#: Round functions of a permutation are cubes modulo this prime: all products stay below 2**62.
PRIME = 2_147_483_647
ROUNDS = 4


class Permutation:
    """A keyed one-to-one map of the places 0 to n - 1, as an expression: nothing is sorted.

    A place is a cell of a grid of rows x columns with at least n cells. Each round moves all places of a
    column within it, or of a row, by a keyed function of the other coordinate. Places that land beyond
    n - 1, fewer than the rows of the grid, move on until they are inside; how often that takes is
    worked out beforehand for these few.
    """

    def __init__(self, n: int, salt: str):
        self.n, self.rows = max(1, n), math.isqrt(max(0, n - 1)) + 1
        self.columns = -(-self.n // self.rows)
        self.keys = [int(hashlib.md5(f"{salt}|{k}".encode()).hexdigest()[:7], 16) for k in range(ROUNDS)]
        beyond = np.arange(self.n, self.rows * self.columns)
        self.walks, at = 0, np.setdiff1d(beyond, self._numbers(beyond))  # reached from inside, so the way leads back
        while len(at):
            at = self._numbers(at)
            at = at[at >= self.n]
            self.walks += 1

    def _numbers(self, at: np.ndarray) -> np.ndarray:
        row, column = at // self.columns, at % self.columns
        for k, key in enumerate(self.keys):
            t = ((row if k % 2 else column) + key) % PRIME
            moved = t * t % PRIME * t % PRIME
            row, column = (row, (column + moved) % self.columns) if k % 2 else ((row + moved) % self.rows, column)
        return row * self.columns + column

    def sql(self, place: str) -> str:
        """The place that the row at ``place`` goes to, as SQL text."""
        cube = lambda v: f"(({v} + k.key) % {PRIME}) * (({v} + k.key) % {PRIME}) % {PRIME} * (({v} + k.key) % {PRIME}) % {PRIME}"
        keys = ", ".join(f"named_struct('side', {k % 2}, 'key', bigint({key}))" for k, key in enumerate(self.keys))

        def moved(x: str) -> str:
            return f"""aggregate(array({keys}), named_struct('row', bigint({x} div {self.columns}), 'column', bigint({x} % {self.columns})), (s, k) -> if(k.side = 0,
                named_struct('row', (s.row + {cube('s.column')}) % {self.rows}, 'column', s.column), named_struct('row', s.row, 'column', (s.column + {cube('s.row')}) % {self.columns})),
                s -> s.row * {self.columns} + s.column)"""

        once = moved(place)
        return once if not self.walks else f"aggregate(sequence(1, {self.walks}), {once}, (x, i) -> if(x < {self.n}, x, {moved('x')}))"


def numbered(df: DataFrame, key, rows: int | None = None) -> DataFrame:
    """df with ``__place`` from 0, in md5 order of the key."""
    return ranking.hash_positions(df, key, salt="rows", name="__place", rows=rows).withColumn("__place", F.col("__place") - 1)


def permuted(df: DataFrame, features, key, salts, rows: int | None = None) -> DataFrame:
    """Every row once per salt, with ``__salt`` and the features of the row whose place is moved there as ``__moved``.

    Rows are numbered once and joined once, however many salts there are: a row hands its features to
    one place per salt.
    """
    rows = df.count() if rows is None else rows
    placed = numbered(df, key, rows)
    targets = ", ".join(f"named_struct('salt', {quoted(s)}, 'to', {Permutation(rows, s).sql('__place')})" for s in salts)
    given = placed.select(F.struct(*[_q(f) for f in features]).alias("__moved"), F.expr(f"inline(array({targets}))"))
    given = given.select(F.col("salt").alias("__salt"), F.col("to").alias("__place"), "__moved")
    return placed.join(given, "__place").drop("__place")


def permutation_importance(df: DataFrame, features, model, loss, key, repeats: int = 3) -> DataFrame:
    """Mean and population deviation of the score lost when a feature is shuffled, most important first.

    ``loss`` is an aggregate over ``score`` and the label in which higher is better. A repeat is one
    permutation of the rows, from which one feature after another is taken. All (feature, repeat) pairs
    are rows of one DataFrame and go through the model in one pass; ``model`` keeps extra columns.
    """
    features = list(features)
    moved = permuted(df, features, key, [str(k) for k in range(repeats)])
    plain = [c for c in df.columns if c not in features]
    cells = [F.struct(F.lit(f).alias("__feature"), *[(F.col("__moved")[g] if g == f else _q(g)).alias(g) for g in features]) for f in features]
    lost = model(moved.select(*[_q(c) for c in plain], "__salt", F.inline(F.array(*cells)))).groupBy("__feature", "__salt").agg(loss.alias("shuffled"))
    base = model(df).agg(loss.alias("base")).withColumn("__all", F.lit(0))
    drop = F.col("base") - F.col("shuffled")
    return (lost.withColumn("__all", F.lit(0)).join(F.broadcast(base), "__all").groupBy(F.col("__feature").alias("feature"))  # a single row
            .agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("std")).orderBy(F.desc("importance"), "feature"))


def linear_contributions(df: DataFrame, coefficients: dict[str, float], means: dict[str, float], key) -> DataFrame:
    """(key, feature, value, contribution): weight times the distance to the background mean."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), _q(f).cast("double").alias("value"),
                               (F.lit(w) * (_q(f) - F.lit(means[f]))).alias("contribution")) for f, w in coefficients.items()])
    return df.select(*key, F.inline(cells))


def shapley(df: DataFrame, background: DataFrame, features, model, key, background_rows: int, orders: int = 1) -> DataFrame:
    """(key, feature, value, contribution) by walking each row from a background row to itself.

    Every row is paired with the first ``background_rows`` of the background in md5 order of the key and walked forward and
    backward through ``orders`` feature orders; the steps of a walk add up to the difference
    of the scores, so the contributions add up to the score minus the mean background score.
    A step that several walks share is a single row with their number; all steps go through the model twice, for
    the score before and after, and only the sums per row and feature are shuffled.
    """
    few = stable_sample(background, key, background_rows).select(*features)
    names = list(features)
    plain = df.select(*key, *[_q(f).alias(f"x_{f}") for f in names])
    ground = few.agg(F.collect_list(F.struct(*names)).alias("__ground")).withColumn("__one", F.lit(0))  # background_rows entries
    paired = (plain.withColumn("__one", F.lit(0)).join(F.broadcast(ground), "__one").drop("__one")
              .select("*", F.explode("__ground").alias("__g")).drop("__ground"))
    taken = Counter()  # how many walks take a step: a feature after the set of those before it
    for o in range(orders):
        turned = names[o % len(names):] + names[:o % len(names)]
        for order in (turned, turned[::-1]):
            taken.update((f, frozenset(order[:s])) for s, f in enumerate(order))
    steps = []
    for (feature, seen), walks in taken.items():
        given = lambda f, seen: (_q(f"x_{f}") if f in seen else F.col("__g")[f]).alias(f)
        steps.append(F.struct(F.lit(feature).alias("__f"), F.lit(walks).alias("__walks"), _q(f"x_{feature}").cast("double").alias("__value"),
                              *[given(f, seen) for f in names], F.struct(*[given(f, seen | {feature}) for f in names]).alias("__then")))
    walked = paired.select(*key, F.inline(F.array(*steps)))
    kept = [*[_q(k) for k in key], "__f", "__walks", "__value"]
    before = model(walked).select(*kept, F.col("score").alias("__before"), "__then.*")
    moved = model(before).select(*kept, (F.col("score") - F.col("__before")).alias("__d"))
    # Both ends of a step are in one row, so the steps of a row are added up where they are made.
    sums = moved.groupBy(*key, F.col("__f").alias("feature")).agg(F.first("__value").alias("value"), F.sum(F.col("__d") * F.col("__walks")).alias("__sum"),
                                                                  F.sum(F.when(F.col("__d").isNotNull(), F.col("__walks"))).alias("__of"))
    return sums.select(*key, "feature", "value", F.try_divide("__sum", "__of").alias("contribution"))


def contribution_summary(contributions: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Mean absolute contribution per source feature, encoded columns added up by ``mapping`` (feature, source)."""
    per = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("m"))
    if mapping is not None:
        per = per.join(mapping, "feature", "left").withColumn("feature", F.coalesce("source", "feature"))
    return per.groupBy("feature").agg(F.sum("m").alias("importance")).orderBy(F.desc("importance"), "feature")


def directions(contributions: DataFrame, features, key, least: int = 8, cut: float = 0.5, rows: int | None = None) -> DataFrame:
    """Spearman correlation of value and contribution per feature where it is strong.

    All features are ranked together, each among its own rows, whatever their number.
    """
    both = contributions.filter(F.col("feature").isin(list(features)) & F.col("value").isNotNull() & F.col("contribution").isNotNull()).select("feature", "value", "contribution")
    rows = both.count() if rows is None else rows
    ranked = both
    for c in ("value", "contribution"):
        table = ranking.average_ranks(both.select("feature", c), c, ["feature"], rows=rows).select("feature", c, F.col("avg_rank").alias(f"__rank_{c}"))
        ranked = ranked.join(table, ["feature", c])  # distinct values of a feature: Spark broadcasts the table only if it measures small
    out = ranked.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.expr(numbers.corr_sql("__rank_value", "__rank_contribution")).alias("coefficient"))
    return (out.filter((F.col("n") >= least) & (F.abs("coefficient") >= cut))
            .withColumn("direction", F.when(F.col("coefficient") > 0, "higher with higher values").otherwise("lower with higher values")))


def row_contributions(contributions: DataFrame, key) -> DataFrame:
    """Contributions of each row, largest magnitude first (one entry per feature)."""
    listed = F.array_sort(F.collect_list(F.struct((-F.abs("contribution")).alias("m"), "feature", "contribution")))
    return contributions.groupBy(*key).agg(F.transform(listed, lambda s: F.struct(s["feature"], s["contribution"])).alias("contributions"))


def explained_sample(df: DataFrame, key, n: int | None) -> DataFrame:
    return df if n is None else stable_sample(df, key, n)
