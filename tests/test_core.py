"""Ranks, quantiles, positions and tails against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.functions import tails
from assayer.operators import quantiles as q
from assayer.operators import ranking, splits
from assayer.operators.inference import exact_rank_tail, shapiro_wilk


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    v = np.where(rng.random(4000) < 0.4, 7.0, np.round(rng.normal(5, 3, 4000), 2))  # one value holds over a third
    return pd.DataFrame({"id": np.arange(4000), "g": np.where(np.arange(4000) % 3 == 0, "a", "b"), "v": v})


@pytest.mark.parametrize("rows", [100, ranking.SMALL_ROWS + 1])
def test_average_ranks_match_pandas(spark, skewed, rows):
    got = ranking.average_ranks(spark.createDataFrame(skewed), "v", ["g"], rows=rows, buckets=16).toPandas()
    expected = skewed.assign(k=skewed.groupby("g")["v"].rank()).groupby(["g", "v"])["k"].first()
    assert len(got) == len(expected)
    assert all(math.isclose(r.avg_rank, expected[r.g, r.v]) for r in got.itertuples())


@pytest.mark.parametrize("rows", [100, ranking.SMALL_ROWS + 1])
def test_gaps_match_pandas(spark, rows):
    at = pd.to_datetime(np.random.default_rng(2).integers(0, 10**6, 500), unit="s")
    got = ranking.gaps(spark.createDataFrame(pd.DataFrame({"t": at})), "t", rows=rows, buckets=16).orderBy("t").toPandas()
    expected = pd.Series(at).drop_duplicates().sort_values().diff().dt.total_seconds()
    assert np.allclose(got.gap_seconds.to_numpy()[1:], expected.to_numpy()[1:])
    assert np.isnan(got.gap_seconds.to_numpy(dtype=float)[0])


def test_positions_are_a_permutation_per_group(spark, skewed):
    got = ranking.hash_positions(spark.createDataFrame(skewed), ["id"], ["g"]).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part.position) == list(range(1, len(part) + 1))


@pytest.mark.parametrize("by", [(), ("g",)])
def test_narrowed_quantiles_are_exact(spark, skewed, by):
    df = spark.createDataFrame(skewed)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    for held in (3, 200, 10**6):
        for row in q.quantiles(df, ["v", "id"], shares, by, held=held).toPandas().itertuples():
            part = skewed if not by else skewed[skewed.g == row.g]
            assert np.allclose(row.v, part.v.quantile(shares).to_numpy()) and np.allclose(row.id, part.id.quantile(shares).to_numpy())


def test_quantiles_of_hard_columns(spark):
    rng = np.random.default_rng(9)
    n = 3000
    wide = pd.DataFrame({"g": np.where(np.arange(n) % 5 == 0, None, "x"), "huge": np.exp(rng.normal(0, 150, n)) * rng.choice([-1, 1], n), "far": np.where(np.arange(n) % 2, 1e300, rng.random(n) * 1e-300),
                         "edge": rng.choice([-1.7e308, 1.7e308, 5e-324, -5e-324, 0.0], n), "close": 1 + rng.integers(0, 2000, n) * 2.0**-50, "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)),
                         "one": np.where(np.arange(n) == 17, 4.0, np.nan), "none": np.full(n, np.nan)})
    columns, shares = [c for c in wide.columns if c != "g"], [0.0, 0.1, 0.5, 0.87, 1.0]
    df = spark.createDataFrame(wide)
    for by in ((), ("g",)):
        for row in q.quantiles(df, columns, shares, by, held=20).collect():
            part = wide if not by else wide[wide.g.isna() if row.g is None else wide.g == row.g]
            for c in columns:
                values = np.sort(part[c].dropna().to_numpy())
                at = [s * (len(values) - 1) for s in shares]
                expected = [values[int(a)] if a == int(a) else (math.ceil(a) - a) * values[math.floor(a)] + (a - math.floor(a)) * values[math.ceil(a)] for a in at] if len(values) else None
                assert row[c] == expected, c
    assert q.quantiles(df.limit(0), ["far"], [0.5]).collect()[0].far is None
    infinite = spark.createDataFrame([(float(v),) for v in ["-inf", "inf", "inf", *range(40)]], "v double")
    assert q.quantiles(infinite, ["v"], [0.0, 0.5, 1.0], held=5).first().v == [float("-inf"), 20.0, float("inf")]


def test_few_large_groups_are_narrowed_without_a_join(spark, monkeypatch):
    """Large groups next to small ones, a null key, two keys; many large groups still meet their brackets in a table."""
    rows = [(k, m, float(i * 7919 % 997) if i % 9 else None) for k, n in (("a", 400), (None, 300), ("b", 4)) for i, m in enumerate([True, False] * (n // 2))]
    rows += [("empty", True, None)] * 40
    df, shares = spark.createDataFrame(rows, "k string, m boolean, v double"), [0.1, 0.5, 0.9]
    joined = []
    within = q._within
    monkeypatch.setattr(q, "_within", lambda *a: joined.append(1) or within(*a))
    few = {(r.k, r.m): r.v for r in q.quantiles(df, ["v"], shares, ["k", "m"], held=30).collect()}
    assert not joined
    monkeypatch.setattr(q, "FEW_GROUPS", 1)
    many = {(r.k, r.m): r.v for r in q.quantiles(df, ["v"], shares, ["k", "m"], held=30).collect()}
    assert joined and few == many and few["empty", True] is None and len(few) == 7
    for (k, m), got in few.items():
        values = [v for a, b, v in rows if (a, b) == (k, m) and v is not None]
        assert got is None if not values else np.allclose(got, np.quantile(values, shares))


def test_hash_cuts_give_exact_sizes(spark, skewed):
    parted = splits.random_split(spark.createDataFrame(skewed), ["id"], "g").groupBy("g", "part").count().toPandas()
    for g, n in skewed.g.value_counts().items():
        sizes = dict(zip(parted[parted.g == g].part, parted[parted.g == g]["count"]))
        test, validation = splits.part_sizes(n)
        assert sizes == {"test": test, "validation": validation, "train": n - test - validation}


def test_tails_match_tables():
    assert math.isclose(tails.t_two_sided([2.228139], [10])[0], 0.05, rel_tol=1e-5)
    assert math.isclose(tails.f_upper([4.102821], [2], [10])[0], 0.05, rel_tol=1e-5)
    assert math.isclose(tails.gamma_upper([1.5], [7.814728 / 2])[0], 0.05, rel_tol=1e-5)
    assert math.isclose(tails.normal_two_sided([1.959964])[0], 0.05, rel_tol=1e-5)
    assert math.isclose(tails.t_quantile([0.975], [10])[0], 2.228139, rel_tol=1e-5)
    assert math.isclose(tails.fisher_two_sided([8], [2], [1], [5])[0], 0.034965, rel_tol=1e-4)
    assert math.isclose(exact_rank_tail([9], [3], [3])[0], 1 / 20)
    assert math.isclose(shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]), 0.006704, rel_tol=1e-3)


def test_chi_square_agrees_with_spark_ml(spark, skewed):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    from assayer.operators import inference
    df = spark.createDataFrame(skewed).select(F.when(F.col("g") == "a", 0.0).otherwise(1.0).alias("y"), F.when(F.col("v") > 7, 2.0).when(F.col("v") == 7, 1.0).otherwise(0.0).alias("x"))
    own = inference.chi_square(inference.contingency(df, [("x", "y")])).withColumn("p", tails.chi_square_p("statistic", "df")).first()
    ml = ChiSquareTest.test(VectorAssembler(inputCols=["x"], outputCol="f").transform(df), "f", "y").first()
    assert math.isclose(own["statistic"], ml.statistics[0], rel_tol=1e-9)
    assert math.isclose(own["p"], ml.pValues[0], rel_tol=1e-9)


def test_keyed_permutations_are_one_to_one(spark):
    from assayer.operators.explain import Permutation
    for n in (1, 2, 3, 5, 7, 26, 101, 1000, 4097):
        for salt in ("a", "b"):
            p = Permutation(n, salt)
            got = [r[0] for r in spark.range(n).select(F.expr(p.sql("id"))).collect()]
            at = p._numbers(np.arange(n))
            while (at >= n).any():
                at = np.where(at < n, at, p._numbers(at))
            assert got == at.tolist() and sorted(got) == list(range(n))
    big = Permutation(10**12 + 39, "a")  # all intermediate products stay whole numbers
    assert 0 <= spark.range(1).select(F.expr(big.sql("bigint(999999999999)"))).first()[0] < 10**12 + 39
    moved = [r[0] for r in spark.range(4096).select(F.expr(Permutation(4096, "c").sql("id"))).collect()]
    assert abs(np.corrcoef(moved, np.arange(4096))[0, 1]) < 0.1 and np.mean(np.array(moved) == np.arange(4096)) < 0.01
