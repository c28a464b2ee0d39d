"""Centroids and diagonal mixtures on planted groups."""

import numpy as np
import pytest

from assayer.operators import clusters as C
from assayer.operators import metrics


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0.0, 0.0, 0.0], [6.0, 0.0, 3.0], [0.0, 7.0, -3.0]])
    of = rng.integers(0, 3, 1500)
    points = centres[of] + rng.normal(size=(1500, 3)) * np.array([0.5, 1.0, 0.8])
    rows = [(int(k), int(g), p.tolist()) for k, (g, p) in enumerate(zip(of, points))]
    return spark.createDataFrame(rows + [(9000, None, None)], "id int, g int, features array<double>").repartition(5).persist(), points, of


def agreement(rows):
    """Share of rows whose group is the most frequent one of their cluster."""
    seen = {}
    for r in rows:
        seen.setdefault(r.prediction, []).append(r.g)
    return sum(max(map(v.count, set(v))) for v in seen.values()) / len(rows)


def test_starts_move_together_and_the_best_is_kept(spark, blobs):
    df, points, _ = blobs
    model = C.Centroids(3, starts=4).fit(df)
    far = ((points[:, None] - model.centres) ** 2).sum(axis=2).min(axis=1).sum()
    assert np.isclose(far, model.inertia.min()) and len(model.inertia) == 4
    rows = model.transform(df).collect()
    assert agreement([r for r in rows if r.g is not None]) > 0.99
    assert [r.prediction for r in rows if r.g is None] == [None]
    centres = np.stack([points[:3], points[3:6]])
    n, means, inertia = C.lloyd_round(df, "features", centres)
    for s in range(2):
        near = ((points[:, None] - centres[s]) ** 2).sum(axis=2)
        assert np.isclose(inertia[s], near.min(axis=1).sum())
        for g in range(3):
            assert n[s, g] == (near.argmin(axis=1) == g).sum() and np.allclose(means[s, g], points[near.argmin(axis=1) == g].mean(axis=0))


def test_mixture_never_gets_less_likely(spark, blobs):
    df, points, of = blobs
    model = C.DiagonalMixture(3, tolerance=1e-9, rounds=15).fit(df)
    assert all(b >= a - 1e-9 for a, b in zip(model.likelihood, model.likelihood[1:]))
    rows = [r for r in model.transform(df).collect() if r.g is not None]
    assert agreement(rows) > 0.99 and all(abs(sum(r.membership) - 1) < 1e-9 for r in rows)
    assert np.allclose(np.sort(np.sqrt(model.mixture.variances), axis=1).mean(axis=0), [0.5, 0.8, 1.0], atol=0.1)


def test_many_columns_and_few_rows(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(0, 0.2, (30, 64)), rng.normal(1, 0.2, (30, 64))])
    df = spark.createDataFrame([(k, int(k >= 30), p.tolist()) for k, p in enumerate(points)], "id int, g int, features array<double>")
    assert agreement(C.DiagonalMixture(2).fit(df).transform(df).collect()) == 1.0
    same = spark.createDataFrame([(k, 0, [1.0, 2.0]) for k in range(5)], "id int, g int, features array<double>")
    assert {r.prediction for r in C.Centroids(2, starts=2).fit(same).transform(same).collect()} == {0}


def test_fits_share_their_passes(spark, blobs, monkeypatch):
    """Fits together are the fits alone, in as many passes as the longest of them."""
    df, _, _ = blobs
    passes, added_up = [], C.added_up
    monkeypatch.setattr(C, "added_up", lambda df, features, wanted: passes.append(len(wanted)) or added_up(df, features, wanted))
    make = [lambda: C.Centroids(2, starts=3), lambda: C.Centroids(4, starts=3), lambda: C.DiagonalMixture(3)]
    alone, counts = [], []
    for one in make:
        alone.append(one().fit(df))
        counts.append(len(passes) - sum(counts))
    passes.clear()
    together = C.fit_together([one() for one in make], df)
    assert len(passes) == max(counts) < sum(counts) and passes[0] == 3 and sum(passes) == sum(counts)
    for a, b in zip(alone, together, strict=True):
        if isinstance(a, C.CentroidModel):
            assert np.allclose(a.centres, b.centres) and np.allclose(a.inertia, b.inertia)
        else:
            assert np.allclose(a.likelihood, b.likelihood) and np.allclose(a.mixture.means, b.mixture.means) and np.allclose(a.mixture.variances, b.mixture.variances)
    nothing = df.filter("id < 0")
    assert [len(x) for x in C.added_up(nothing, "features", [(lambda x: x.sum(axis=0), 3), (len, 1)])] == [3, 1]


def test_cluster_metrics_leave_the_rows_where_they_are(spark, blobs):
    df, points, of = blobs
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = metrics.cluster_metrics(df.filter("g IS NOT NULL"), "features", "g")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1, plan  # the other one joins facts of clusters
        got = found.first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    centres = np.stack([points[of == g].mean(axis=0) for g in range(3)])
    scatter = np.array([np.sqrt(((points[of == g] - centres[g]) ** 2).sum(axis=1)).mean() for g in range(3)])
    away = np.sqrt(((centres[:, None] - centres) ** 2).sum(axis=2))
    worst = [max((scatter[a] + scatter[b]) / away[a, b] for b in range(3) if b != a) for a in range(3)]
    assert np.isclose(got.davies_bouldin, np.mean(worst)) and got.clusters == 3
