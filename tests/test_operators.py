"""Behaviour of the operators on small tables."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.operators import anomaly, explain, features, inference, leakage, metrics, models, normalize, registry, splits, temporal
from assayer.operators import profile as P
from assayer.plans.analysis import analyze
from assayer.sources import demo, tables


def facts(spark, data, schema=None, key=None):
    df = spark.createDataFrame(pd.DataFrame(data)) if schema is None else spark.createDataFrame(data, schema)
    return df, {r["column"]: r for r in P.profile(df, key).collect()}


def test_constant_and_empty_columns(spark):
    _, p = facts(spark, [(1, None)] * 12, "constant long, empty double")
    assert p["constant"]["constant"] and p["empty"]["constant"]
    assert p["empty"]["missing"] == 12 and p["constant"]["duplicates"] == 11


def test_infinities_are_counted_and_left_out(spark):
    _, p = facts(spark, {"value": [1.0, np.inf, -np.inf, 100000.0]})
    assert p["value"]["infinite_values"] == 2 and p["value"]["max"] == 100000.0 and p["value"]["missing"] == 2


def test_extreme_magnitudes_stay_finite(spark):
    df, p = facts(spark, {"extreme": [-1e308, 0.0, 1e308], "other": [1.0, 2.0, 3.0]})
    assert p["extreme"]["extreme_magnitude"] and p["extreme"]["mean"] == 0 and p["extreme"]["variance"] is None
    tests = inference.test_pairs(df, P.profile(df)).collect()
    assert [(r["left"], r["status"]) for r in tests] == [("extreme", "skipped")]


def test_mixed_text_and_free_text(spark):
    _, p = facts(spark, {"mixed": ["1", "2", "oops", "4"]})
    assert p["mixed"]["mixed_numeric_text"]
    _, p = facts(spark, {"description": [f"{'word ' * 20} {i}" for i in range(120)]})
    assert p["description"]["possible_free_text"] and p["description"]["high_cardinality"]


def test_one_iqr_outlier(spark):
    _, p = facts(spark, {"value": [*range(10), 1000]})
    assert p["value"]["outliers"] == 1 and p["value"]["outlier_rows"] == 1


def test_dates_in_text_are_found(spark):
    _, p = facts(spark, {"when": [f"2024-01-{d:02d}" for d in range(1, 29)], "id_code": [f"x{d}" for d in range(28)]})
    assert p["when"]["kind"] == "datetime" and p["when"]["frequency"] == "D" and p["id_code"]["kind"] == "categorical"


def test_gaps_and_future_dates(spark):
    days = pd.date_range("2090-01-01", periods=35, freq="D").delete([10, 20])
    df = spark.createDataFrame(pd.DataFrame({"event_date": [days[0], *days], "sales": range(34)}))
    t = P.temporal_profile(df, "event_date", "2026-01-01").first()
    assert (t["missing_periods_estimate"], t["duplicate_dates"], t["future_timestamps"]) == (2, 1, 34)
    series = temporal.calendar_series(df, "event_date", "sales")
    assert temporal.one_step_forecasts(series).count() == 0
    assert temporal.trend(series).first()["missing_periods"] == 2


def test_duplicates_do_not_make_a_class_eligible(spark):
    data = {"value": [*range(50), *[99] * 8], "churn": ["No"] * 50 + ["Yes"] * 8}
    df, p = facts(spark, data)
    assert p["churn"]["minimum_class_count"] == 8 and p["churn"]["usable_minimum_class_count"] == 1
    assert not features.readiness(P.profile(df), "churn", "classification").first()["ready"]


def test_empty_tables_are_refused(spark):
    with pytest.raises(ValueError):
        tables.check_shape(spark.createDataFrame([], "value long"))
    with pytest.raises(ValueError):
        normalize.trimmed_names([" a", "a "])


def test_weak_but_significant_correlation(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=5000)
    x = (x - x.mean()) / x.std()
    e = rng.normal(size=5000)
    e = e - e.mean() - x * (e @ x) / (x @ x)
    y = 0.05 * x + np.sqrt(1 - 0.05 ** 2) * e / e.std()
    df = spark.createDataFrame(pd.DataFrame({"measurement": x, "outcome": y}))
    r = inference.test_pairs(df, P.profile(df)).filter("method = 'Pearson correlation'").first()
    assert abs(r["effect"] - 0.05) < 1e-9 and r["significant"] and r["strength"] == "negligible" and r["lower"] < 0.05 < r["upper"]


def test_group_tests_choose_by_shape(spark):
    rng = np.random.default_rng(7)
    welch = pd.DataFrame({"region": ["a"] * 120 + ["b"] * 120, "sales": np.r_[rng.normal(0, 1, 120), rng.normal(2, 2, 120)]})
    ranks = pd.DataFrame({"region": ["a"] * 20 + ["b"] * 20, "sales": np.r_[rng.exponential(1, 20) ** 3, rng.exponential(9, 20) ** 3]})
    many = pd.DataFrame({"region": ["a"] * 50 + ["b"] * 50 + ["c"] * 50, "sales": np.r_[rng.normal(0, 1, 50), rng.normal(2, 1, 50), rng.normal(4, 1, 50)]})
    for data, methods in ((welch, {"Welch's t-test"}), (ranks, {"Mann-Whitney U"}), (many, {"One-way ANOVA", "Kruskal-Wallis"})):
        df = spark.createDataFrame(data)
        r = inference.test_pairs(df, P.profile(df)).first()
        assert r["method"] in methods and r["q_value"] < 0.01


@pytest.mark.parametrize(("n1", "n2"), [(1, 5), (3, 4), (5, 9), (8, 8), (8, 20)])
def test_exact_rank_counts(n1, n2):
    ways = np.zeros((n1 + 1, n1 * n2 + 1), dtype=object)
    ways[0, 0] = 1
    for value in range(n1 + n2):  # sets of n1 ranks by size and rank sum
        for size in range(min(value + 1, n1), 0, -1):
            step = value - size + 1
            if step <= n1 * n2:
                ways[size, step:] += ways[size - 1, :n1 * n2 + 1 - step]
    total = 0
    for u in range(n1 * n2 + 1):
        total += ways[n1, u]
        assert inference.arrangements_upto(u, n1, n2) == total
    assert 0 < inference.exact_rank_tail([7.5e8], [8], [10**8])[0] < 1e-5  # any size of the second group


def test_sparse_two_by_two_uses_fisher(spark):
    data = {"category": ["a"] * 50 + ["b"] * 50, "outcome": ["x"] * 48 + ["y"] * 2 + ["x"] * 46 + ["y"] * 4}
    df = spark.createDataFrame(pd.DataFrame(data))
    r = inference.test_pairs(df, P.profile(df)).first()
    assert r["method"] == "Fisher exact association" and 0 <= r["effect"] <= 1


def test_constant_pairs_do_not_fail(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0] * 20, "b": np.arange(20.0)}))
    assert inference.pearson(df, [("a", "b")]).first()["coefficient"] is None


def test_class_codes_are_nominal(spark):
    df = spark.createDataFrame(pd.DataFrame({"measurement": np.arange(216) * 1.5 % 37, "target": np.repeat(range(18), 12)}))
    methods = {r["method"] for r in inference.test_pairs(df, P.profile(df), nominal=["target"]).collect()}
    assert methods and not methods & {"Pearson correlation", "Spearman correlation"}


def test_leakage_flags(spark):
    n = 100
    v = np.arange(n, dtype=float)
    start = pd.Timestamp("2024-01-01")
    df = spark.createDataFrame(pd.DataFrame({"target": v, "target_copy": v, "prediction_time": [start] * n, "cancellation_date": [start + pd.Timedelta(days=31)] * n}))
    flags = {(r["feature"], r["reason"]) for r in leakage.leakage(df, "target", P.profile(df)).collect()}
    assert ("target_copy", "near-perfect correlation") in flags and ("cancellation_date", "after the prediction time") in flags
    df = spark.createDataFrame(pd.DataFrame({"outcome": ["a"] * 50 + ["b"] * 50, "suspicious_measurement": range(100)}))
    assert "separates the outcome alone" in {r["reason"] for r in leakage.leakage(df, "outcome", P.profile(df)).collect()}


def test_anomaly_is_flagged_with_drivers(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"id": range(100), "amount": np.r_[rng.normal(size=99), 100], "visits": np.r_[rng.normal(size=99), -100]})
    scored = anomaly.detect(spark.createDataFrame(data), ["amount", "visits"], ["id"]).collect()
    worst = min(scored, key=lambda r: r["score"])
    assert worst["id"] == 99 and worst["flagged"] and len(worst["drivers"]) == 2


def test_calibration_grades(spark):
    y = np.arange(100) % 2
    sure = spark.createDataFrame(pd.DataFrame({"label": y, "score": y.astype(float)}))
    vague = spark.createDataFrame(pd.DataFrame({"label": y, "score": np.where(y == 1, 0.1, 0.9)}))
    good, poor = metrics.calibration(sure).first(), metrics.calibration(vague).first()
    assert good["brier_score"] == 0 and good["status"] == "good" and poor["status"] == "poor" and poor["brier_score"] > 0.2
    assert sum(r["rows"] for r in metrics.calibration_bins(sure).collect()) == 100
    severe = spark.createDataFrame(pd.DataFrame({"churn": ["No"] * 980 + ["Yes"] * 20}))
    assert all(r["severe"] and r["minority_share"] == 0.02 for r in metrics.class_balance(severe, "churn").collect())


def test_split_invariants(spark):
    data = pd.DataFrame({"id": range(220), "group": np.arange(220) // 11, "date": pd.date_range("2024-01-01", periods=20).repeat(11), "target": np.arange(220.0)})
    df = spark.createDataFrame(data)
    for strategy, column in (("group", "group"), ("chronological", "date")):
        parted = splits.split(df, ["id"], strategy, column).toPandas()
        assert parted.groupby(column)["part"].nunique().max() == 1 and set(parted.part) == set(splits.PARTS)
    parted = splits.split(df, ["id"], "chronological", "date").toPandas()
    assert parted[parted.part == "train"].date.max() < parted[parted.part == "validation"].date.min() < parted[parted.part == "test"].date.min()
    folded = splits.group_folds(df, "group", 3).toPandas()
    assert folded.groupby("group")["fold"].nunique().max() == 1 and folded.fold.nunique() == 3
    timed = splits.time_folds(df, "date", 3).toPandas()
    for _, f in timed.groupby("fold"):
        assert f[f.role == "train"].date.max() < f[f.role == "validation"].date.min()
    with pytest.raises(splits.SplitError):
        splits.split(df.withColumn("one", F.lit(1)), ["id"], "group", "one")


def test_generated_names_must_not_collide(spark):
    df = spark.createDataFrame(pd.DataFrame({"date": [pd.Timestamp("2024-01-01")], "date__year": [1]}))
    with pytest.raises(ValueError):
        features.date_features(df, ["date"])


def test_forecast_parts_add_up(spark):
    panel = demo.generate(spark, "temporal")
    series = temporal.calendar_series(panel, "order_date", "sales")
    parts = temporal.one_step_forecasts(series).groupBy("part").count().toPandas().set_index("part")["count"]
    assert parts.sum() == 48 and (parts["train"], parts["validation"], parts["test"]) == (28, 10, 10)
    ahead = temporal.forecast(series).collect()
    assert len(ahead) == 6 and temporal.trend(series).first()["trend"] == "negative"


def test_time_folds_search_without_the_future(spark):
    df = demo.churn(spark.range(400)).select("customer_id", "tenure_months", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, int(id % 97))").alias("ts"),
                                             F.col("monthly_charges").alias("label"), F.lit("train").alias("part"))
    folds = splits.time_folds(df, "ts", 2)
    ends = {(r["fold"], r["role"]): (r["a"], r["b"]) for r in folds.groupBy("fold", "role").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()}
    assert all(ends[f, "train"][1] < ends[f, "validation"][0] for f in range(2))
    found = models.compare_models(folds, ["customer_id"], "regression", ["tenure_months"], [], k=2, names=["Baseline"]).collect()
    for r in found:
        part = folds.filter(F.col("fold") == r["fold"])
        middle = part.filter("role = 'train'").agg(F.avg("label").alias("m"), F.expr("median(label)").alias("d")).first()
        held = part.filter("role = 'validation'")
        options = [held.agg(F.sqrt(F.avg((F.col("label") - F.lit(v)) ** 2))).first()[0] for v in middle]
        assert min(abs(r["score"] - v) for v in options) < 1e-9 and r["status"] == "completed"


def test_shapley_adds_up(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"id": range(30), "a": rng.normal(size=30), "b": rng.normal(size=30), "c": rng.normal(size=30)}))
    model = lambda d: d.withColumn("score", F.col("a") * F.col("b") + F.sin("c"))
    ground = df.orderBy("id").limit(5)
    parts = explain.shapley(df, ground, ["a", "b", "c"], model, ["id"], 5, orders=2).groupBy("id").agg(F.sum("contribution").alias("s"))
    base = model(ground).agg(F.avg("score")).first()[0]
    off = model(df).join(parts, "id").agg(F.max(F.abs(F.col("score") - F.lit(base) - F.col("s")))).first()[0]
    assert off < 1e-9
    sources = {r["feature"]: r["source"] for r in features.encoded_sources(spark, ["price", "price net"], ["region"]).collect()}
    assert sources["n__price_net__missing"] == "price net" and sources["n__price"] == "price" and sources["c__0"] == "region"


def test_model_search_beats_baseline(spark):
    df = demo.churn(spark.range(1200)).withColumn("label", F.when(F.col("churn") == "Yes", 1.0).otherwise(0.0))
    rows = splits.random_folds(splits.random_split(df, ["customer_id"], "label"), ["customer_id"], 2, "label")
    ranked = models.ranking_of(models.compare_models(rows, ["customer_id"], "classification", ["tenure_months", "monthly_charges", "support_tickets", "usage_gb"],
                                                     ["contract_type"], 2, 2, ["Baseline", "Logistic regression"])).collect()
    assert ranked[0]["name"] == "Logistic regression" and ranked[0]["mean"] > ranked[1]["mean"] > 0.0


def test_scenarios_refuse_unknown_columns(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, x double")
    with pytest.raises(ValueError):
        registry.scenarios(df, ["id"], {"s": {"target": 1}}, lambda d: d, ["x"])


def test_analysis_is_repeatable(spark):
    panel = demo.churn(spark.range(300)).drop("id")
    first, second = (analyze(panel, ["customer_id"], "churn", anomalies=False) for _ in range(2))
    assert first.findings.collect() == second.findings.collect()
    kinds = {r["kind"] for r in first.evidence.select("kind").collect()}
    assert {"data_quality", "leakage", "imbalance"} <= kinds and first.recommendations.count() >= 1


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ("b", 2.5, 3)], "s string, d double, n long")
    for suffix in (".csv", ".json", ".parquet"):
        path = tables.write_table(df, str(tmp_path / f"t{suffix}"))
        back = tables.read_table(spark, path, df.schema)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
        assert tables.table_digest(back).first() == tables.table_digest(df.repartition(3)).first()
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")


def test_shared_steps_of_shapley_walks_are_one_row(spark):
    rows = [(1, 2.0, 5.0), (2, 1.0, -3.0), (3, None, 4.0), (4, 7.0, 1.0), (4, 7.0, 1.0)]
    df, seen = spark.createDataFrame(rows, "id long, a double, b double"), []

    def model(x):
        seen.append(x.count())
        return x.withColumn("score", F.col("a") * F.col("b"))

    ground = spark.createDataFrame([(k, float(k), float(k * k)) for k in range(3)], "id long, a double, b double")
    got = {(r.id, r.feature): (r.value, r.contribution) for r in explain.shapley(df, ground, ["a", "b"], model, ["id"], 3, orders=8).collect()}
    assert max(seen) <= len(rows) * 3 * 4 and sorted(got) == sorted((i, f) for i in (1, 2, 3, 4) for f in "ab")
    for i, a, b in rows:
        if a is not None:
            moved = [((a - k) * (b + k * k) / 2, (b - k * k) * (a + k) / 2) for k in range(3)]
            assert got[i, "a"] == (a, pytest.approx(sum(m[0] for m in moved) / 3)) and got[i, "b"] == (b, pytest.approx(sum(m[1] for m in moved) / 3))
    assert got[3, "a"] == (None, None) and got[3, "b"][1] == pytest.approx(sum((4.0 - k * k) * k for k in range(3)) / 3)


def test_a_single_series_broadcasts_its_frequency_and_not_its_rows(spark, tmp_path, capsys):
    """The rows of a small file look smaller to the planner than the aggregates that are joined with them."""
    path = str(tmp_path / "events")
    spark.range(40_000).selectExpr("timestamp_seconds(1700000000 + id * 60) AS ts", "double(id % 100) AS value").write.parquet(path)
    series = temporal.calendar_series(spark.read.parquet(path), "ts", "value")
    assert series.count() > 600
    capsys.readouterr()
    series.explain()
    lines = [(len(x) - len(x.lstrip(" :+-")), x) for x in capsys.readouterr().out.splitlines()]
    for i, (depth, line) in enumerate(lines):
        if "BroadcastExchange" in line:
            below = list(itertools.takewhile(lambda x: x[0] > depth, lines[i + 1:]))
            assert not any("FileScan" in x for _, x in below) or any("Aggregate" in x for _, x in below), line


def test_a_single_series_takes_quantiles_without_groups(spark, monkeypatch):
    asked, medians = [], temporal.q.medians
    monkeypatch.setattr(temporal.q, "medians", lambda df, columns, by=(), rows=None: asked.append(list(by)) or medians(df, columns, by, rows))
    df = spark.range(50).selectExpr("timestamp_seconds(1700000000 + id * 3600) AS ts", "double(id) AS value", "'x' AS k")
    one, keyed = temporal.calendar_series(df, "ts", "value"), temporal.calendar_series(df, "ts", "value", ["k"])
    assert asked == [[], ["k"]] and one.columns[0] == "series"
    rest = [c for c in one.columns if c != "series"]
    assert sorted(one.select(rest).collect()) == sorted(keyed.select(rest).collect()) and one.filter("series = 'all' AND frequency = 'h'").count() == 50
    assert temporal.calendar_series(df.limit(0), "ts", "value").count() == 0


def joins_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")


def test_short_rank_tables_do_not_shuffle_the_rows(spark, monkeypatch):
    """Columns of few values are ranked by a broadcast; one of many values (and its buckets) is joined in a shuffle."""
    monkeypatch.setattr(inference.ranking, "SMALL_ROWS", 50)
    monkeypatch.setattr(inference, "HELD_RANKS", 200)
    df = spark.range(600).selectExpr("double(id % 7) AS a", "double(id * id % 11) AS b", "double(id * 37 % 601) AS c")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = [("a", "b"), ("a", "c"), ("b", "c")]
        found = inference.spearman(df, pairs, ["a", "b", "c"])
        assert joins_of(inference.spearman(df, pairs[:1], ["a", "b"]))[1] == 0 and joins_of(found)[1] == 2
        got = {(r["left"], r["right"]): r["coefficient"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    table = df.toPandas().rank()
    assert all(got[p] == pytest.approx(table[p[0]].corr(table[p[1]])) for p in pairs)


def test_group_medians_are_broadcast(spark):
    df = spark.range(300).selectExpr("CAST(id % 4 AS STRING) AS g", "double(id * 17 % 101) AS v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        away = inference.deviation_rows(df, ["g"], ["v"])
        assert joins_of(away) == (1, 0)
        got = {r["label"]: r["mean"] for r in away.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    part = df.toPandas().groupby("g")["v"]
    assert all(got[g] == pytest.approx((v - v.median()).abs().mean()) for g, v in part)


def test_fits_read_even_parts(spark, monkeypatch):
    """A part of very many rows is dealt anew, smaller tables keep their parts; nothing but the used columns is cached."""
    rows = spark.range(0, 900, 1, 1).selectExpr("id", "double(id % 7) AS x", "double(id % 2) AS label", "int(id % 3 % 2) AS fold", "'train' AS part", "repeat('z', 50) AS unused")
    assert models.even_parts(rows).rdd.getNumPartitions() == 1 and models.even_parts(rows.limit(0)).count() == 0
    monkeypatch.setattr(models, "ROWS_A_TASK", 200)
    assert [len(p) for p in models.even_parts(rows).rdd.glom().collect()] == [180] * 5
    seen, keep = [], models.even_parts
    monkeypatch.setattr(models, "even_parts", lambda df: seen.append(df.columns) or keep(df))
    assert models.compare_models(rows, ["ID"], "classification", ["x"], [], k=2, names=["Baseline", "Decision tree"]).filter("status = 'completed'").count() == 4
    assert seen == [["id", "x", "label", "fold"]]
