"""Queries over splits, features, metrics, explanations and model runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from assayer.operators import boosting, clusters, explain, features, metrics, models, networks, ranking, registry, splits
from assayer.operators import profile as P
from assayer.operators.together import run_together
from assayer.plans.base import LINE_KEY, moved_sql, query, r, stamp, union_all
from assayer.plans.tables import _hash_parts_sql, _runs, RUNS

# ---- preparation ------------------------------------------------------------------------------


@query("ml_02_class_guard", """SELECT count(*) AS classes, min(n) AS rarest, CAST(sum(n) AS BIGINT) AS rows, count(*) BETWEEN 2 AND 20 AND min(n) >= 8 AND sum(n) >= 40 AS usable FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def _(t):
    return features.class_guard(t.events, "event_type")


@query("ml_03_positive_class", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST((SELECT toxic FROM labels GROUP BY 1 ORDER BY count(*), toxic LIMIT 1) AS VARCHAR) AS positive FROM labels")
def _(t):
    return t.labels.agg(F.count("*").alias("rows"), F.lit(features.positive_class(t.labels, "toxic")).alias("positive"))


@query("ml_04_exclusions", """SELECT 'doc_id' AS "column", 'unique identifier' AS reason UNION ALL SELECT 'text', 'high-cardinality text' UNION ALL SELECT 'lang', NULL UNION ALL SELECT 'source', NULL""")
def _(t):
    return features.exclusions(P.profile(t.documents, ["doc_id"]), "n_chars").select("column", "reason")


@query("ml_05_date_features", f"""SELECT event_id, CAST(year(ts) AS DOUBLE) AS ts__year, CAST(month(ts) AS DOUBLE) AS ts__month, CAST(isodow(ts) - 1 AS DOUBLE) AS ts__weekday,
    {r('sin(2 * pi() * month(ts) / 12)', 'ts__month_sin')}, {r('cos(2 * pi() * month(ts) / 12)', 'ts__month_cos')} FROM events""")
def _(t):
    return features.date_features(t.events.select("event_id", "ts"), ["ts"])


@query("ml_06_numeric", f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM events), f AS (SELECT event_id, coalesce(v, (SELECT median(v) FROM x)) AS v, CAST(v IS NULL AS DOUBLE) AS m FROM x)
    SELECT event_id, {r('(v - avg(v) OVER ()) / stddev_pop(v) OVER ()', 'value')}, {r('(m - avg(m) OVER ()) / stddev_pop(m) OVER ()', 'value__missing')} FROM f""")
def _(t):
    gaps = t.events.select("event_id", F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"))
    return features.scaled_numbers(gaps, ["value"])


@query("ml_07_categories", """WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) - 1 AS code, count(*) OVER () AS u FROM c)
    SELECT value, n AS rows, code FROM k WHERE code < CASE WHEN u <= 24 THEN 24 ELSE 23 END""")
def _(t):
    return features.category_codes(t.part, ["p_brand"]).select("value", "rows", "code")


@query("ml_08_random_split", f"SELECT o_orderkey, part FROM {_hash_parts_sql('orders', 'o_orderkey')}")
def _(t):
    return splits.split(t.orders, ["o_orderkey"]).select("o_orderkey", "part")


@query("ml_08_stratified", f"SELECT event_id, part FROM {_hash_parts_sql('events', 'event_id', 'event_type')}")
def _(t):
    return splits.split(t.events, ["event_id"], target="event_type").select("event_id", "part")


@query("ml_09_chronological", """WITH c AS (SELECT o_orderdate AS ts, sum(count(*)) OVER (ORDER BY o_orderdate) AS cum FROM orders GROUP BY 1), n AS (SELECT count(*) AS n FROM orders),
    a AS (SELECT arg_min(ts, (abs(cum - floor(n * 0.8)), cum)) AS ts, arg_min(cum, (abs(cum - floor(n * 0.8)), cum)) AS cum FROM c, n WHERE ts < (SELECT max(ts) FROM c)),
    b AS (SELECT arg_min(c.ts, (abs(c.cum - floor(a.cum * 0.8)), c.cum)) AS ts FROM c, a WHERE c.ts < a.ts)
    SELECT o_orderkey, CASE WHEN o_orderdate <= b.ts THEN 'train' WHEN o_orderdate <= a.ts THEN 'validation' ELSE 'test' END AS part FROM orders, a, b""")
def _(t):
    return splits.split(t.orders, ["o_orderkey"], "chronological", "o_orderdate").select("o_orderkey", "part")


@query("ml_10_group_split", f"SELECT conv_id, turn, part FROM conversations JOIN {_hash_parts_sql('(SELECT DISTINCT conv_id FROM conversations)', 'conv_id')} USING (conv_id)")
def _(t):
    return splits.split(t.conversations, ["conv_id", "turn"], "group", "conv_id").select("conv_id", "turn", "part")


@query("ml_11_split_report", f"""SELECT CAST(sum(CAST(part = 'train' AS INTEGER)) AS BIGINT) AS train, CAST(sum(CAST(part = 'validation' AS INTEGER)) AS BIGINT) AS validation, CAST(sum(CAST(part = 'test' AS INTEGER)) AS BIGINT) AS test,
    CAST(0 AS BIGINT) AS missing_classes, true AS usable FROM {_hash_parts_sql('events', 'event_id', 'event_type')}""")
def _(t):
    return splits.split_report(splits.split(t.events, ["event_id"], target="event_type"), "event_type")




@query("ml_12_stratified_folds", f"SELECT o_orderkey, CAST(CASE WHEN rk <= n * 1 // 3 THEN 0 WHEN rk <= n * 2 // 3 THEN 1 ELSE 2 END AS BIGINT) AS fold FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS rk, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)")
def _(t):
    return splits.random_folds(t.orders, ["o_orderkey"], 3, "o_orderstatus").select("o_orderkey", "fold")


@query("ml_13_shuffled_folds", "SELECT event_id, CAST(CASE WHEN rk <= n * 1 // 3 THEN 0 WHEN rk <= n * 2 // 3 THEN 1 ELSE 2 END AS BIGINT) AS fold FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR))) AS rk, count(*) OVER () AS n FROM events)")
def _(t):
    return splits.random_folds(t.events, ["event_id"], 3).select("event_id", "fold")


@query("ml_14_group_folds", """WITH RECURSIVE g AS (SELECT o_custkey, count(*) AS n, row_number() OVER (PARTITION BY count(*) ORDER BY md5(CAST(o_custkey AS VARCHAR)), o_custkey) AS place FROM orders GROUP BY 1),
    d AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS i FROM g),
    w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, 0 AS fold, CAST(0 AS HUGEINT) AS a, CAST(0 AS HUGEINT) AS b, CAST(0 AS HUGEINT) AS c UNION ALL
        SELECT i, n, fold, a + CASE WHEN fold = 0 THEN n ELSE 0 END, b + CASE WHEN fold = 1 THEN n ELSE 0 END, c + CASE WHEN fold = 2 THEN n ELSE 0 END FROM
        (SELECT d.i, d.n, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS fold, a, b, c FROM w JOIN d ON d.i = w.i + 1)),
    s AS (SELECT n, fold, sum(k) OVER (PARTITION BY n ORDER BY fold) AS upto, sum(k) OVER (PARTITION BY n ORDER BY fold) - k AS after FROM (SELECT n, fold, count(*) AS k FROM w WHERE i > 0 GROUP BY ALL))
    SELECT g.o_custkey, CAST(s.fold AS BIGINT) AS fold, g.n AS rows FROM g JOIN s ON s.n = g.n AND g.place > s.after AND g.place <= s.upto""")
def _(t):
    folded = splits.group_folds(t.orders, "o_custkey", 3)
    return folded.groupBy("o_custkey", "fold").agg(F.count("*").alias("rows"))


@query("ml_15_time_folds", """WITH d AS (SELECT o_orderdate AS ts, row_number() OVER (ORDER BY o_orderdate) - 1 AS c, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderdate FROM orders)),
    x AS (SELECT o.*, d.c, d.n, d.n // 4 AS b FROM orders o JOIN d ON o.o_orderdate = d.ts), f AS (SELECT unnest([0, 1, 2]) AS fold)
    SELECT CAST(fold AS BIGINT) AS fold, CASE WHEN c < n - (3 - fold) * b THEN 'train' ELSE 'validation' END AS role, count(*) AS rows FROM x, f WHERE c < n - (2 - fold) * b GROUP BY ALL""")
def _(t):
    return splits.time_folds(t.orders, "o_orderdate", 3).groupBy("fold", "role").agg(F.count("*").alias("rows"))


_PLANS = {"even": "CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END", "late": "CASE WHEN o_orderdate >= (SELECT quantile_disc(o_orderdate, 0.7) FROM (SELECT DISTINCT o_orderdate FROM orders)) THEN 1 ELSE 0 END"}


def _coverage_sql(name, label):
    """Every class in every role of every time fold?"""
    rows = f"(SELECT {label} AS label, o_orderdate AS ts FROM orders)"
    folds = f"""(SELECT label, fold, CASE WHEN c < n - (3 - fold) * b THEN 'train' ELSE 'validation' END AS role FROM (SELECT x.label, d.c, d.n, d.n // 4 AS b FROM {rows} x JOIN
        (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS c, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM {rows})) d USING (ts)), (SELECT unnest([0, 1, 2]) AS fold) WHERE c < n - (2 - fold) * b)"""
    whole = f"(SELECT count(*) FROM (SELECT DISTINCT fold, role, label FROM {folds})) = 6 * (SELECT count(DISTINCT label) FROM {rows})"
    return f"SELECT '{name}' AS target, CASE WHEN {whole} THEN 'completed' ELSE 'unavailable' END AS status, CAST(CASE WHEN {whole} THEN 3 ELSE 1 END AS BIGINT) AS folds, (SELECT count(*) FROM {folds}) * CASE WHEN {whole} THEN 1 ELSE 0 END + CASE WHEN {whole} THEN 0 ELSE (SELECT count(*) FROM orders) END AS rows"


@query("ml_15_plan", union_all(_coverage_sql(*x) for x in _PLANS.items()))
def _(t):
    """Time folds serve for a class that occurs throughout, and not for one that begins late."""
    days = t.orders.select("o_orderdate").distinct().withColumn("at", F.unix_micros("o_orderdate"))
    place = days.count() * 0.7
    cut = ranking.running_totals(days.withColumn("one", F.lit(1)), "at", ["one"]).filter(F.col("upto_one") >= place).agg(F.min("o_orderdate")).first()[0]
    labels = {"even": F.col("o_orderkey") % 2 == 0, "late": F.col("o_orderdate") >= F.lit(cut)}
    out = None
    for name, flag in labels.items():
        plan = splits.fold_plan(t.orders.withColumns({"part": F.lit("train"), "label": flag.cast("int")}), ["o_orderkey"], "classification", 3, "chronological", "o_orderdate")
        one = plan.rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("target"), F.lit(plan.status).alias("status"), F.lit(plan.folds).cast("long").alias("folds"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("ml_15b_fold_roles", """SELECT fold, role, count(*) AS rows FROM (SELECT unnest([0, 1, 2]) AS fold), (SELECT CASE WHEN rk <= n * 1 // 3 THEN 0 WHEN rk <= n * 2 // 3 THEN 1 ELSE 2 END AS f FROM
    (SELECT row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR))) AS rk, count(*) OVER () AS n FROM events)), LATERAL (SELECT CASE WHEN f = fold THEN 'validation' ELSE 'train' END AS role) GROUP BY ALL""".replace("SELECT fold, role", "SELECT CAST(fold AS BIGINT) AS fold, role"))
def _(t):
    return splits.fold_roles(splits.random_folds(t.events, ["event_id"], 3), 3).groupBy("fold", "role").agg(F.count("*").alias("rows"))


@query("ml_15c_eligibility", "SELECT family, eligible FROM (SELECT * FROM (VALUES ('baseline', true), ('linear', true), ('tree', true), ('ensemble', true), ('neural_network', true)) v(family, eligible)) WHERE (SELECT count(*) FROM lineitem) >= 100")
def _(t):
    width = features.encoded_width(P.profile(t.lineitem), "l_returnflag")
    return width.select(F.inline(features.eligibility("classification", F.col("rows"), F.col("width"))))


@query("ml_15c_width", "SELECT count(*) AS rows, CAST(10 AS BIGINT) AS features, CAST(8 * 2 + 2 + 10 AS BIGINT) AS width FROM lineitem")
def _(t):
    return features.encoded_width(P.profile(t.lineitem), "l_returnflag").select("rows", "features", "width")


@query("ml_15d_readiness", "SELECT 'event_type' AS target, 'classification' AS task, true AS ready, CAST(NULL AS VARCHAR) AS reason FROM events LIMIT 1")
def _(t):
    return features.readiness(P.profile(t.events, ["event_id"]), "event_type", "classification").select("target", "task", "ready", "reason")


@query("ml_01_detect", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'o_totalprice' ELSE 'o_orderstatus' END AS target FROM orders""")
def _(t):
    goals = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "Predict o totalprice").otherwise("What drives O_ORDERSTATUS?").alias("goal"))
    return P.match_targets(goals, "goal", t.orders.columns).select("o_orderkey", "target")


# ---- models -------------------------------------------------------------------------------------

@query("ml_16_prior", f"SELECT event_type AS class, {r('count(*) / (SELECT count(*) FROM events)', 'share')} FROM events GROUP BY 1")
def _(t):
    return models.prior_baseline(t.events, "event_type")


@query("ml_16_mean", f"SELECT {r('avg(o_totalprice)', 'prediction', 4)} FROM orders", 4)
def _(t):
    return models.mean_baseline(t.orders, "o_totalprice")


@query("ml_18_ridge_line", f"""SELECT count(*) AS n, {r('regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 10)', 'slope', 4)},
    {r('avg(l_extendedprice) - regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 10) * avg(l_quantity)', 'intercept', 3)} FROM lineitem""", 4)
def _(t):
    return models.ridge_line(t.lineitem, "l_quantity", "l_extendedprice").select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("ml_18_ridge_fit", f"""SELECT {r('regr_sxy(o_totalprice, o_custkey) / (regr_sxx(o_totalprice, o_custkey) + 10)', 'slope', 4)} FROM orders""", 4)
def _(t):
    from pyspark.ml.feature import VectorAssembler
    ready = VectorAssembler(inputCols=["o_custkey"], outputCol="features").transform(t.orders.withColumnRenamed("o_totalprice", "label"))
    weight = float(models.ridge(ready).fit(ready).coefficients[0])
    return ready.agg(F.lit(weight).alias("slope"), F.count("*").alias("n")).select("slope")


def _flag_rows(t):
    """Lineitem as a two-class problem with parts and folds."""
    li = t.lineitem.select(*LINE_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_linestatus", F.when(F.col("l_quantity") * (1 + F.col("l_discount")) > 27, 1.0).otherwise(0.0).alias("label"))
    return splits.random_folds(splits.random_split(li, LINE_KEY, "label"), LINE_KEY, 2, "label")


@query("ml_17_25_search")
def _(t):
    rows = _flag_rows(t)
    return models.ranking_of(models.compare_models(rows, LINE_KEY, "classification", ["l_quantity", "l_discount"], ["l_linestatus"], 2, 2,
                                                   ["Baseline", "Logistic regression", "Decision tree"]))


@query("ml_18_25_regression")
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_totalprice").alias("label"))
    rows = splits.random_folds(splits.random_split(o, ["o_orderkey"]), ["o_orderkey"], 2)
    return models.ranking_of(models.compare_models(rows, ["o_orderkey"], "regression", ["o_custkey"], ["o_orderpriority"], k=2,
                                                   names=["Baseline", "Ridge regression", "Decision tree"]))


@query("ml_19_22_ensembles")
def _(t):
    rows = _flag_rows(t)
    ready = features.feature_stages(rows, ["l_quantity", "l_discount"], ["l_linestatus"]).fit(rows).transform(models.balanced_weights(rows))
    ready = models.even_parts(ready.select("part", "features", "label", "weight")).persist()
    train, test, out = ready.filter("part = 'train'"), ready.filter("part = 'validation'"), []
    from pyspark.ml.classification import RandomForestClassifier
    width = ready.select("features").first()["features"].size
    few = {"Random forest": RandomForestClassifier(weightCol="weight", numTrees=10, maxDepth=8, minInstancesPerNode=3, seed=42),
           "Gradient boosting": boosting.CellBoosting(weightCol="weight", maxIter=5, maxDepth=5, seed=42), "Neural network": networks.Perceptron(layers=[width, 48, 24, 2], maxIter=20, seed=42)}
    for name, estimator in few.items():
        out.append((name, models.measure(models.predictions(estimator.fit(train), test, "classification"), "classification", 2)["average_precision"]))
    return t.spark.createDataFrame(out, "name string, average_precision double")


@query("ml_23_24_clusters")
def _(t):
    """Every cluster candidate of the search, fitted and measured on all rows."""
    from pyspark.ml.functions import array_to_vector
    rows = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()

    def measured(name, model):
        m = models.measure(models.predictions(model, rows, "clustering"), "clustering", 0, ["vec_id"])
        return name, m["silhouette"], m["davies_bouldin"], m["clusters"]

    names, _, estimators = zip(*models.candidates("clustering"))
    out = run_together(t.spark, *[lambda n=name, m=model: measured(n, m) for name, model in zip(names, clusters.fit_together(estimators, rows))])
    return t.spark.createDataFrame(out, "name string, silhouette double, davies_bouldin double, clusters long")


POINTS = "(SELECT o_orderkey, o_totalprice / 100000 AS x, o_custkey % 100 / 20 AS y FROM orders)"
FIRST_CENTRES = [[[0.5, 1.0], [2.0, 4.0], [4.0, 2.0]], [[1.0, 0.013], [1.0, 2.507], [1.0, 4.511]]]
MIXTURE = ([0.5, 0.3, 0.2], FIRST_CENTRES[0], [[1.0, 0.5], [2.0, 1.5], [0.7, 1.0]])


def _points(t):
    return t.orders.select("o_orderkey", F.array(F.col("o_totalprice") / 100000, F.col("o_custkey") % 100 / 20).alias("features"))


def _lloyd_sql(start, centres):
    far = [f"(x - {a}) * (x - {a}) + (y - {b}) * (y - {b})" for a, b in centres]
    nearest = "CASE WHEN d0 <= least(d1, d2) THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END"
    return f"""SELECT {start} AS start, g AS cluster, count(*) AS n, {r('avg(x)', 'x')}, {r('avg(y)', 'y')}, {r('sum(least(d0, d1, d2))', 'inertia', 4)}
        FROM (SELECT *, {nearest} AS g FROM (SELECT x, y, {', '.join(f'{f} AS d{k}' for k, f in enumerate(far))} FROM {POINTS})) GROUP BY g"""


@query("ml_23_lloyd_round", f"SELECT start, cluster, n, x, y, {r('sum(inertia) OVER (PARTITION BY start)', 'inertia', 2)} FROM ({union_all(_lloyd_sql(s, c) for s, c in enumerate(FIRST_CENTRES))})")
def _(t):
    """One round of k-means from two starts at once."""
    n, means, inertia = clusters.lloyd_round(_points(t), "features", np.array(FIRST_CENTRES))
    rows = [(s, g, int(n[s, g]), *map(float, means[s, g]), round(float(inertia[s]), 2)) for s in range(2) for g in range(3)]
    return t.spark.createDataFrame(rows, "start int, cluster int, n long, x double, y double, inertia double")


def _em_sql():
    weights, means, variances = MIXTURE
    parts = ", ".join(f"{w} / (2 * pi() * sqrt({v} * {u})) * exp(-((x - {a}) * (x - {a}) / {v} + (y - {b}) * (y - {b}) / {u}) / 2) AS p{k}" for k, (w, (a, b), (v, u)) in enumerate(zip(weights, means, variances)))
    rows = f"(SELECT x, y, p0 / (p0 + p1 + p2) AS r0, p1 / (p0 + p1 + p2) AS r1, p2 / (p0 + p1 + p2) AS r2, ln(p0 + p1 + p2) AS l FROM (SELECT x, y, {parts} FROM {POINTS}))"
    return union_all(f"""SELECT {k} AS "group", {r(f'avg(r{k})', 'weight')}, {r(f'sum(r{k} * x) / sum(r{k})', 'x')}, {r(f'sum(r{k} * y) / sum(r{k})', 'y')},
        {r(f'sum(r{k} * x * x) / sum(r{k}) - (sum(r{k} * x) / sum(r{k})) ** 2 + 0.0001', 'var_x')}, {r(f'sum(r{k} * y * y) / sum(r{k}) - (sum(r{k} * y) / sum(r{k})) ** 2 + 0.0001', 'var_y')}, {r('sum(l) / count(*)', 'likelihood')} FROM {rows}""" for k in range(3))


@query("ml_24_em_round", _em_sql())
def _(t):
    """One round of expectation-maximisation of a diagonal mixture."""
    weights, means, variances = map(np.array, MIXTURE)
    fitted, total = clusters.mixture_of(clusters.Mixture(weights, means, variances).shares, _points(t), "features", 3, 2, clusters.VARIANCE_FLOOR)
    n = t.orders.count()
    rows = [(k, float(fitted.weights[k]), *map(float, fitted.means[k]), *map(float, fitted.variances[k]), total / n) for k in range(3)]
    return t.spark.createDataFrame(rows, "group int, weight double, x double, y double, var_x double, var_y double, likelihood double")


@query("ml_26_final_model")
def _(t):
    _, pred = models.final_model(_flag_rows(t), LINE_KEY, "classification", ["l_quantity", "l_discount"], ["l_linestatus"], "Decision tree")
    return metrics.classification_metrics(pred)


PAIRED = {"first": "(event_id % 100) / 100", "second": "(event_id * 7 % 40) / 80 + 0.2"}


def _paired_sql(model, score):
    base = f"(SELECT CAST({score} AS DOUBLE) AS score, CAST(event_id % 3 = 0 AS INTEGER) AS label FROM events)"
    ranks = f"(SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM {base})"
    steps = f"(SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM {base} GROUP BY 1) WINDOW w AS (ORDER BY score DESC))"
    cells = ["accuracy", "precision", "recall", "f1", "balanced_accuracy"]
    decided = f"""(SELECT (tp + n - fp) / (p + n) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, tp / p AS recall, 2 * tp / (tp + fp + p) AS f1, (tp / p + (n - fp) / n) / 2 AS balanced_accuracy FROM
        (SELECT CAST(count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS DOUBLE) AS fp, CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS n FROM {base}))"""
    bins = f"(SELECT abs(sum(score) - sum(label)) AS off, count(*) AS n FROM {base} GROUP BY least(floor(score * 10), 9))"
    auc = f"(SELECT (sum(k) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * CAST(sum(1 - label) AS DOUBLE)) FROM {ranks})"
    return f"""SELECT '{model}' AS model, (SELECT count(*) FROM events) AS rows, {r(auc, 'roc_auc')}, {r(f'(SELECT sum(pos / p * tp / (tp + fp)) FROM {steps})', 'average_precision')}, {', '.join(r(c, c) for c in cells)},
        {r(f'(SELECT avg((score - label) ** 2) FROM {base})', 'brier_score')}, {r(f'(SELECT sum(off) / sum(n) FROM {bins})', 'calibration_error')} FROM {decided}"""


@query("ml_26_paired", union_all(_paired_sql(*x) for x in PAIRED.items()))
def _(t):
    """Two models judged on the same rows from one table of distinct scores."""
    e = F.col("event_id")
    pred = t.events.select((e % 3 == 0).cast("int").alias("label"), ((e % 100) / 100).alias("a"), (e * 7 % 40 / 80 + 0.2).alias("b"))
    return metrics.paired_metrics(metrics.score_points(pred, {"first": "a", "second": "b"})).drop("thresholds")


@query("ml_26_paired_thresholds", f"""SELECT model, {r('t', 'threshold')}, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {r('tp / p', 'recall')} FROM ({union_all(f"SELECT '{m}' AS model, t, CAST(count(*) FILTER (WHERE {s} >= t AND event_id % 3 = 0) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE {s} >= t AND event_id % 3 <> 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE event_id % 3 = 0) AS DOUBLE) AS p FROM events, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS t) GROUP BY t" for m, s in PAIRED.items())})""")
def _(t):
    e = F.col("event_id")
    pred = t.events.select((e % 3 == 0).cast("int").alias("label"), ((e % 100) / 100).alias("a"), (e * 7 % 40 / 80 + 0.2).alias("b"))
    found = metrics.paired_metrics(metrics.score_points(pred, {"first": "a", "second": "b"}))
    return found.select("model", F.inline("thresholds")).select("model", "threshold", "precision", "recall")


# ---- evaluation ---------------------------------------------------------------------------------

def _classes(t):
    """Return flag predicted from the ship date by rule: three classes."""
    day = F.col("l_shipdate")
    rule = F.when(day < "1997-06-01", "A").when(day < "1999-12-01", "R").otherwise("N")
    return t.lineitem.select(*LINE_KEY, F.col("l_returnflag").alias("label"), rule.alias("prediction"), (F.col("l_discount") * 5 + 0.5).alias("confidence"))


CLASSES = """(SELECT l_orderkey, l_returnflag AS label, CASE WHEN l_shipdate < TIMESTAMP '1997-06-01' THEN 'A' WHEN l_shipdate < TIMESTAMP '1999-12-01' THEN 'R' ELSE 'N' END AS prediction, l_discount * 5 + 0.5 AS confidence,
    l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
REPORT = f"""(SELECT c AS class, coalesce(h / NULLIF(p, 0), 0) AS precision, coalesce(h / NULLIF(a, 0), 0) AS recall, coalesce(2 * h / NULLIF(a + p, 0), 0) AS f1, a AS support, h AS hits FROM (
    SELECT c, CAST(count(*) FILTER (WHERE label = c) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE prediction = c) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE label = c AND prediction = c) AS DOUBLE) AS h
    FROM {CLASSES}, (SELECT unnest(['A', 'N', 'R']) AS c) GROUP BY 1))"""


@query("evl_01_metrics", f"""SELECT {r('sum(hits) / sum(support)', 'accuracy')}, {r('avg(recall)', 'balanced_accuracy')}, {r('sum(support * precision) / sum(support)', 'precision')}, {r('sum(support * recall) / sum(support)', 'recall')},
    {r('sum(support * f1) / sum(support)', 'f1')}, {r('avg(f1)', 'f1_macro')} FROM {REPORT}""")
def _(t):
    return metrics.classification_metrics(_classes(t))


@query("evl_02_confusion", f"SELECT label, prediction, count(*) AS rows FROM {CLASSES} GROUP BY ALL")
def _(t):
    return metrics.confusion(_classes(t))


def _scores(t):
    """High order value scored by a blend of customer number and price."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round((F.col("o_totalprice") / 500000 + (F.col("o_custkey") % 100) / 100) / 2, 3)))
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 350000, 1).otherwise(0).alias("label"), score.alias("score")).withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))


SCORES = """(SELECT o_orderkey, CASE WHEN o_totalprice > 350000 THEN 1 ELSE 0 END AS label, CAST(least(1.0, greatest(0.0, round((o_totalprice / 500000 + (o_custkey % 100) / 100) / 2, 3))) AS DOUBLE) AS score FROM orders)"""


@query("evl_03_positive", f"SELECT {r('sum(label * CAST(score >= 0.5 AS INTEGER)) / sum(CAST(score >= 0.5 AS INTEGER))', 'positive_precision')}, {r('sum(label * CAST(score >= 0.5 AS INTEGER)) / sum(label)', 'positive_recall')} FROM {SCORES}")
def _(t):
    return metrics.positive_metrics(_scores(t))


@query("evl_04_roc_auc", f"""WITH k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM {SCORES}), n AS (SELECT CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS n FROM k)
    SELECT {r('(sum(k) FILTER (WHERE label = 1) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(n))', 'roc_auc')} FROM k, n""")
def _(t):
    return metrics.ranking_metrics(_scores(t)).select("roc_auc")


STEPS = f"""(WITH c AS (SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM {SCORES} GROUP BY 1)
    SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n, row_number() OVER w AS place, count(*) OVER () AS d FROM c WINDOW w AS (ORDER BY score DESC))"""


@query("evl_05_average_precision", f"SELECT {r('sum(pos / p * tp / (tp + fp))', 'average_precision')} FROM {STEPS}")
def _(t):
    return metrics.ranking_metrics(_scores(t), rows=2_000_000, buckets=64).select("average_precision")


THIN = "(d < 100 OR floor(ceil(place / greatest(d / 99.0, 1.0)) * greatest(d / 99.0, 1.0)) = place)"


@query("evl_06_roc_curve", f"SELECT place, {r('score', 'score')}, {r('fp / n', 'fpr')}, {r('tp / p', 'tpr')} FROM {STEPS} WHERE {THIN}")
def _(t):
    return metrics.roc_points(_scores(t))


@query("evl_06_pr_curve", f"SELECT place, {r('score', 'score')}, {r('tp / p', 'recall')}, {r('tp / (tp + fp)', 'precision')} FROM {STEPS} WHERE {THIN}")
def _(t):
    return metrics.pr_points(_scores(t))


def _regressed(t):
    return t.orders.select("o_orderkey", F.col("o_totalprice").alias("label"), (F.col("o_custkey") * 100.0 + 180000).alias("prediction"))


REGRESSED = "(SELECT o_orderkey, o_totalprice AS label, CAST(o_custkey * 100.0 + 180000 AS DOUBLE) AS prediction FROM orders)"


@query("evl_07_regression", f"SELECT {r('avg(abs(label - prediction))', 'mae', 3)}, {r('sqrt(avg((label - prediction) ^ 2))', 'rmse', 3)}, {r('1 - sum((label - prediction) ^ 2) / (var_pop(label) * count(*))', 'r2', 3)} FROM {REGRESSED}", 3)
def _(t):
    return metrics.regression_metrics(_regressed(t))


SAMPLE600 = "(SELECT * FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 600)"


@query("evl_08_silhouette", f"""WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v, label AS c FROM {SAMPLE600}), d AS (SELECT a.i, a.c, b.c AS o, avg(list_distance(a.v, b.v)) AS m FROM e a JOIN e b ON a.i <> b.i GROUP BY ALL),
    s AS (SELECT i, max(m) FILTER (WHERE o = c) AS a, min(m) FILTER (WHERE o <> c) AS b FROM d GROUP BY 1)
    SELECT {r('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)', 'silhouette', 5)}, count(*) AS rows FROM s""", 5)
def _(t):
    return metrics.silhouette(t.embeddings.withColumn("v", F.col("embedding").cast("array<double>")), "v", "label", ["vec_id"])


CENTRES = """(SELECT label, list(m ORDER BY dim) AS c, max(n) AS n FROM (SELECT label, dim, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


@query("evl_09_cluster_scores", f"""WITH k AS {CENTRES}, d AS (SELECT label, list_distance(CAST(embedding AS DOUBLE[]), c) AS d FROM embeddings JOIN k USING (label)), s AS (SELECT label, avg(d) AS s, sum(d * d) AS w FROM d GROUP BY 1),
    p AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS r FROM k a JOIN k b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY 1),
    g AS (SELECT list(m ORDER BY dim) AS c FROM (SELECT dim, avg(x) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1)),
    b AS (SELECT sum(n * list_distance(k.c, g.c) ^ 2) AS b, count(*) AS k, sum(n) AS n FROM k, g)
    SELECT {r('(SELECT avg(r) FROM p)', 'davies_bouldin', 5)}, {r('b / (k - 1) / ((SELECT sum(w) FROM s) / (n - k))', 'calinski_harabasz', 5)}, k AS clusters FROM b""", 5)
def _(t):
    return metrics.cluster_metrics(t.embeddings, "embedding", "label")


@query("evl_10_residuals", f"SELECT o_orderkey, {r('label', 'actual', 3)}, {r('prediction', 'predicted', 3)}, {r('label - prediction', 'residual', 3)} FROM {REGRESSED} ORDER BY o_orderkey LIMIT 300", 3)
def _(t):
    return metrics.residuals(_regressed(t), ["o_orderkey"])


@query("evl_11_projection")
def _(t):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    rows = t.embeddings.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    flat = PCA(k=2, inputCol="features", outputCol="p").fit(rows).transform(rows)
    return flat.select("vec_id", "label", vector_to_array("p")[0].alias("x"), vector_to_array("p")[1].alias("y")).orderBy("vec_id").limit(400)


@query("evl_12_cluster_profile", f"SELECT label, count(*) AS rows, {r('avg(vec_id)', 'mean_vec_id', 3)}, {r('count(*) / (SELECT count(*) FROM embeddings)', 'share')} FROM embeddings GROUP BY 1".replace("SELECT label", "SELECT CAST(label AS BIGINT) AS label"))
def _(t):
    return metrics.cluster_profile(t.embeddings, "label", ["vec_id"])


BINS = f"(SELECT least(floor(score * 10), 9) AS b, count(*) AS n, sum(score) AS s, sum(label) AS y, sum((score - label) ^ 2) AS e FROM {SCORES} GROUP BY 1)"


@query("evl_13_calibration_bins", f"SELECT CAST(b AS BIGINT) AS bin, {r('s / n', 'predicted_probability')}, {r('y / n', 'observed_frequency')}, n AS rows FROM {BINS}")
def _(t):
    return metrics.calibration_bins(_scores(t))


@query("evl_13_calibration", f"SELECT {r('sum(e) / sum(n)', 'brier_score')}, {r('sum(abs(s - y)) / sum(n)', 'calibration_error')}, CASE WHEN sum(abs(s - y)) / sum(n) < 0.05 THEN 'good' WHEN sum(abs(s - y)) / sum(n) < 0.1 THEN 'moderate' ELSE 'poor' END AS status FROM {BINS}")
def _(t):
    return metrics.calibration(_scores(t))


@query("evl_14_multiclass_brier", f"""SELECT {r('avg((p0 - CAST(y = 0 AS INTEGER)) ^ 2 + (p1 - CAST(y = 1 AS INTEGER)) ^ 2 + (p2 - CAST(y = 2 AS INTEGER)) ^ 2)', 'brier_score')} FROM
    (SELECT o_orderkey % 3 AS y, 0.5 AS p0, (o_custkey % 10) / 20 AS p1, 0.5 - (o_custkey % 10) / 20 AS p2 FROM orders)""")
def _(t):
    x = (F.col("o_custkey") % 10) / 20
    return metrics.multiclass_brier(t.orders.select((F.col("o_orderkey") % 3).alias("label"), F.array(F.lit(0.5), x, 0.5 - x).alias("probability")))


@query("evl_15_thresholds", f"""WITH c AS (SELECT CAST(t AS DOUBLE) AS t, CAST(count(*) FILTER (WHERE score >= t AND label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE score >= t AND label = 0) AS DOUBLE) AS fp, CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS n
    FROM {SCORES}, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS t) GROUP BY 1)
    SELECT {r('t', 'threshold')}, {r('coalesce(tp / NULLIF(tp + fp, 0), 0)', 'precision')}, {r('coalesce(tp / NULLIF(p, 0), 0)', 'recall')}, {r('coalesce(2 * tp / NULLIF(2 * tp + fp + p - tp, 0), 0)', 'f1')},
    {r('(coalesce(tp / NULLIF(p, 0), 0) + coalesce((n - fp) / NULLIF(n, 0), 0)) / 2', 'balanced_accuracy')} FROM c""")
def _(t):
    return metrics.thresholds(_scores(t))


@query("evl_16_stability", f"""WITH f AS (SELECT o_orderpriority AS k, year(o_orderdate) AS y, avg(o_totalprice) AS s FROM orders GROUP BY ALL)
    SELECT k, {r('avg(s)', 'mean', 3)}, {r('stddev_pop(s)', 'std', 3)}, CASE WHEN stddev_pop(s) / abs(avg(s)) <= 0.1 THEN 'stable' WHEN stddev_pop(s) / abs(avg(s)) <= 0.2 THEN 'variable' ELSE 'unstable' END AS status FROM f GROUP BY 1""", 3)
def _(t):
    folds = t.orders.groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("score"))
    return metrics.stability(folds, ["k"]).select("k", "mean", "std", "status")


@query("evl_17_beats_baseline", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice < 250000 ELSE o_totalprice > 250000 END AS beats FROM orders")
def _(t):
    rows = t.orders.withColumn("metric", F.when(F.col("o_orderkey") % 2 == 0, "rmse").otherwise("f1_macro")).withColumn("base", F.lit(250000.0))
    return rows.select("o_orderkey", metrics.beats_baseline("metric", "o_totalprice", "base").alias("beats"))


@query("evl_18_report", f"SELECT class, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')}, CAST(support AS BIGINT) AS support FROM {REPORT}")
def _(t):
    return metrics.class_report(_classes(t)).drop("hits")


@query("evl_19_errors", f"SELECT {r('avg(label - prediction)', 'mean_residual', 3)}, {r('quantile_cont(abs(label - prediction), 0.95)', 'p95_absolute_error', 3)} FROM {REGRESSED}", 3)
def _(t):
    return metrics.regression_errors(_regressed(t))


@query("top_03_residuals", f"SELECT o_orderkey, {r('abs(label - prediction)', 'error', 3)} FROM {REGRESSED} ORDER BY abs(label - prediction) DESC, o_orderkey LIMIT 12", 3)
def _(t):
    return metrics.worst_errors(_regressed(t), ["o_orderkey"]).select("o_orderkey", "error")


@query("evl_20_mistakes", f"SELECT l_orderkey, label, prediction, {r('confidence', 'confidence')} FROM {CLASSES} WHERE label <> prediction ORDER BY round(confidence, 6) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 12")
def _(t):
    return metrics.confident_mistakes(_classes(t).withColumn("confidence", F.round("confidence", 6)), LINE_KEY).select("l_orderkey", "label", "prediction", "confidence")


@query("evl_21_ambiguity", f"""WITH k AS {CENTRES}, d AS (SELECT vec_id, list_sort(list(list_distance(CAST(embedding AS DOUBLE[]), c))) AS d FROM embeddings, k GROUP BY 1)
    SELECT vec_id, {r('1 / (1 + d[2] - d[1])', 'ambiguity', 5)} FROM d ORDER BY 1 / (1 + d[2] - d[1]) DESC, vec_id LIMIT 12""", 5)
def _(t):
    near = metrics.distances_to(t.embeddings, "embedding", metrics.centroids(t.embeddings, "embedding", "label"))
    return metrics.ambiguity(near, "distances", ["vec_id"]).select("vec_id", "ambiguity")


@query("evl_21_membership", f"SELECT o_orderkey, {r('1 - greatest(p, 1 - p)', 'ambiguity')} FROM (SELECT o_orderkey, (o_custkey % 1000) / 1000 AS p FROM orders) ORDER BY round(1 - greatest(p, 1 - p), 6) DESC, o_orderkey LIMIT 12")
def _(t):
    p = (F.col("o_custkey") % 1000) / 1000
    return metrics.membership_ambiguity(t.orders.select("o_orderkey", F.array(p, 1 - p).alias("m")), "m", ["o_orderkey"]).select("o_orderkey", "ambiguity")


# ---- explanations -------------------------------------------------------------------------------

def _rule(df):
    return df.withColumn("score", F.col("o_totalprice") * 0.5 + F.col("o_custkey") * 3.0)


def _rule_rows(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_totalprice") * 0.5 + F.col("o_custkey") * 3.0).alias("y"))


def _importance_sql():
    base = "(SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice * 0.5 + o_custkey * 3.0 AS y, row_number() OVER (ORDER BY md5('rows|' || o_orderkey), o_orderkey) - 1 AS place FROM orders)"
    parts = []
    for i in range(3):
        for f, score in (("o_totalprice", "b.o_totalprice * 0.5 + a.o_custkey * 3.0"), ("o_custkey", "a.o_totalprice * 0.5 + b.o_custkey * 3.0")):
            parts.append(f"SELECT '{f}' AS feature, avg(abs(a.y - ({score}))) AS d FROM {base} a JOIN {moved_sql(base, str(i))} b ON b.target = a.place")
    return f"SELECT feature, {r('avg(d)', 'importance', 3)}, {r('stddev_pop(d)', 'std', 3)} FROM ({union_all(parts)}) GROUP BY 1"


@query("exp_01_permutation", _importance_sql(), 3)
def _(t):
    return explain.permutation_importance(_rule_rows(t), ["o_totalprice", "o_custkey"], _rule, -F.avg(F.abs(F.col("y") - F.col("score"))), ["o_orderkey"])


LINEAR = """(WITH m AS (SELECT avg(o_totalprice) AS a, avg(o_custkey) AS b FROM orders) SELECT o_orderkey, 'o_totalprice' AS feature, o_totalprice AS value, 0.5 * (o_totalprice - a) AS contribution FROM orders, m
    UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey, 3.0 * (o_custkey - b) FROM orders, m)"""


def _linear(t):
    means = t.orders.agg(F.avg("o_totalprice").alias("o_totalprice"), F.avg("o_custkey").alias("o_custkey")).first().asDict()
    return explain.linear_contributions(t.orders, {"o_totalprice": 0.5, "o_custkey": 3.0}, means, ["o_orderkey"])


@query("exp_02_linear", f"SELECT o_orderkey, feature, {r('value', 'value', 3)}, {r('contribution', 'contribution', 3)} FROM {LINEAR}", 3)
def _(t):
    return _linear(t)


@query("exp_03_shapley", f"""WITH g AS (SELECT avg(o_totalprice) AS a, avg(o_custkey) AS b FROM (SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)) LIMIT 8))
    SELECT o_orderkey, 'o_totalprice' AS feature, {r('0.5 * (o_totalprice - a)', 'contribution', 3)} FROM orders, g UNION ALL SELECT o_orderkey, 'o_custkey', {r('3.0 * (o_custkey - b)', 'contribution', 3)} FROM orders, g""", 3)
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_custkey")
    ground = explain.explained_sample(rows, ["o_orderkey"], 8)
    return explain.shapley(rows, ground, ["o_totalprice", "o_custkey"], _rule, ["o_orderkey"], 8).select("o_orderkey", "feature", "contribution")


_PARTS = "CAST(o_custkey % 2 AS DOUBLE) AS a, CAST(o_orderkey % 3 = 0 AS DOUBLE) AS b, CAST(o_orderstatus = 'F' AS DOUBLE) AS c"
# The rule 4a + 2bc + ac: a product of two features is shared by halves.
_TREE_SQL = f"""WITH x AS (SELECT o_orderkey, {_PARTS} FROM orders), z AS (SELECT {_PARTS} FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 40),
    s AS (SELECT o_orderkey, x.a, x.b, x.c, avg(4 * (x.a - z.a) + (x.a - z.a) * (x.c + z.c) / 2) AS fa, avg((x.b - z.b) * (x.c + z.c)) AS fb, avg((x.c - z.c) * (x.b + z.b) + (x.c - z.c) * (x.a + z.a) / 2) AS fc
        FROM x, z GROUP BY ALL) {union_all(f"SELECT o_orderkey, CAST(0 AS BIGINT) AS output, '{f}' AS feature, {f} AS value, {r(f'f{f}', 'contribution')} FROM s" for f in 'abc')}"""


@query("exp_03_trees", _TREE_SQL)
def _(t):
    """Exact contributions to a fitted tree that has learned a rule."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    from assayer.operators.tree_paths import tree_contributions
    o = t.orders.select("o_orderkey", (F.col("o_custkey") % 2).cast("double").alias("a"), (F.col("o_orderkey") % 3 == 0).cast("double").alias("b"), (F.col("o_orderstatus") == "F").cast("double").alias("c"))
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(o.withColumn("label", 4 * F.col("a") + 2 * F.col("b") * F.col("c") + F.col("a") * F.col("c")))
    model = DecisionTreeRegressor(maxDepth=3).fit(rows)
    return tree_contributions(rows, rows, model, ["a", "b", "c"], ["o_orderkey"], t.scratch("-tree"), 40)


@query("exp_04_summary", f"SELECT 'order' AS feature, {r('sum(m)', 'importance', 3)} FROM (SELECT feature, avg(abs(contribution)) AS m FROM {LINEAR} GROUP BY 1)", 3)
def _(t):
    names = _linear(t).select("feature").distinct()
    return explain.contribution_summary(_linear(t), names.withColumn("source", F.lit("order")))


@query("exp_05_directions", f"""SELECT feature, n, {r('c', 'coefficient', 4)}, 'higher with higher values' AS direction FROM (SELECT feature, count(*) AS n, corr(a, b) AS c FROM (
    SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature ORDER BY round(contribution, 6)) + (count(*) OVER (PARTITION BY feature, round(contribution, 6)) - 1) / 2.0 AS b FROM {LINEAR}) GROUP BY 1) WHERE abs(c) >= 0.5""", 4)
def _(t):
    return explain.directions(_linear(t).withColumn("contribution", F.round("contribution", 6)), ["o_totalprice", "o_custkey"], ["o_orderkey"])


@query("exp_06_row_list", "SELECT o_orderkey, arg_max(feature, abs(contribution)) AS strongest FROM " + LINEAR + " GROUP BY 1")
def _(t):
    return explain.row_contributions(_linear(t), ["o_orderkey"]).select("o_orderkey", F.get("contributions", F.lit(0))["feature"].alias("strongest"))


# ---- scoring and registry -----------------------------------------------------------------------

@query("reg_01_score", f"SELECT o_orderkey, {r('o_totalprice * 0.5 + o_custkey * 3.0', 'score', 3)} FROM orders WHERE o_orderkey % 50 <> 0", 3)
def _(t):
    raw = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, F.lit("broken")).otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"), "o_totalprice")
    return registry.score(raw, ["o_orderkey"], _rule, ["o_custkey", "o_totalprice"], ["o_custkey", "o_totalprice"]).select("o_orderkey", "score")


@query("reg_01_model_score")
def _(t):
    from pyspark.ml.feature import VectorAssembler
    ready = VectorAssembler(inputCols=["o_custkey"], outputCol="features").transform(t.orders.withColumnRenamed("o_totalprice", "label"))
    model = models.ridge(ready).fit(ready)
    path = t.scratch(".model")
    model.write().save(path)
    from pyspark.ml.regression import LinearRegressionModel
    return LinearRegressionModel.load(path).transform(ready).select("o_orderkey", "prediction")


@query("reg_02_scenarios", f"SELECT o_orderkey, {r('o_totalprice * 0.5 + o_custkey * 3.0', 'baseline', 3)}, {r('CAST(100000 * 0.5 + o_custkey * 3.0 AS DOUBLE)', 'cheap', 3)}, {r('o_totalprice * 0.5 + 1 * 3.0', 'first_customer', 3)} FROM orders", 3)
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return registry.scenarios(rows, ["o_orderkey"], {"cheap": {"o_totalprice": 100000.0}, "first_customer": {"o_custkey": 1}}, _rule, ["o_custkey", "o_totalprice"])


@query("reg_03_input_schema", """SELECT 'o_orderpriority' AS "column", 'string' AS type, (SELECT o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 1) AS example, (SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders) AS categories
    UNION ALL SELECT 'o_custkey', 'number', (SELECT CAST(o_custkey AS VARCHAR) FROM orders ORDER BY o_orderkey LIMIT 1), NULL""")
def _(t):
    s = registry.input_schema(P.profile(t.orders, ["o_orderkey"]), ["o_orderpriority", "o_custkey"])
    return s.withColumn("categories", F.array_join("categories", ","))


@query("reg_04_leaderboard", f"""WITH d AS (SELECT * FROM {RUNS} WHERE status = 'completed'), g AS (SELECT experiment, count(*) AS comparable_runs, count(DISTINCT (task, target, metric, split)) AS contracts,
    arg_min(run, (CASE WHEN task = 'regression' THEN selection_score ELSE -selection_score END, run)) AS run, arg_min(selection_score, (CASE WHEN task = 'regression' THEN selection_score ELSE -selection_score END, run)) AS s FROM d GROUP BY 1)
    SELECT experiment, comparable_runs, contracts, CASE WHEN contracts = 1 THEN run END AS best_run, {r('CASE WHEN contracts = 1 THEN s END', 'best_score')} FROM g""")
def _(t):
    return registry.leaderboard(_runs(t))


@query("reg_05_run_summary", f"SELECT status, task, count(*) AS runs, {stamp('max(created)', 'newest')} FROM {RUNS} GROUP BY ALL")
def _(t):
    return _runs(t).groupBy("status", "task").agg(F.count("*").alias("runs"), F.max("created").alias("newest"))


@query("reg_06_record", """SELECT count(*) AS rows, sha256('{"part":"test","seed":42}') AS config_digest FROM lineitem""")
def _(t):
    from assayer.sources.tables import config_digest
    one = t.lineitem.agg(F.count("*").alias("rows")).withColumns({"seed": F.lit(42), "part": F.lit("test")})
    return config_digest(one, ["seed", "part"]).select("rows", "config_digest")


@query("top_03_ambiguous_orders", f"SELECT count(*) AS rows, {r('max(abs(label - prediction))', 'largest', 3)} FROM {REGRESSED}", 3)
def _(t):
    return _regressed(t).agg(F.count("*").alias("rows"), F.max(F.abs(F.col("label") - F.col("prediction"))).alias("largest"))


