"""Model candidates, their comparison on folds and the refit of the winner."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import metrics, splits
from assayer.operators.clusters import Centroids, DiagonalMixture
from assayer.operators.features import WIDEST, feature_stages
from assayer.operators.together import run_together

BINARY, MULTICLASS, REGRESSION, CLUSTERING = "average_precision", "f1_macro", "rmse", "silhouette"
#: Rows of a part beyond which rows are dealt anew before a fit.
ROWS_A_TASK = 1_000_000


def even_parts(df: DataFrame) -> DataFrame:
    """df in parts of ``ROWS_A_TASK`` rows or so, or as it is if none is larger.

    Caches, and the copies of the rows that trees make, take a few hundred bytes a row, whatever the files say.
    """
    parts = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    return df if (parts["most"] or 0) <= ROWS_A_TASK else df.repartition(-(-parts["rows"] // ROWS_A_TASK))


def balanced_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Row weight n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()  # classes of a target
    total = sum(r["n"] for r in counts)
    weight = F.lit(1.0)
    for r in counts:
        weight = F.when(F.col(label) == r[label], total / (len(counts) * r["n"])).otherwise(weight)
    return df.withColumn(name, weight)


def prior_baseline(train: DataFrame, label: str = "label") -> DataFrame:
    """Class shares: the same probabilities for every row."""
    return metrics.class_balance(train, label).select("class", "share").orderBy("class")


def mean_baseline(train: DataFrame, label: str = "label") -> DataFrame:
    return train.agg(F.avg(label).alias("prediction"))


def ridge(df: DataFrame, label: str = "label", features: str = "features", alpha: float = 10.0, rows: int | None = None) -> LinearRegression:
    """Least squares with penalty alpha on the squared weights of unscaled inputs."""
    one = df.agg(F.stddev_pop(label).alias("sd"), F.count(F.lit(1)).alias("n")).first()
    return LinearRegression(labelCol=label, featuresCol=features, elasticNetParam=0.0, standardization=False,
                            regParam=alpha * (one["sd"] or 1.0) / one["n"], maxIter=200, tol=1e-9)


def ridge_line(df: DataFrame, x: str, y: str, alpha: float = 10.0) -> DataFrame:
    """The ridge fit with one input in closed form from five aggregates."""
    one = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("vx"))
    slope = F.col("cxy") * F.col("n") / (F.col("vx") * F.col("n") + alpha)
    return one.select("n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def candidates(task: str, classes: int = 2, width: int = 1, rows: int = 1_000_000, seed: int = 42) -> list[tuple[str, str, Estimator | None]]:
    """(name, family, estimator) per candidate; the baseline has no estimator."""
    common = {"labelCol": "label", "featuresCol": "features"}
    if task == "classification":
        weighted = {**common, "weightCol": "weight"}
        boosted = GBTClassifier(**weighted, maxIter=130, maxDepth=5, seed=seed)
        return [
            ("Baseline", "baseline", None),
            ("Logistic regression", "linear", LogisticRegression(**weighted, maxIter=500, regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False)),
            ("Decision tree", "tree", DecisionTreeClassifier(**weighted, maxDepth=8, minInstancesPerNode=4, seed=seed)),
            ("Random forest", "ensemble", RandomForestClassifier(**weighted, numTrees=100, maxDepth=14, minInstancesPerNode=3, seed=seed)),
            ("Neural network", "neural_network", StoppedNetwork([width, 48, 24, classes], seed=seed)),
            ("Gradient boosting", "ensemble", boosted if classes == 2 else OneVsRest(classifier=boosted, **weighted)),
        ]
    if task == "regression":
        return [
            ("Baseline", "baseline", None),
            ("Ridge regression", "linear", LinearRegression(**common, elasticNetParam=0.0, standardization=False)),
            ("Decision tree", "tree", DecisionTreeRegressor(**common, maxDepth=8, minInstancesPerNode=4, seed=seed)),
            ("Random forest", "ensemble", RandomForestRegressor(**common, numTrees=100, maxDepth=14, minInstancesPerNode=3, seed=seed)),
            ("Gradient boosting", "ensemble", GBTRegressor(**common, maxIter=130, maxDepth=5, seed=seed)),
        ]
    return [(f"K-means, {k} groups", "baseline" if k == 2 else "centroid", Centroids(k, seed=seed)) for k in (2, 3, 4, 5)] + [
        (f"Gaussian mixture, {k} groups", "probabilistic", DiagonalMixture(k, seed=seed)) for k in (2, 3, 4)]


class StoppedNetwork:
    """A perceptron that stops when a held-out tenth of its rows has not been told better for ``patience`` rounds.

    Rounds go on from the last weights, ``step`` at a time; the weights with the least held-out log loss
    are kept. Rows are held out by a hash of their features and label.
    """

    def __init__(self, layers: list[int], rounds: int = 120, step: int = 10, patience: int = 10, least: float = 1e-4, seed: int = 42, labelCol: str = "label", featuresCol: str = "features"):
        self.layers, self.rounds, self.step, self.patience, self.least, self.seed, self.label, self.features = layers, rounds, step, patience, least, seed, labelCol, featuresCol
        self.losses: list[float] = []

    def fit(self, df: DataFrame):
        held = F.pmod(F.xxhash64(vector_to_array(F.col(self.features)), self.label, F.lit(self.seed)), F.lit(10)) == 0
        marked = df.withColumn("__held", held).persist()
        inside, outside = marked.filter("NOT __held"), marked.filter("__held")
        chance = F.greatest(F.element_at(vector_to_array("probability"), F.col(self.label).cast("int") + 1), F.lit(1e-15))
        best, weights, since, self.losses = None, None, 0, []
        if outside.isEmpty() or inside.isEmpty():
            inside = marked
        for _ in range(0, self.rounds, self.step):
            network = MultilayerPerceptronClassifier(labelCol=self.label, featuresCol=self.features, layers=self.layers, maxIter=self.step, seed=self.seed)
            model = (network if weights is None else network.setInitialWeights(weights)).fit(inside)
            weights = model.weights
            loss = model.transform(outside).agg(F.avg(-F.log(chance)).alias("loss")).first()["loss"]
            self.losses.append(float("inf") if loss is None else loss)
            if best is None or self.losses[-1] < best[0] - self.least:
                best, since = (self.losses[-1], model), 0
            else:
                since += self.step
            if since >= self.patience and loss is not None:
                break
        marked.unpersist()
        return best[1] if best[0] < float("inf") else model


def allowed(task: str, family: str, rows: int, width: int, rarest: int | None = None) -> bool:
    """Suitability rule of a model family for table size, width and class counts."""
    if family == "baseline":
        return True
    if family == "neural_network" and (rows < 100 or width > 256 or (rarest is not None and rarest < 12)):
        return False
    if family == "ensemble" and width > WIDEST:
        return False
    return not (task == "clustering" and width > 800)


def predictions(model, df: DataFrame, task: str, classes: int = 2) -> DataFrame:
    """label, prediction and, for classes, probability array, score of class 1 and confidence."""
    out = model.transform(df)
    if task == "clustering":
        return out.withColumn("cluster", F.col("prediction").cast("int"))
    if task == "regression":
        return out
    if "probability" not in out.columns:  # one-vs-rest gives raw scores only
        raw = F.transform(vector_to_array("rawPrediction"), lambda v: F.exp(v))
        p = F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, x: a + x))
    else:
        p = vector_to_array("probability")
    return out.withColumn("p", p).withColumn("score", F.get("p", F.lit(1))).withColumn("confidence", F.array_max("p"))


def _baseline(train: DataFrame, df: DataFrame, task: str, classes: int) -> DataFrame:
    if task == "regression":
        return df.withColumn("prediction", F.lit(train.agg(F.avg("label")).first()[0]))
    counts = {int(r["label"]): r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, top = sum(counts.values()), max(counts, key=lambda c: (counts[c], -c))
    p = [counts.get(c, 0) / total for c in range(classes)]
    return (df.withColumn("prediction", F.lit(float(top))).withColumn("p", F.array(*[F.lit(v) for v in p]))
            .withColumn("score", F.get("p", F.lit(1))).withColumn("confidence", F.array_max("p")))


def score_metric(task: str, classes: int) -> str:
    return CLUSTERING if task == "clustering" else REGRESSION if task == "regression" else BINARY if classes == 2 else MULTICLASS


def measure(pred: DataFrame, task: str, classes: int, key=None) -> dict:
    """All metrics of a prediction table as one row on the driver."""
    if task == "regression":
        return metrics.regression_metrics(pred).first().asDict()
    if task == "clustering":
        vec = pred.select(*key, vector_to_array("features").alias("v"), F.col("prediction").cast("int").alias("cluster"))
        near = metrics.silhouette(vec, "v", "cluster", key).first()["silhouette"]
        return {"silhouette": near, **metrics.cluster_metrics(vec, "v", "cluster").first().asDict()}
    pred = pred.select("label", "prediction", *(["score"] if classes == 2 else [])).persist()  # the model runs once a row
    out = metrics.classification_metrics(pred).first().asDict()
    if classes == 2:
        out.update(metrics.ranking_metrics(pred).first().asDict(), **metrics.positive_metrics(pred).first().asDict())
    pred.unpersist()
    return out


def selection_score(pred: DataFrame, task: str, classes: int, key=None) -> float:
    """The metric models are chosen by."""
    if task == "regression":
        row = metrics.regression_metrics(pred).first()
    elif task == "clustering":
        vec = pred.select(*key, vector_to_array("features").alias("v"), F.col("prediction").cast("int").alias("cluster"))
        row = metrics.silhouette(vec, "v", "cluster", key).first()
    else:
        row = (metrics.ranking_metrics(pred) if classes == 2 else metrics.classification_metrics(pred)).first()
    return float(row[score_metric(task, classes)])


def compare_models(df: DataFrame, key, task: str, numeric, categorical, classes: int = 2, k: int = 3, names=None,
                   max_seconds: float | None = None) -> DataFrame:
    """One row per candidate and fold: the selection metric on the held-out fold.

    ``df`` has ``label`` (0-based for classes), ``part`` and ``fold``, and rows of expanding time folds
    (``splits.time_folds``) also ``role``, so that no fold learns from its future. Features are learned inside
    each fold; test rows are never read. The candidates of a fold are fitted side by side. One
    that fails is reported, not raised.
    """
    started, spark = time.monotonic(), df.sparkSession
    by_role = "role" in df.columns
    used = {c.lower() for c in (*key, *numeric, *categorical, "label", "fold", "role")}
    development = even_parts(df.filter(F.col("part") == "train").select(*[F.col(f"`{c}`") for c in df.columns if c.lower() in used])).persist()
    metric = score_metric(task, classes)
    rows = development.filter((F.col("fold") == k - 1) if by_role else F.lit(True)).count()
    rarest = None
    if task == "classification":
        rarest = development.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]

    def one_fold(fold: int) -> list:
        if by_role:
            mine = development.filter(F.col("fold") == fold)
            train, held = mine.filter(F.col("role") == "train"), mine.filter(F.col("role") == "validation")
        else:
            train, held = development.filter(F.col("fold") != fold), development.filter(F.col("fold") == fold)
        if task == "classification":
            train = balanced_weights(train)
        stages = feature_stages(train, numeric, categorical).fit(train)
        # What a fit and its metrics read, without the columns that features are made of.
        kept = ["features", "label", *(key if task == "clustering" else [])]
        ready = stages.transform(train).select(*kept, *(["weight"] if task == "classification" else [])).persist()
        test = stages.transform(held).select(*kept).persist()
        width = ready.select("features").first()["features"].size

        def attempt(index, name, family, estimator):
            if not allowed(task, family, rows, width, rarest):
                return (name, family, fold, metric, None, "skipped", "too many or too few rows or features for this family")
            if max_seconds is not None and index > 1 and time.monotonic() - started >= max_seconds:
                return (name, family, fold, metric, None, "out of time", None)
            try:
                if estimator is None:
                    pred = _baseline(ready, test, task, classes)
                else:
                    fitted = (ridge(ready) if name == "Ridge regression" else estimator).fit(ready)
                    pred = predictions(fitted, test, task, classes)
                return (name, family, fold, metric, selection_score(pred, task, classes, key), "completed", None)
            except Exception as error:  # noqa: BLE001 - one failing candidate must not end the search
                return (name, family, fold, metric, None, "failed", f"{type(error).__name__}: {error}".splitlines()[0])

        jobs = [lambda c=c: attempt(*c) for c in ((i, n, f, e) for i, (n, f, e) in enumerate(candidates(task, classes, width, rows)))
                if names is None or c[1] in names]
        out = run_together(spark, *jobs)
        ready.unpersist()
        test.unpersist()
        return out

    out = [row for fold in range(k) for row in one_fold(fold)]
    development.unpersist()
    return spark.createDataFrame(out, "name string, family string, fold int, metric string, score double, status string, reason string")


def ranking_of(folds: DataFrame) -> DataFrame:
    """Candidates by mean fold score, lower first for rmse, with the stability of the folds."""
    done = folds.filter(F.col("status") == "completed")
    means = metrics.stability(done, ["name", "family", "metric"])
    return means.orderBy(F.when(F.col("metric") == REGRESSION, F.col("mean")).otherwise(-F.col("mean")), "name")


@dataclass
class SearchResult:
    """What a model search leaves: the plan of its folds, all scores, the winner and its judgement on the test part."""

    plan: splits.FoldPlan
    scores: DataFrame
    winner: str
    model: object
    test: DataFrame  # one row per model: the winner and the baseline
    thresholds: DataFrame | None  # of the winner on the validation part, for two classes


def search(parted: DataFrame, key, task: str, numeric, categorical, classes: int = 2, k: int = 3, strategy: str = "random", column: str | None = None,
           names=None, max_seconds: float | None = None) -> SearchResult:
    """Compare the candidates, refit the best one and judge it beside the baseline on the same test rows.

    Candidates are compared on folds of the train part, or on the validation part where folds cannot
    serve (``splits.fold_plan``). The thresholds come from the winner as fitted on the train part.
    """
    plan = splits.fold_plan(parted, key, task, k, strategy, column)
    scores = compare_models(plan.rows, key, task, numeric, categorical, classes, plan.folds, names, max_seconds).persist()
    best = ranking_of(scores).first()
    if best is None:
        raise ValueError("All candidates failed: look at the reasons in the scores.")
    winner = best["name"]
    model, mine = final_model(parted, key, task, numeric, categorical, winner, classes)
    _, base = final_model(parted, key, task, numeric, categorical, "Baseline", classes) if task != "clustering" else (None, None)
    table = None
    if task == "classification" and classes == 2:
        before = parted.filter(F.col("part") != "test").withColumn("part", F.when(F.col("part") == "validation", "test").otherwise("train"))
        _, validated = final_model(before, key, task, numeric, categorical, winner, classes)
        table = metrics.thresholds(validated)
    return SearchResult(plan, scores, winner, model, judged(mine, base, task, classes, key, winner), table)


def judged(mine: DataFrame, base: DataFrame | None, task: str, classes: int, key, winner: str) -> DataFrame:
    """Test metrics of the winner and the baseline, both on the same rows."""
    spark = mine.sparkSession
    if task == "clustering":
        return spark.createDataFrame([{"model": winner, **measure(mine, task, classes, key)}])
    if task == "classification" and classes == 2:
        constant = base.select("score").first()["score"]  # the baseline has one score for all rows
        pred = mine.withColumn("__base", F.lit(constant))
        return metrics.paired_metrics(metrics.score_points(pred, {winner: "score", "Baseline": "__base"}))
    both = mine.select(F.lit(winner).alias("model"), "label", "prediction")
    if winner != "Baseline":
        both = both.unionByName(base.select(F.lit("Baseline").alias("model"), "label", "prediction"))
    parts = [(metrics.regression_metrics if task == "regression" else metrics.classification_metrics)(both.filter(F.col("model") == name)).withColumn("model", F.lit(name))
             for name in dict.fromkeys([winner, "Baseline"])]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def final_model(df: DataFrame, key, task: str, numeric, categorical, winner: str, classes: int = 2):
    """Features and the winner refitted on train + validation, with its test predictions."""
    development = df.filter(F.col("part").isin("train", "validation"))
    if task == "classification":
        development = balanced_weights(development)
    stages = feature_stages(development, numeric, categorical).fit(development)
    ready = stages.transform(development)
    test = stages.transform(df.filter(F.col("part") == "test"))
    width, rows = ready.select("features").first()["features"].size, ready.count()
    estimator = next(e for n, _, e in candidates(task, classes, width, rows) if n == winner)
    if estimator is None:
        return None, _baseline(ready, test, task, classes)
    model = (ridge(ready) if winner == "Ridge regression" else estimator).fit(ready)
    return model, predictions(model, test, task, classes)
