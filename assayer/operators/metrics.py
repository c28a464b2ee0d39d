"""Evaluation of predictions: exact values from counts and running sums.

A prediction table has ``label`` and ``prediction``; for scores ``label`` is 0 or 1 and
``score`` is the probability of 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import numbers
from assayer.operators import quantiles as q
from assayer.operators import ranking

THRESHOLDS = (0.1, 0.25, 0.5, 0.75, 0.9)


# ---- classes --------------------------------------------------------------------------------

def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Rows and share per class, share of the smallest class, severe below a tenth."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.agg(F.sum("rows").alias("total"), F.min("rows").alias("least")).withColumn("__all", F.lit(0))
    return (counts.withColumn("__all", F.lit(0)).join(F.broadcast(totals), "__all")  # a single row
            .select("class", "rows", (F.col("rows") / F.col("total")).alias("share"),
                    (F.col("least") / F.col("total")).alias("minority_share"), (F.col("least") / F.col("total") < 0.1).alias("severe")))


def confusion(pred: DataFrame) -> DataFrame:
    """Counts of every (label, prediction), zero where a combination does not occur.

    The class list is an array of the labels in use, so no rows are crossed.
    """
    cells = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("rows"))
    names = cells.select(F.explode(F.array("label", "prediction")).alias("c")).agg(F.array_sort(F.collect_set("c")).alias("c"))
    spine = names.select("c", F.explode("c").alias("label")).select("label", F.explode("c").alias("prediction"))
    return spine.join(cells, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("rows", F.lit(0)).alias("rows"))


def class_report(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; zero where a ratio has no base."""
    cells = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("rows"))
    sides = F.array(F.struct(F.col("label").alias("class"), F.col("rows").alias("actual"), F.lit(0).cast("long").alias("predicted"),
                             F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0).cast("long").alias("hits")),
                    F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("rows").alias("predicted"),
                             F.lit(0).cast("long").alias("hits")))
    sums = cells.select(F.inline(sides)).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hits")])
    precision = F.coalesce(numbers.safe_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(numbers.safe_divide("hits", "actual"), F.lit(0.0))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"),
                       F.coalesce(numbers.safe_divide(2 * F.col("hits"), F.col("actual") + F.col("predicted")), F.lit(0.0)).alias("f1"),
                       F.col("actual").alias("support"), "hits")


def classification_metrics(pred: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, support-weighted precision, recall and F1, macro F1."""
    n, s = F.sum("support"), F.col("support")
    return class_report(pred).agg(
        (F.sum("hits") / n).alias("accuracy"), F.avg(F.when(s > 0, F.col("recall"))).alias("balanced_accuracy"),
        (F.sum(s * F.col("precision")) / n).alias("precision"), (F.sum(s * F.col("recall")) / n).alias("recall"),
        (F.sum(s * F.col("f1")) / n).alias("f1"), F.avg("f1").alias("f1_macro"))


def positive_metrics(pred: DataFrame, positive=1) -> DataFrame:
    """Precision and recall of the positive class."""
    hit = (F.col("label") == positive) & (F.col("prediction") == positive)
    return pred.agg(
        F.coalesce(numbers.safe_divide(F.count_if(hit), F.count_if(F.col("prediction") == positive)), F.lit(0.0)).alias("positive_precision"),
        F.coalesce(numbers.safe_divide(F.count_if(hit), F.count_if(F.col("label") == positive)), F.lit(0.0)).alias("positive_recall"))


# ---- scores ---------------------------------------------------------------------------------

def threshold_counts(pred: DataFrame, rows: int | None = None, buckets: int | None = None) -> DataFrame:
    """Distinct scores with true and false positives when everything from the score up is called positive."""
    rows = pred.count() if rows is None else rows
    counts = pred.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    return (ranking.running_totals(counts, "score", ["pos", "neg"], rows=rows, buckets=buckets, descending=True)
            .withColumnsRenamed({"upto_pos": "tp", "upto_neg": "fp"}))


def _with_totals(points: DataFrame) -> DataFrame:
    totals = F.broadcast(points.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.count(F.lit(1)).alias("distinct")).withColumn("__all", F.lit(0)))
    return points.withColumn("__all", F.lit(0)).join(totals, "__all").drop("__all")  # a single row


def ranking_metrics(pred: DataFrame, rows: int | None = None, buckets: int | None = None) -> DataFrame:
    """ROC-AUC with ties averaged, and average precision as the step sum."""
    points = _with_totals(threshold_counts(pred, rows, buckets))
    # Pairs won at a score: its positives against the negatives below, half of those level with it.
    won = F.col("pos").cast("double") * (F.col("n") - F.col("fp") + 0.5 * F.col("neg"))
    step = F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return points.agg((F.sum(won) / (F.first("p").cast("double") * F.first("n"))).alias("roc_auc"), F.sum(step).alias("average_precision"))


def _thin(points: DataFrame, at: str, last, most: int) -> DataFrame:
    """Evenly spaced points, first and last included, when there are more than ``most``."""
    step = F.greatest(last / F.lit(most - 1), F.lit(1.0))
    j = F.ceil(F.col(at) / step)
    return points.filter((last < most) | (F.floor(j * step) == F.col(at)))


def roc_points(pred: DataFrame, most: int = 100, rows: int | None = None) -> DataFrame:
    """False and true positive rate over the distinct scores, thinned to ``most`` points."""
    rows = pred.count() if rows is None else rows
    points = _with_totals(threshold_counts(pred, rows)).withColumn("one", F.lit(1))
    placed = ranking.running_totals(points, "score", ["one"], rows=rows, descending=True).withColumn("place", F.col("upto_one"))
    return _thin(placed, "place", F.col("distinct"), most).select(
        "place", "score", (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))


def pr_points(pred: DataFrame, most: int = 100, rows: int | None = None) -> DataFrame:
    """Recall and precision over the distinct scores, thinned to ``most`` points."""
    rows = pred.count() if rows is None else rows
    points = _with_totals(threshold_counts(pred, rows)).withColumn("one", F.lit(1))
    placed = ranking.running_totals(points, "score", ["one"], rows=rows, descending=True).withColumn("place", F.col("upto_one"))
    return _thin(placed, "place", F.col("distinct"), most).select(
        "place", "score", (F.col("tp") / F.col("p")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def calibration_bins(pred: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score, observed share and rows per equal-width bin, the last one closed; rows without score or label do not count."""
    pred = pred.filter(F.col("score").isNotNull() & F.col("label").isNotNull())
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return pred.groupBy(place.alias("bin")).agg(
        F.avg("score").alias("predicted_probability"), F.avg(F.col("label").cast("double")).alias("observed_frequency"), F.count(F.lit(1)).alias("rows"))


def calibration(pred: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score, expected calibration error and its grade, from one pass over the rows that have score and label."""
    pred = pred.filter(F.col("score").isNotNull() & F.col("label").isNotNull())
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    error = F.col("score") - F.col("label")
    per_bin = pred.groupBy(place.alias("bin")).agg(
        F.sum("score").alias("s"), F.sum(F.col("label").cast("double")).alias("y"), F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("e"))
    one = per_bin.agg((F.sum("e") / F.sum("n")).alias("brier_score"), (F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("calibration_error"))
    c = F.col("calibration_error")
    return one.withColumn("status", F.when(c < 0.05, "good").when(c < 0.1, "moderate").otherwise("poor"))


def multiclass_brier(pred: DataFrame) -> DataFrame:
    """Mean sum of squares between the ``probability`` array and the 0-based ``label``."""
    squares = F.aggregate(F.transform("probability", lambda p, i: (p - F.when(i == F.col("label"), 1.0).otherwise(0.0)) ** 2), F.lit(0.0), lambda a, v: a + v)
    return pred.agg(F.avg(squares).alias("brier_score"))


def thresholds(pred: DataFrame, values=THRESHOLDS) -> DataFrame:
    """Precision, recall, F1 and balanced accuracy at fixed thresholds, all from one scan."""
    counts = []
    for i, t in enumerate(values):
        called, positive = F.col("score") >= t, F.col("label") == 1
        counts += [F.count_if(called & positive).alias(f"tp{i}"), F.count_if(called & ~positive).alias(f"fp{i}")]
    wide = pred.agg(*counts, F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(values)])
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    zero = F.lit(0.0)
    return wide.select("p", "n", F.inline(rows)).select(
        "threshold", F.coalesce(numbers.safe_divide(tp, tp + fp), zero).alias("precision"), F.coalesce(numbers.safe_divide(tp, p), zero).alias("recall"),
        F.coalesce(numbers.safe_divide(2 * tp, tp + fp + p), zero).alias("f1"),
        ((F.coalesce(numbers.safe_divide(tp, p), zero) + F.coalesce(numbers.safe_divide(n - fp, n), zero)) / 2).alias("balanced_accuracy"))


# ---- several models on the same rows ----------------------------------------------------------

def score_points(pred: DataFrame, scores: dict, rows: int | None = None) -> DataFrame:
    """(model, score, pos, neg, tp, fp): the distinct scores of every model with the positives from the score up.

    ``scores`` names a score column per model. A row is read once and scored by all models.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("model"), F.col(column).cast("double").alias("score")) for name, column in scores.items()])
    long = pred.filter(F.col("label").isNotNull()).select("label", F.inline(cells)).filter(F.col("score").isNotNull())
    counts = long.groupBy("model", "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    rows = pred.count() * len(scores) if rows is None else rows
    return ranking.running_totals(counts, "score", ["pos", "neg"], ["model"], rows, descending=True).withColumnsRenamed({"upto_pos": "tp", "upto_neg": "fp"})


def paired_metrics(points: DataFrame, cut: float = 0.5, bins: int = 10, thresholds=THRESHOLDS) -> DataFrame:
    """One row per model of ``score_points``: ranking, decisions at ``cut``, Brier score, calibration and thresholds.

    Everything follows from the counts per distinct score; the table of thresholds is an array.
    """
    at = [cut, *map(float, thresholds)]
    totals = points.groupBy("model").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    s = F.col("score")
    called = [e for k, t in enumerate(at) for e in (F.sum(F.when(s >= t, F.col("pos")).otherwise(0)).alias(f"tp{k}"), F.sum(F.when(s >= t, F.col("neg")).otherwise(0)).alias(f"fp{k}"))]
    won = F.col("pos").cast("double") * (F.col("n") - F.col("fp") + 0.5 * F.col("neg"))
    step = F.try_divide(F.col("pos"), F.col("p")) * F.col("tp") / (F.col("tp") + F.col("fp"))
    both = points.join(totals, "model")  # a row per model on the right
    bin_sums = both.groupBy("model", F.least(F.floor(s * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.first("p").alias("p"), F.first("n").alias("n"), F.sum(won).alias("won"), F.sum(step).alias("ap"), *called,
        F.sum(F.col("pos") * (s - 1) ** 2 + F.col("neg") * s ** 2).alias("squares"), F.abs(F.sum((F.col("pos") + F.col("neg")) * s) - F.sum("pos")).alias("off"))
    one = bin_sums.groupBy("model").agg(F.first("p").alias("p"), F.first("n").alias("n"), F.sum("won").alias("won"), F.sum("ap").alias("average_precision"), F.sum("squares").alias("squares"), F.sum("off").alias("off"),
                                        *[F.sum(f"{c}{k}").alias(f"{c}{k}") for k in range(len(at)) for c in ("tp", "fp")])

    def decision(k: int) -> dict:
        tp, fp, p, n = F.col(f"tp{k}"), F.col(f"fp{k}"), F.col("p"), F.col("n")
        ratio = lambda a, b: F.coalesce(numbers.safe_divide(a, b), F.lit(0.0))
        return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, p), "f1": ratio(2 * tp, tp + fp + p), "balanced_accuracy": (ratio(tp, p) + ratio(n - fp, n)) / 2,
                "accuracy": ratio(tp + n - fp, p + n)}

    table = F.array(*[F.struct(F.lit(t).alias("threshold"), *[e.alias(c) for c, e in decision(k + 1).items() if c != "accuracy"]) for k, t in enumerate(at[1:])])
    rows = (F.col("p") + F.col("n")).cast("double")
    return one.select("model", (F.col("p") + F.col("n")).alias("rows"), F.try_divide(F.col("won"), F.col("p").cast("double") * F.col("n")).alias("roc_auc"), "average_precision",
                      *[e.alias(c) for c, e in decision(0).items()], (F.col("squares") / rows).alias("brier_score"), (F.col("off") / rows).alias("calibration_error"), table.alias("thresholds"))


# ---- numbers --------------------------------------------------------------------------------

def regression_metrics(pred: DataFrame) -> DataFrame:
    """MAE, RMSE and R squared."""
    e = F.col("label") - F.col("prediction")
    return pred.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                    (1 - F.try_divide(F.sum(e * e), F.var_pop("label") * F.count("label"))).alias("r2"))


def residuals(pred: DataFrame, key, n: int | None = 300) -> DataFrame:
    """Actual, predicted and residual of the first n rows in key order."""
    out = pred.select(*key, F.col("label").alias("actual"), F.col("prediction").alias("predicted"), (F.col("label") - F.col("prediction")).alias("residual"))
    return out if n is None else out.orderBy(*key).limit(n)


def regression_errors(pred: DataFrame, rows: int | None = None) -> DataFrame:
    """Mean residual and 95th percentile of the absolute error."""
    r = pred.select((F.col("label") - F.col("prediction")).alias("r")).withColumn("a", F.abs("r"))
    high = q.quantiles(r, ["a"], [0.95], rows=rows).select(F.get("a", F.lit(0)).alias("p95_absolute_error"), F.lit(0).alias("__all"))
    return r.agg(F.avg("r").alias("mean_residual")).withColumn("__all", F.lit(0)).join(F.broadcast(high), "__all").drop("__all")  # a single row


def worst_errors(pred: DataFrame, key, n: int = 12) -> DataFrame:
    """The n largest absolute residuals."""
    error = F.abs(F.col("label") - F.col("prediction"))
    return pred.withColumn("error", error).orderBy(F.desc("error"), *key).limit(n)


def confident_mistakes(pred: DataFrame, key, n: int = 12) -> DataFrame:
    """The n wrong predictions with the highest ``confidence``."""
    return pred.filter(F.col("label") != F.col("prediction")).orderBy(F.desc("confidence"), *key).limit(n)


def stability(folds: DataFrame, by=()) -> DataFrame:
    """Mean and population deviation of fold scores with the verdict on their ratio."""
    s = folds.groupBy(*by).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    ratio = F.abs("std") / F.greatest(F.abs("mean"), F.lit(1e-9))
    return s.withColumn("relative_std", ratio).withColumn(
        "status", F.when(ratio <= 0.1, "stable").when(ratio <= 0.2, "variable").otherwise("unstable"))


def beats_baseline(metric, score, baseline):
    """Lower is better for rmse, higher for every other metric."""
    return F.when(F.col(metric) == "rmse", F.col(score) < F.col(baseline)).otherwise(F.col(score) > F.col(baseline))


# ---- clusters -------------------------------------------------------------------------------

def cluster_profile(df: DataFrame, cluster: str, numeric=(), categorical=()) -> DataFrame:
    """Rows, share, means and most frequent labels per cluster (the smallest label wins a tie)."""
    rows = df.count()
    out = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("rows"), *[F.round(F.avg(c), 3).alias(f"mean_{c}") for c in numeric])
    for c in categorical:
        counts = df.filter(F.col(c).isNotNull()).groupBy(cluster, F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        out = out.join(counts.groupBy(cluster).agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(f"mode_{c}")), cluster, "left")
    return out.withColumn("share", F.col("rows") / F.lit(rows))


def _dimensions(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    return df.select(cluster, F.posexplode(F.col(vector)).alias("dim", "x"))


def centroids(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Centre and rows per cluster. Sums per (cluster, dimension) are taken where the rows are."""
    means = _dimensions(df, vector, cluster).groupBy(cluster, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centre"),
                                      F.max("n").alias("rows"))  # one entry per dimension


def squared_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda acc, v: acc + v)


def cluster_metrics(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Davies-Bouldin, Calinski-Harabasz and cluster count."""
    centre = centroids(df, vector, cluster)
    # One row per cluster, and the rows stay where they are: a shuffle would leave them to as many tasks as there are clusters.
    away = df.join(F.broadcast(centre), cluster).select(cluster, squared_distance(F.col(vector), F.col("centre")).alias("d2"))
    within = away.groupBy(cluster).agg(F.avg(F.sqrt("d2")).alias("scatter"), F.sum("d2").alias("ss"))
    facts = centre.join(within, cluster)
    listed = facts.agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "centre", "rows", "scatter", "ss")).alias("k"))  # clusters
    pairs = F.transform("k", lambda a: F.array_max(F.transform(F.filter("k", lambda b: b["c"] != a["c"]), lambda b: F.try_divide(
        a["scatter"] + b["scatter"], F.sqrt(squared_distance(a["centre"], b["centre"]))))))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)
    n = F.aggregate("k", F.lit(0).cast("long"), lambda acc, c: acc + c["rows"])
    k = F.size("k")
    grand = F.aggregate("k", F.transform(F.get("k", F.lit(0))["centre"], lambda x: F.lit(0.0)), lambda acc, c: F.zip_with(
        acc, c["centre"], lambda x, y: x + y * c["rows"] / n))
    between = total(F.transform("k", lambda c: c["rows"] * squared_distance(c["centre"], grand)))
    return listed.select(
        (total(pairs) / k).alias("davies_bouldin"),
        F.try_divide(between / (k - 1), total(F.transform("k", lambda c: c["ss"])) / (n - k)).alias("calinski_harabasz"),
        k.cast("long").alias("clusters"))


def silhouette(df: DataFrame, vector: str, cluster: str, key, sample: int = 600) -> DataFrame:
    """Mean Euclidean silhouette over a deterministic sample: pairwise distances, so the sample
    size is part of the measure. The sampled vectors travel as one array to every sampled row."""
    from assayer.operators.sampling import stable_sample
    few = stable_sample(df.select(*key, vector, cluster), key, sample).select(F.struct(*key).alias("k"), F.col(vector).alias("v"), F.col(cluster).alias("c"))
    one = few.agg(F.collect_list(F.struct("k", "v", "c")).alias("all"))  # one row with ``sample`` entries
    spread = few.select(F.struct("k", "v", "c").alias("me"), F.lit(0).alias("__all")).join(
        F.broadcast(one.withColumn("__all", F.lit(0))), "__all")
    # Mean distance to every cluster, the row itself left out.
    names = F.array_distinct(F.transform("all", lambda o: o["c"]))

    def mean_to(c):
        others = F.filter("all", lambda o: (o["c"] == c) & (o["k"] != F.col("me.k")))
        return F.struct(c.alias("c"), (F.aggregate(others, F.lit(0.0), lambda acc, o: acc + F.sqrt(squared_distance(F.col("me.v"), o["v"])))
                                       / F.greatest(F.size(others), F.lit(1))).alias("d"), F.size(others).alias("n"))
    far = spread.select("me.c", F.transform(names, mean_to).alias("m"))
    a = F.get(F.filter("m", lambda s: s["c"] == F.col("c")), F.lit(0))
    b = F.array_min(F.transform(F.filter("m", lambda s: s["c"] != F.col("c")), lambda s: s["d"]))
    s = F.when(a["n"] == 0, 0.0).otherwise(F.coalesce(F.try_divide(b - a["d"], F.greatest(a["d"], b)), F.lit(0.0)))
    return far.select(s.alias("s")).agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("rows"))


def ambiguity(df: DataFrame, distances: str, key, n: int | None = 12) -> DataFrame:
    """1 / (1 + second - first) of the distances to the centres; the n least certain rows."""
    near = F.array_sort(F.col(distances))
    out = df.withColumn("ambiguity", 1 / (1 + F.get(near, F.lit(1)) - F.get(near, F.lit(0))))
    return out if n is None else out.orderBy(F.desc("ambiguity"), *key).limit(n)


def membership_ambiguity(df: DataFrame, memberships: str, key, n: int | None = 12) -> DataFrame:
    """1 - largest membership of a mixture; the n least certain rows."""
    out = df.withColumn("ambiguity", 1 - F.array_max(memberships))
    return out if n is None else out.orderBy(F.desc("ambiguity"), *key).limit(n)


def distances_to(df: DataFrame, vector: str, centres: DataFrame, most: int = 200) -> DataFrame:
    """Euclidean distance of each row to every centre, in centre order."""
    listed = [tuple(r["centre"]) for r in centres.limit(most + 1).collect()]
    if len(listed) > most:
        raise ValueError(f"At most {most} centres.")
    return df.withColumn("distances", F.array(*[F.sqrt(squared_distance(F.col(vector), F.array(*[F.lit(x) for x in c]))) for c in listed]))
