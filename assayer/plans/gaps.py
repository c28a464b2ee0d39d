"""Queries on tables with missing, infinite and undefined cells, made by fixed key rules on both sides."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from assayer.operators import evidence as E
from assayer.operators import inference, metrics, splits, temporal
from assayer.operators import profile as P
from assayer.plans.base import query, r

EVENTS = "(SELECT event_id, user_id, CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM events)"


def _events(t):
    return t.events.withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value")))


@query("prf_19_histogram_gaps", f"""WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM {EVENTS}),
    b AS (SELECT least(CAST(floor((value - lo) / ((hi - lo) / 18)) AS BIGINT) + 1, 18) AS bin, count(*) AS n FROM {EVENTS}, m WHERE value IS NOT NULL GROUP BY 1)
    SELECT s.bin, coalesce(n, 0) AS rows FROM (SELECT unnest(generate_series(1, 18)) AS bin) s LEFT JOIN b ON b.bin = s.bin""")
def _(t):
    return P.histogram(_events(t), ["value"]).select("bin", "rows")


ODD = "CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0 ELSE floor(value + 0.5) END"


@query("prf_03_nonfinite", f"""SELECT count(DISTINCT v) AS "unique", count(v) AS non_null, max(n) AS dominant_count, count(DISTINCT v) <= 1 AS "constant"
    FROM (SELECT v, count(v) OVER (PARTITION BY v) AS n FROM (SELECT {ODD} AS v FROM events))""")
def _(t):
    e = F.col("event_id")
    v = (F.when(e % 7 == 0, F.lit(float("nan"))).when(e % 11 == 0, F.lit(float("-inf"))).when(e % 10 == 0, F.lit(-0.0)).when(e % 5 == 0, F.lit(0.0))
         .otherwise(F.floor(F.col("value") + 0.5).cast("double")))
    return P.frequency_summary(P.frequencies(t.events.select(v.alias("v")), ["v"])).select("unique", "non_null", "dominant_count", "constant")


@query("st_04_undefined", """SELECT count(*) AS n, CAST(NULL AS DOUBLE) AS coefficient, CAST(NULL AS DOUBLE) AS "lower", CAST(NULL AS DOUBLE) AS "upper" FROM orders""")
def _(t):
    return inference.pearson(t.orders.withColumn("flat", F.lit(3.0)), [("flat", "o_totalprice")]).select("n", "coefficient", "lower", "upper")


RANKS = """(WITH x AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS g, c_acctbal + CASE WHEN c_custkey % 2 = 0 THEN 300 ELSE 0 END AS v FROM customer WHERE c_custkey % 13 <> 0),
    k AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY v) AS t FROM x),
    s AS (SELECT sum(k) FILTER (WHERE g = 'a') AS r1, CAST(count(*) FILTER (WHERE g = 'a') AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE g = 'b') AS DOUBLE) AS n2, sum(t * t - 1.0) AS ties FROM k)
    SELECT greatest(0, abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s)"""
# Normal tail: fixed coefficients of the polynomial 26.2.17 of Abramowitz and Stegun, good to 7 digits.
TAIL = """2 * exp(-z * z / 2) / sqrt(2 * pi()) * (u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429)))))"""


@query("st_17_p_value", f"SELECT {r('z', 'z', 5)}, {r(TAIL, 'p_value', 5)} FROM (SELECT z, 1 / (1 + 0.2316419 * z) AS u FROM {RANKS})", 5)
def _(t):
    halves = t.customer.select(F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("g"),
                               F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal") + F.when(F.col("c_custkey") % 2 == 0, 300).otherwise(0)).alias("v"))
    return inference.mann_whitney(inference.rank_rows(halves, [("g", "v")]), with_p=True).select("z", "p_value")


SCORED = "(SELECT CASE WHEN event_id % 17 <> 0 THEN (event_id % 100) / 100 END AS score, CAST(event_id % 3 = 0 AS INTEGER) AS label FROM events)"


@query("evl_13_gaps", f"""SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS rows, {r('avg(label)', 'observed_frequency')} FROM {SCORED} WHERE score IS NOT NULL GROUP BY 1""")
def _(t):
    e = F.col("event_id")
    scored = t.events.select(F.when(e % 17 != 0, (e % 100) / 100).alias("score"), (e % 3 == 0).cast("int").alias("label"))
    return metrics.calibration_bins(scored).select("bin", "rows", "observed_frequency")


@query("ts_04_null_series", "SELECT CASE WHEN event_id % 5 <> 0 THEN event_type END AS k, count(*) AS rows FROM events GROUP BY 1")
def _(t):
    keyed = t.events.withColumn("k", F.when(F.col("event_id") % 5 != 0, F.col("event_type")))
    return temporal.calendar_series(keyed, "ts", "value", ["k"]).groupBy("k").agg(F.sum("rows").alias("rows"))


@query("ml_14_null_group", "SELECT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS g, CAST(1 AS BIGINT) AS folds, count(*) AS rows FROM orders GROUP BY 1")
def _(t):
    grouped = t.orders.withColumn("g", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")))
    return splits.group_folds(grouped, "g", 3).groupBy("g").agg(F.count_distinct("fold").alias("folds"), F.count(F.lit(1)).alias("rows"))


@query("ml_15_invalid_time", """WITH o AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS ts FROM orders),
    d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS c, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM o WHERE ts IS NOT NULL)),
    x AS (SELECT d.c, d.n, d.n // 4 AS b FROM o JOIN d USING (ts)), f AS (SELECT unnest([0, 1, 2]) AS fold)
    SELECT CAST(fold AS BIGINT) AS fold, CASE WHEN c < n - (3 - fold) * b THEN 'train' ELSE 'validation' END AS role, count(*) AS rows FROM x, f WHERE c < n - (2 - fold) * b GROUP BY ALL
    UNION ALL SELECT NULL, 'invalid', count(*) FROM o WHERE ts IS NULL""")
def _(t):
    gone = t.orders.withColumn("ts", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")))
    return splits.time_folds(gone, "ts", 3).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"))


# Fold scores: mean absolute error of a rule and of the plain mean over thirds of the orders.
@query("ev_02_model", f"""WITH f AS (SELECT o_orderkey % 3 AS fold, sqrt(avg((o_totalprice - 1.1 * o_custkey) ^ 2)) AS s FROM orders GROUP BY 1),
    m AS (SELECT avg(o_totalprice) AS v, count(*) AS n FROM orders), b AS (SELECT sqrt(avg((o_totalprice - v) ^ 2)) AS base, sqrt(avg((o_totalprice - 1.1 * o_custkey) ^ 2)) AS score, max(n) AS n FROM orders, m),
    w AS (SELECT CASE WHEN stddev_pop(s) / avg(s) <= 0.1 THEN 'stable' WHEN stddev_pop(s) / avg(s) <= 0.2 THEN 'variable' ELSE 'unstable' END AS steady FROM f)
    SELECT 'Rule' AS title, steady AS stability, score < base AS beats_baseline, {r('score', 'test_score', 3)}, CASE WHEN steady = 'stable' AND n >= 100 AND score < base THEN 'HIGH' WHEN n >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    'model' AS type, 'medium' AS severity FROM b, w""", 3)
def _(t):
    root = lambda c: F.sqrt(F.avg((F.col("o_totalprice") - c) ** 2))
    rule = F.col("o_custkey") * 1.1
    folds = t.orders.groupBy((F.col("o_orderkey") % 3).alias("fold")).agg(root(rule).alias("score")).select(F.lit("Rule").alias("name"), F.lit("rmse").alias("metric"), "score")
    middle = t.orders.agg(F.avg("o_totalprice")).first()[0]
    rows = F.count(F.lit(1)).alias("rows")
    tests = t.orders.agg(root(rule).alias("score"), rows).withColumn("name", F.lit("Rule")).unionByName(t.orders.agg(root(F.lit(middle)).alias("score"), rows).withColumn("name", F.lit("Baseline")))
    table = E.evidence(E.from_model(folds, tests, "Rule"))
    found = E.findings(table).select("evidence_id", "type", "severity", "confidence")
    return table.join(found, F.col("id") == F.col("evidence_id")).select("title", "stability", "beats_baseline", "test_score", "confidence", "type", "severity")


@query("st_27_fields", f"""SELECT 'l_quantity goes together with l_extendedprice.' AS hypothesis, 'Knowing l_quantity says nothing about l_extendedprice.' AS null_hypothesis,
    format('{{}} rows, correlation {{:.4f}}', count(*), corr(l_quantity, l_extendedprice)) AS observation, 'correlation' AS measure FROM lineitem""")
def _(t):
    table = t.lineitem.select("l_quantity", "l_extendedprice")
    tests = inference.test_pairs(table, P.profile(table), ["l_quantity", "l_extendedprice"])
    h = E.hypotheses(E.evidence(E.from_tests(tests)))
    return h.filter(F.col("method") == "Pearson correlation").select("hypothesis", "null_hypothesis", "observation", "measure")


WIDE = """(SELECT 'w' || (event_id % 150) AS wide, 't' || (event_id % 30) AS thirty, 'g' || (event_id % 4) AS four, CASE WHEN event_id <= 2 THEN 'rare' ELSE 'r' || (event_id % 2) END AS rare,
    CASE WHEN event_id % 150 < 15 THEN value END AS sparse, CASE WHEN event_id % 150 < 15 THEN 's' || (event_id % 3) END AS sparse_label, value + 1 AS "full" FROM events)"""
KINDS = {"wide": 1, "thirty": 1, "four": 1, "rare": 1, "sparse": 0, "sparse_label": 1, "full": 0}


def _wide(t):
    e = F.col("event_id")
    named = lambda letter, m: F.concat(F.lit(letter), (e % m).cast("string"))
    few = e % 150 < 15
    return t.events.select(named("w", 150).alias("wide"), named("t", 30).alias("thirty"), named("g", 4).alias("four"), F.when(e <= 2, "rare").otherwise(named("r", 2)).alias("rare"),
                           F.when(few, F.col("value")).alias("sparse"), F.when(few, named("s", 3)).alias("sparse_label"), (F.col("value") + 1).alias("full"))


def _screen_sql(pairs) -> str:
    """Decision about every pair from the labels and groups of its complete rows."""
    parts = []
    for a, b in pairs:
        x, y = (a, b) if KINDS[a] else (b, a)
        smallest = f"(SELECT min(k) FROM (SELECT count(*) AS k FROM {WIDE} WHERE {x} IS NOT NULL AND \"{y}\" IS NOT NULL GROUP BY {x}))" if not KINDS[y] else "9"
        labels = f"greatest(count(DISTINCT {x}), count(DISTINCT {y}))" if KINDS[y] else f"count(DISTINCT {x})"
        parts.append(f"""SELECT '{x}' AS "left", '{y}' AS "right", count(*) AS n, CASE WHEN count(*) < 8 THEN '{inference.SHORT}' WHEN {labels} > 20 THEN '{inference.MANY_LABELS}'
            WHEN {smallest} < 3 THEN '{inference.SMALL_GROUP}' ELSE 'tested' END AS decision FROM {WIDE} WHERE {x} IS NOT NULL AND \"{y}\" IS NOT NULL""")
    return " UNION ALL ".join(parts)


@query("st_21_eligibility", _screen_sql([p for p in itertools.combinations(KINDS, 2) if KINDS[p[0]] or KINDS[p[1]]]))
def _(t):
    """Every pair has a row: tested, or skipped with its reason."""
    table = _wide(t)
    tests = inference.test_pairs(table, P.profile(table), list(KINDS)).filter(~F.col("left").isin("sparse", "full"))
    return tests.select("left", "right", "n", F.when(F.col("status") == "skipped", F.col("method")).otherwise("tested").alias("decision"))
