"""Queries over the column profile."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F



from assayer.operators import profile as P
from assayer.plans.base import LABELLED, query, r, stamp, union_all

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KINDS = {**{c: "numeric" for c in LINE_NUMBERS}, "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "datetime"}
LABEL_COLUMNS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


def each(columns, body) -> str:
    return union_all(body(c) for c in columns)


@query("prf_00_numeric_profile", each(LINE_NUMBERS, lambda c: f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "unique",
    {r(f'avg({c})', 'mean', 4)}, {r(f'stddev_samp({c})', 'std', 4)}, {r(f'min({c})', 'min', 4)}, {r(f'max({c})', 'max', 4)}, {r(f'quantile_cont({c}, 0.25)', 'q25', 4)},
    {r(f'quantile_cont({c}, 0.5)', 'q50', 4)}, {r(f'quantile_cont({c}, 0.75)', 'q75', 4)} FROM lineitem"""), 4)
def _(t):
    li = t.lineitem
    one = P.counts(li).join(P.moments(li, LINE_NUMBERS), "column").join(P.quantile_table(li, LINE_NUMBERS, [0.25, 0.5, 0.75]), "column")
    freq = P.frequency_summary(P.frequencies(li, LINE_NUMBERS)).select("column", "unique")
    return one.join(freq, "column").select("column", "missing", "unique", "mean", "std", "min", "max", "q25", "q50", "q75")


@query("prf_01_kinds", union_all(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count({c}) AS non_null FROM lineitem" for c, k in LINE_KINDS.items()))
def _(t):
    kinds = P.column_kinds(t.lineitem)
    pick = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])
    return P.counts(t.lineitem).select("column", pick[F.col("column")].alias("kind"), "non_null")


@query("prf_02_missing", each(LABEL_COLUMNS, lambda c: f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, {r(f'(count(*) - count({c})) / count(*) * 100', 'missing_pct', 2)} FROM {LABELLED}"""), 2)
def _(t):
    return P.counts(t.labelled()).select("column", "missing", "missing_pct")


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("prf_03_distinct", each(ORDER_COLUMNS, lambda c: f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique", {r(f'count(DISTINCT {c}) / count(*)', 'cardinality_ratio')},
    count(DISTINCT {c}) > 100 AS high_cardinality FROM orders"""))
def _(t):
    found = P.frequency_summary(P.frequencies(t.orders, t.orders.columns)).join(P.counts(t.orders).select("column", "rows"), "column")
    return found.select("column", "unique", (F.col("unique") / F.col("rows")).alias("cardinality_ratio"), (F.col("unique") > 100).alias("high_cardinality"))


NARROW = "(SELECT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)"


def _narrow(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")


@query("prf_04_duplicates", f"""SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {NARROW})) AS distinct_rows,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {NARROW})) AS duplicates,
    {r(f'(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {NARROW}))) / count(*) * 100', 'duplicate_pct')} FROM {NARROW}""")
def _(t):
    return P.duplicates(_narrow(t))


@query("prf_05_usable", each(["lang", "source", "quality", "toxic"], lambda c: f"""SELECT '{c}' AS "column", count({c}) AS usable_non_missing_rows FROM (SELECT DISTINCT lang, source, quality, toxic FROM {LABELLED})"""))
def _(t):
    return P.usable_counts(t.labelled().select("lang", "source", "quality", "toxic"))


@query("prf_06_examples", each(["p_name", "p_brand", "p_type"], lambda c: f"""SELECT '{c}' AS "column", string_agg({c}, '; ' ORDER BY p_partkey) AS examples FROM (SELECT p_partkey, substr({c}, 1, 100) AS {c} FROM part WHERE {c} IS NOT NULL ORDER BY p_partkey LIMIT 3)"""))
def _(t):
    return P.profile(t.part, ["p_partkey"]).filter(F.col("column").isin("p_name", "p_brand", "p_type")).select("column", F.array_join("examples", "; ").alias("examples"))


@query("prf_07_constant", each(["event_type", "user_id"], lambda c: f"""SELECT '{c}' AS "column", count(*) <= 1 AS "constant", max(n) / sum(n) >= 0.95 AS near_constant, {r('max(n) / sum(n)', 'dominant_share')}
    FROM (SELECT {c}, count(*) AS n FROM events GROUP BY 1)"""))
def _(t):
    return P.frequency_summary(P.frequencies(t.events, ["event_type", "user_id"])).select("column", "constant", "near_constant", "dominant_share")


@query("prf_08_identifiers", union_all(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) / count(*) > {limit} AND {rule} AS possible_id FROM customer" for c, limit, rule in (
    ("c_custkey", 0.8, "false"), ("c_name", 0.98, "avg(length(c_name)) < 40"), ("c_nationkey", 0.8, "false"), ("c_acctbal", 0.8, "false"), ("c_mktsegment", 0.98, "true"))))
def _(t):
    return P.profile(t.customer, ["c_custkey"]).select("column", "possible_id")


@query("prf_09_free_text", """SELECT 'text' AS "column", median(length(text)) > 60 AS possible_free_text FROM documents UNION ALL SELECT 'lang', median(length(lang)) > 60 FROM documents
    UNION ALL SELECT 'source', median(length(source)) > 60 FROM documents""")
def _(t):
    return P.profile(t.documents, ["doc_id"]).filter(F.col("kind") == "categorical").select("column", "possible_free_text")


@query("prf_10_class_counts", "SELECT o_orderpriority AS value, count(*) AS n, min(count(*)) OVER () AS minimum_class_count FROM orders GROUP BY 1")
def _(t):
    return P.class_counts(P.frequencies(t.orders, ["o_orderpriority", "o_custkey"])).select("minimum_class_count", F.explode("category_counts").alias("value", "n"))


@query("prf_10_usable_classes", "SELECT l_returnflag AS value, count(*) AS n FROM (SELECT DISTINCT * FROM " + NARROW + ") GROUP BY 1")
def _(t):
    return P.usable_frequencies(_narrow(t), ["l_returnflag"]).filter(F.col("column") == "l_returnflag").select("value", "n")


def _spoiled(t):
    """Events with infinities in a fixed third of a percent of the rows."""
    return t.events.withColumn("value", F.when(F.col("event_id") % 97 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))


@query("prf_11_infinite", "SELECT count(*) FILTER (WHERE event_id % 97 = 0) AS infinite_values FROM events")
def _(t):
    return P.counts(_spoiled(t)).filter(F.col("column") == "value").select("infinite_values")


@query("prf_12_mixed_text", f"""SELECT {r('avg(CAST(TRY_CAST(v AS DOUBLE) IS NOT NULL AS INTEGER))', 'numeric_share')}, avg(CAST(TRY_CAST(v AS DOUBLE) IS NOT NULL AS INTEGER)) BETWEEN 0.2 AND 0.949999 AS mixed_numeric_text
    FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE substr(c_name, 10) END AS v FROM customer)""")
def _(t):
    odd = t.customer.select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.expr("substring(c_name, 10)")).alias("v"))
    return P.text_shape(odd, ["v"]).select("numeric_share", "mixed_numeric_text")


@query("prf_13_moments", each(LINE_NUMBERS, lambda c: f"""SELECT '{c}' AS "column", {r(f'avg({c})', 'mean', 4)}, {r(f'stddev_samp({c})', 'std', 4)}, {r(f'var_samp({c}) / (avg({c}) * avg({c}))', 'relative_variance', 4)} FROM lineitem"""), 4)
def _(t):
    m = P.moments(t.lineitem, LINE_NUMBERS)
    return m.select("column", "mean", "std", (F.col("variance") / (F.col("mean") * F.col("mean"))).alias("relative_variance"))


@query("prf_14_shape", each(LINE_NUMBERS, lambda c: f"""SELECT '{c}' AS "column", {r(f'skewness({c})', 'skewness')}, {r(f'kurtosis({c})', 'kurtosis')} FROM lineitem"""))
def _(t):
    return P.moments(t.lineitem, LINE_NUMBERS).select("column", "skewness", "kurtosis")


@query("prf_15_signs", f"""SELECT 'c_acctbal' AS "column", {r('avg(CAST(c_acctbal = 0 AS INTEGER)) * 100', 'zero_pct')}, {r('avg(CAST(c_acctbal < 0 AS INTEGER)) * 100', 'negative_pct')}, {r('min(c_acctbal)', 'min')}, {r('max(c_acctbal)', 'max')} FROM customer""")
def _(t):
    return P.moments(t.customer, ["c_acctbal"]).select("column", "zero_pct", "negative_pct", "min", "max")


@query("prf_16_quantiles", each(LINE_NUMBERS, lambda c: f"""SELECT '{c}' AS "column", {', '.join(r(f'quantile_cont({c}, {s})', n, 4) for s, n in ((0.01, 'q1'), (0.25, 'q25'), (0.5, 'q50'), (0.75, 'q75'), (0.99, 'q99')))} FROM lineitem"""), 4)
def _(t):
    return P.quantile_table(t.lineitem, LINE_NUMBERS)


@query("prf_16_bracketed", each(["l_quantity", "l_extendedprice"], lambda c: f"""SELECT '{c}' AS "column", {', '.join(r(f'quantile_cont({c}, {s})', n, 4) for s, n in ((0.01, 'q1'), (0.25, 'q25'), (0.5, 'q50'), (0.75, 'q75'), (0.99, 'q99')))} FROM lineitem"""), 4)
def _(t):
    from assayer.operators import quantiles as q
    # A small buffer: the brackets are narrowed as they are on large tables.
    wide = q.quantiles(t.lineitem, ["l_quantity", "l_extendedprice"], P.QUANTILES, held=500)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.get(c, F.lit(k)).alias(f"q{round(s * 100)}") for k, s in enumerate(P.QUANTILES)]) for c in ("l_quantity", "l_extendedprice")])))


@query("prf_16_by_group", f"""SELECT l_returnflag, l_linestatus, {', '.join(r(f'quantile_cont({c}, {s})', f'{c}_{n}', 4) for c in ('l_quantity', 'l_extendedprice') for s, n in ((0.01, 'q1'), (0.5, 'q50'), (0.99, 'q99')))} FROM lineitem GROUP BY ALL""", 4)
def _(t):
    """Exact quantiles of groups that are larger than a buffer."""
    from assayer.operators import quantiles as q
    found = q.quantiles(t.lineitem, ["l_quantity", "l_extendedprice"], [0.01, 0.5, 0.99], ["l_returnflag", "l_linestatus"], held=500)
    return found.select("l_returnflag", "l_linestatus", *[F.get(c, F.lit(k)).alias(f"{c}_{n}") for c in ("l_quantity", "l_extendedprice") for k, n in enumerate(("q1", "q50", "q99"))])


BOUNDS = """(SELECT quantile_cont(o_totalprice, 0.25) - 1.5 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) AS lo,
    quantile_cont(o_totalprice, 0.75) + 1.5 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) AS hi FROM orders)"""


@query("prf_17_outliers", f"""SELECT {r('any_value(lo)', 'lower', 4)}, {r('any_value(hi)', 'upper', 4)}, count(*) FILTER (WHERE o_totalprice < lo OR o_totalprice > hi) AS outliers,
    {r('count(*) FILTER (WHERE o_totalprice < lo OR o_totalprice > hi) / count(*) * 100', 'outlier_pct', 2)} FROM orders, {BOUNDS}""", 4)
def _(t):
    return P.outliers(t.orders, ["o_totalprice"]).filter(F.col("column") != "*").select("lower", "upper", "outliers", "outlier_pct")


@query("prf_18_outlier_rows", f"""WITH b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM events)
    SELECT event_id, 'value' AS cells FROM events, b WHERE value < a - 1.5 * (c - a) OR value > c + 1.5 * (c - a)""")
def _(t):
    return P.outlier_rows(t.events, ["value", "user_id"]).select("event_id", F.array_join("outlying", ",").alias("cells"))


@query("prf_19_histogram", f"""WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    b AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 18)) AS BIGINT) + 1, 18) AS bin, count(*) AS n FROM lineitem, m GROUP BY 1)
    SELECT s.bin, {r('lo + (s.bin - 1) * (hi - lo) / 18', 'lower', 4)}, {r('lo + s.bin * (hi - lo) / 18', 'upper', 4)}, coalesce(n, 0) AS rows
    FROM (SELECT unnest(generate_series(1, 18)) AS bin) s CROSS JOIN m LEFT JOIN b ON b.bin = s.bin""", 4)
def _(t):
    return P.histogram(t.lineitem, ["l_extendedprice"]).select("bin", "lower", "upper", "rows")


@query("prf_20_date_share", f"""SELECT 'o_orderdate' AS "column", {r('CAST(1 AS DOUBLE)', 'looks')}, {r('CAST(1 AS DOUBLE)', 'parses')}, count(*) AS rows FROM orders
    UNION ALL SELECT 'o_orderpriority', {r('CAST(0 AS DOUBLE)', 'looks')}, {r('CAST(0 AS DOUBLE)', 'parses')}, count(*) FROM orders""")
def _(t):
    o = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    found = P.date_evidence(o, ["o_orderdate", "o_orderpriority"], ["o_orderkey"])
    shares = {k: F.create_map(*[v for c, e in found.items() for v in (F.lit(c), F.lit(e[i]))]) for i, k in enumerate(("looks", "parses"))}
    return P.counts(o.drop("o_orderkey")).select("column", *[m[F.col("column")].alias(k) for k, m in shares.items()], "rows")


@query("prf_21_top_values", "SELECT row_number() OVER (ORDER BY n DESC, v) AS place, substr(v, 1, 50) AS label, n AS rows FROM (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, v LIMIT 10")
def _(t):
    return P.top_values(t.part, ["p_brand"]).select("place", "label", "rows")


@query("prf_21_top_with_missing", f"SELECT row_number() OVER (ORDER BY n DESC, v) AS place, v AS label, n AS rows FROM (SELECT coalesce(CAST(quality AS VARCHAR), '(missing)') AS v, count(*) AS n FROM {LABELLED} GROUP BY 1) ORDER BY n DESC, v LIMIT 10")
def _(t):
    return P.top_values(t.labelled(), ["quality"]).select("place", "label", "rows")


@query("prf_22_entropy", each(["event_type", "user_id"], lambda c: f"""SELECT '{c}' AS "column", {r(f'entropy({c})', 'entropy')} FROM events"""))
def _(t):
    return P.frequency_summary(P.frequencies(t.events, ["event_type", "user_id"])).select("column", "entropy")


@query("prf_23_dominant", f"""WITH c AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1), s AS (SELECT sum(n) AS total FROM c)
    SELECT arg_min(v, (-n, v)) AS dominant_category, {r('max(n) / any_value(total)', 'dominant_share')}, {r('coalesce(sum(n) FILTER (WHERE n / total < 0.01), 0) / any_value(total) * 100', 'rare_category_pct')} FROM c, s""")
def _(t):
    return P.frequency_summary(P.frequencies(t.part, ["p_name"])).select("dominant_category", "dominant_share", "rare_category_pct")


@query("prf_24_dates", f"""SELECT {stamp('min(o_orderdate)', 'min_ts')}, {stamp('max(o_orderdate)', 'max_ts')}, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS invalid_dates,
    count(*) FILTER (WHERE o_orderkey % 50 <> 0) - count(DISTINCT o_orderdate) FILTER (WHERE o_orderkey % 50 <> 0) AS duplicate_dates FROM orders WHERE true""".replace(
    "min(o_orderdate)", "min(o_orderdate) FILTER (WHERE o_orderkey % 50 <> 0)").replace("max(o_orderdate)", "max(o_orderdate) FILTER (WHERE o_orderkey % 50 <> 0)"))
def _(t):
    odd = t.orders.select(F.when(F.col("o_orderkey") % 50 == 0, F.lit("unknown")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    return P.temporal_profile(odd, "d").select("min_ts", "max_ts", "invalid_dates", "duplicate_dates")


@query("prf_25_steps", f"""WITH d AS (SELECT DISTINCT l_shipdate AS ts FROM lineitem), g AS (SELECT epoch(ts - lag(ts) OVER (ORDER BY ts)) AS gap FROM d),
    m AS (SELECT median(gap) AS med FROM g)
    SELECT {r('any_value(med)', 'median_interval_seconds')}, CAST(sum(greatest(round_even(gap / med, 0) - 1, 0)) AS BIGINT) AS missing_periods_estimate FROM g, m""")
def _(t):
    return P.temporal_profile(t.lineitem, "l_shipdate").select("median_interval_seconds", "missing_periods_estimate")


@query("prf_26_frequency", """WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS ts FROM events), g AS (SELECT ts - lag(ts) OVER (ORDER BY ts) AS gap FROM d)
    SELECT CASE WHEN min(gap) = max(gap) AND min(gap) = INTERVAL 1 DAY THEN 'D' END AS frequency, min(gap) = max(gap) AS regular FROM g""")
def _(t):
    return P.temporal_profile(t.events.select(F.date_trunc("day", "ts").alias("ts")), "ts").select("frequency", "regular")


@query("prf_26_month_starts", "SELECT 'MS' AS frequency, count(DISTINCT date_trunc('month', o_orderdate)) AS distinct_dates FROM orders")
def _(t):
    return P.temporal_profile(t.orders.select(F.date_trunc("month", "o_orderdate").alias("ts")), "ts").select("frequency", "distinct_dates")


@query("prf_27_suitability", """SELECT count(DISTINCT o_orderdate) >= 8 AS trend_suitable, count(DISTINCT o_orderdate) >= 24 AS seasonality_suitable,
    count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1998-01-01') AS future_timestamps FROM orders""")
def _(t):
    return P.temporal_profile(t.orders, "o_orderdate", "1998-01-01").select("trend_suitable", "seasonality_suitable", "future_timestamps")


CORR = "(" + union_all(f"SELECT '{a}' AS x, '{b}' AS y, {'max(CAST(1 AS DOUBLE))' if a == b else f'corr({a}, {b})'} AS value FROM lineitem" for a in LINE_NUMBERS for b in LINE_NUMBERS) + ")"


@query("prf_28_correlations", f"SELECT x, y, {r('value', 'value', 3)} FROM {CORR}", 3)
def _(t):
    return P.correlations(t.lineitem, LINE_NUMBERS)


@query("prf_29_strongest_pair", f"SELECT x, y, {r('value', 'value')} FROM {CORR} WHERE x < y ORDER BY abs(value) DESC, x, y LIMIT 1")
def _(t):
    return P.strongest_pairs(P.correlations(t.lineitem, LINE_NUMBERS, None), 1)


QUALITY = f"""(WITH x AS (SELECT lang, source, quality, toxic FROM {LABELLED}) SELECT count(*) AS n, 2 * count(*) - count(quality) - count(toxic) AS missing,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x)) AS dup FROM x)"""


@query("prf_30_quality", f"SELECT {r('greatest(0.0, 100 - missing / (n * 4) * 100 - dup / n * 100)', 'quality_score', 1)}, CAST(missing AS BIGINT) AS missing_cells, dup AS duplicates FROM {QUALITY}", 1)
def _(t):
    return P.profile_totals(P.profile(t.labelled().select("lang", "source", "quality", "toxic"))).select("quality_score", "missing_cells", "duplicates")


@query("prf_31_invalid", "SELECT count(*) FILTER (WHERE event_id % 97 = 0) AS invalid_values FROM events")
def _(t):
    return P.profile_totals(P.profile(_spoiled(t), ["event_id"])).select("invalid_values")


@query("prf_32_role_lists", """SELECT count(*) AS rows, 'doc_id' AS possible_ids, 'text' AS high_cardinality_columns, 'text' AS free_text_columns, '' AS constant_columns FROM documents""")
def _(t):
    return P.profile_totals(P.profile(t.documents, ["doc_id"])).select("rows", "possible_ids", "high_cardinality_columns", "free_text_columns", "constant_columns")


@query("prf_33_extreme", f"""SELECT {r('avg(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE -c_acctbal END)', 'mean')}, true AS extreme_magnitude,
    {r('skewness(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE -c_acctbal END)', 'skewness')} FROM customer""")
def _(t):
    huge = t.customer.select((F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).otherwise(-F.col("c_acctbal")) * F.lit(1e300)).alias("v"))
    return P.scaled_moments(huge, ["v"]).select((F.col("mean") / F.lit(1e300)).alias("mean"), "extreme_magnitude", "skewness")


ORDER_TARGETS = """SELECT * FROM (VALUES ('o_custkey', 0.35, 'regression'), ('o_orderpriority', 0.3, 'classification'), ('o_orderstatus', 0.3, 'classification'),
    ('o_totalprice', 0.35, 'regression'), ('o_orderkey', 0.35, 'regression')) v(c, s, k)"""


@query("prf_34_targets", f"""SELECT c AS "column", k AS task, {r('CAST(CASE WHEN c = ' + "'o_totalprice'" + ' THEN s + 0.4 ELSE s END AS DOUBLE)', 'score', 2)},
    CASE WHEN c = 'o_totalprice' THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM ({ORDER_TARGETS})""", 2)
def _(t):
    return P.rank_targets(P.profile(t.orders, ["o_orderkey"]), "Explain o totalprice by priority")


@query("prf_35_auto_target", "SELECT 'price' AS \"column\", CAST(0.95 AS DOUBLE) AS score")
def _(t):
    priced = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderstatus")
    return P.auto_target(P.rank_targets(P.profile(priced, ["o_orderkey"]), "Predict the price"))


@query("prf_36_tasks", each(list(LINE_KINDS), lambda c: f"""SELECT '{c}' AS "column", CASE WHEN {'false' if LINE_KINDS[c] == 'numeric' else 'true'} OR (count(DISTINCT {c}) <= 15 AND count(DISTINCT {c}) / count({c}) < 0.1)
    THEN 'classification' ELSE 'regression' END AS task FROM lineitem"""))
def _(t):
    found = P.frequency_summary(P.frequencies(t.lineitem, list(LINE_KINDS)))
    kinds = F.create_map(*[F.lit(v) for pair in P.column_kinds(t.lineitem).items() for v in pair])
    return found.withColumn("kind", kinds[F.col("column")]).select("column", P.infer_task("kind", "unique", "non_null").alias("task"))


@query("prf_37_named_target", """WITH o AS (SELECT p_partkey, 'effect of ' || p_name AS goal FROM part), n AS (SELECT unnest(['small ring', 'blue bolt', 'red widget', 'blue']) AS c)
    SELECT p_partkey, any_value(replace(c, ' ', '_')) AS target FROM o JOIN n ON contains(goal, c) GROUP BY 1 HAVING count(*) = 1""")
def _(t):
    goals = t.part.select("p_partkey", F.concat(F.lit("Effect of "), "p_name").alias("goal"))
    return P.match_targets(goals, "goal", ["small_ring", "blue_bolt", "red_widget", "blue"]).select("p_partkey", "target")


@query("prf_38_missing_report", f"""SELECT 'quality' AS "column", count(*) - count(quality) AS missing, {r('(count(*) - count(quality)) / count(*) * 100', 'missing_pct', 2)} FROM {LABELLED}
    UNION ALL SELECT 'toxic', count(*) - count(toxic), {r('(count(*) - count(toxic)) / count(*) * 100', 'missing_pct', 2)} FROM {LABELLED}""", 2)
def _(t):
    return P.missing_report(P.counts(t.labelled()))


@query("prf_39_top_pairs", f"SELECT x, y, {r('value', 'value')} FROM {CORR} WHERE x < y AND value IS NOT NULL ORDER BY abs(value) DESC, x, y LIMIT 5")
def _(t):
    return P.strongest_pairs(P.correlations(t.lineitem, LINE_NUMBERS, None), 5)


@query("prf_40_summary", """WITH c AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1)
    SELECT 'categorical' AS kind, (SELECT count(*) FROM c) AS "unique", (SELECT string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v) FROM (SELECT * FROM c ORDER BY n DESC, v LIMIT 4)) AS top_values""")
def _(t):
    return P.column_summary(P.profile(t.customer, ["c_custkey"]), "c_mktsegment").select("kind", "unique", "top_values")


@query("prf_41_issues", f"""SELECT v.place, v.issue, v.value FROM {QUALITY} q, LATERAL (VALUES
    (CAST(1 AS BIGINT), 'Empty cells', format('{{:,}}', q.missing::BIGINT) || ' cells (' || round(missing / (n * 4) * 100, 2) || '%)'), (2, 'Repeated rows', format('{{:,}}', dup)),
    (3, 'Rows beyond the quartile fences', (SELECT format('{{:,}}', count(*)) FROM {LABELLED}, (SELECT quantile_cont(quality, 0.25) AS a, quantile_cont(quality, 0.75) AS c,
        quantile_cont(toxic, 0.25) AS e, quantile_cont(toxic, 0.75) AS g FROM labels) WHERE quality < a - 1.5 * (c - a) OR quality > c + 1.5 * (c - a) OR toxic < e - 1.5 * (g - e) OR toxic > g + 1.5 * (g - e))), (4, 'Cells without a finite value', '0'),
    (5, 'Columns of nearly one value', 'None detected'), (6, 'Likely identifiers', 'None detected'), (7, 'Too many labels or long texts', 'None detected')) v(place, issue, value)""")
def _(t):
    return P.quality_issues(P.profile_totals(P.profile(t.labelled().select("lang", "source", "quality", "toxic")))).select("place", "issue", "value")


@query("prf_42_totals", f"""SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns, {r('8 / 11', 'numeric_ratio')}, {r('2 / 11', 'categorical_ratio')}, {r('1 / 11', 'datetime_ratio')} FROM lineitem""")
def _(t):
    return P.profile_totals(P.profile(t.lineitem)).select("rows", "columns", "numeric_ratio", "categorical_ratio", "datetime_ratio")


@query("ev_06_overview", """SELECT CAST(1 AS BIGINT) AS place, format('{:,}', count(*)) || ' rows in 6 columns.' AS sentence, 'info' AS kind FROM events
    UNION ALL SELECT 2, '100.0% of cells are filled; 0 columns have gaps.', 'success'
    UNION ALL SELECT 3, '0 rows repeat another one exactly.', 'success'
    UNION ALL SELECT 4, (SELECT format('{:,}', count(*)) FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM events) WHERE value < a - 1.5 * (c - a) OR value > c + 1.5 * (c - a)) || ' rows have a number beyond the quartile fences.', 'warning'""")
def _(t):
    return P.overview(P.profile_totals(P.profile(t.events, ["event_id"]))).select("place", "sentence", "kind")


@query("ev_06_strongest_pair", f"""SELECT CAST(5 AS BIGINT) AS place, x || ' and ' || y || ' have a Pearson correlation of ' || printf('%.2f', c) || '.' AS sentence FROM
    ({union_all(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 3) AS c FROM lineitem" for a, b in itertools.combinations(sorted(LINE_NUMBERS), 2))}) ORDER BY abs(c) DESC, x, y LIMIT 1""")
def _(t):
    return P.overview(P.profile_totals(P.profile(t.region, ["r_regionkey"])), P.correlations(t.lineitem, LINE_NUMBERS)).filter("place = 5").select("place", "sentence")


@query("nrm_12_roles", """SELECT 'o_orderkey' AS "column", true AS usable_numeric, false AS bounded_category, false AS is_date FROM orders WHERE o_orderkey = 0
    UNION ALL SELECT 'o_custkey', true, false, false UNION ALL SELECT 'o_orderstatus', false, true, false UNION ALL SELECT 'o_totalprice', true, false, false
    UNION ALL SELECT 'o_orderdate', false, false, true UNION ALL SELECT 'o_orderpriority', false, true, false""")
def _(t):
    return P.roles(P.profile(t.orders, ["o_orderkey"])).select("column", "usable_numeric", "bounded_category", "is_date")


@query("st_01_eligible", """SELECT 'o_orderkey' AS "column", 'eligible' AS status UNION ALL SELECT 'o_custkey', 'eligible' UNION ALL SELECT 'o_orderstatus', 'eligible'
    UNION ALL SELECT 'o_totalprice', 'eligible' UNION ALL SELECT 'o_orderpriority', 'eligible'""")
def _(t):
    from assayer.operators.inference import eligible
    return eligible(P.profile(t.orders, ["o_orderkey"])).select("column", "status")


@query("lk_01_names", """SELECT column_name AS "column" FROM (SELECT column_name FROM (DESCRIBE orders)) WHERE false UNION ALL SELECT 'next_order' UNION ALL SELECT 'cancellation_date'""")
def _(t):
    from assayer.operators.leakage import named_like_outcome
    odd = t.orders.select("o_orderkey", F.col("o_totalprice").alias("next_order"), F.col("o_orderdate").alias("cancellation_date"), "o_orderpriority")
    return named_like_outcome(P.counts(odd)).select("column")


@query("an_06_iqr", f"SELECT count(*) FILTER (WHERE value < a - 1.5 * (c - a) OR value > c + 1.5 * (c - a)) AS outliers FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM events)")
def _(t):
    return P.outliers(t.events, ["value"]).filter(F.col("column") == "*").select("outliers")


