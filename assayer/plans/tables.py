"""Queries over sources, normalisation, joins, windows, top-k, sets and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.functions import dates, digests, numbers, text
from assayer.operators import inference, metrics, normalize, ranking, registry, sampling, splits, temporal
from assayer.operators import profile as P
from assayer.plans.base import LABELLED, LINE_KEY, LINE_MD5, moved_sql, query, r, stamp, union_all
from assayer.sources import demo, tables

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]

# ---- sources and sinks ------------------------------------------------------------------------


@query("src_01_csv", f"SELECT c_mktsegment, count(*) AS n, {r('avg(c_acctbal)', 'mean')} FROM customer GROUP BY 1")
def _(t):
    path = tables.write_table(t.customer, t.scratch(".csv"))
    back = tables.read_table(t.spark, path, t.customer.schema)
    return back.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"))


@query("src_02_parquet", f"SELECT count(*) AS n, {r('sum(l_quantity)', 'quantity', 2)}, {r('avg(l_extendedprice)', 'price', 2)} FROM lineitem", 2)
def _(t):
    return tables.read_table(t.spark, f"{t.folder}/lineitem.parquet").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"))


@query("src_03_projected", f"SELECT {r('max(l_quantity)', 'q')}, {r('max(l_extendedprice)', 'p')} FROM lineitem")
def _(t):
    two = tables.read_table(t.spark, f"{t.folder}/lineitem.parquet", columns=["l_quantity", "l_extendedprice"])
    return two.agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"))


@query("src_04_write", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def _(t):
    path = tables.write_table(normalize.normalize(t.orders), t.scratch(".parquet"))
    return tables.read_table(t.spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("src_05_shape", """SELECT 'fits' AS "limit", CAST(NULL AS VARCHAR) AS message, count(*) AS rows FROM part UNION ALL
    SELECT 'rows', CASE WHEN count(*) > 100 THEN 'Maximum table size is 100 rows.' END, count(*) FILTER (WHERE false) FROM part UNION ALL
    SELECT 'columns', CASE WHEN (SELECT count(*) FROM information_schema.columns WHERE table_name = 'part') > 2 THEN 'Maximum table width is 2 columns.' END, 0 UNION ALL
    SELECT 'empty', CASE WHEN count(*) = 0 THEN 'The table has no data rows.' END, 0 FROM part WHERE p_partkey < 0""")
def _(t):
    """The guard lets a table pass or says which limit it breaks."""
    rows = []
    for name, table, limits in (("fits", t.part, {"max_rows": 10**9, "max_columns": 200}), ("rows", t.part, {"max_rows": 100}), ("columns", t.part, {"max_columns": 2}), ("empty", t.part.filter("p_partkey < 0"), {})):
        try:
            rows.append((name, None, tables.check_shape(table, **limits).count()))
        except ValueError as error:
            rows.append((name, str(error), 0))
    return t.spark.createDataFrame(rows, "limit string, message string, rows long")


@query("src_06_digest", """WITH x AS (SELECT CAST(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus,
    CAST(CAST(o_totalprice AS DECIMAL(38,6)) AS VARCHAR), CAST(o_orderdate AS VARCHAR), o_orderpriority)), 1, 8)) AS UBIGINT) AS h FROM orders)
    SELECT count(*) AS rows, sha256(count(*) || ':' || sum(h)) AS digest FROM x""")
def _(t):
    return tables.table_digest(t.orders)


@query("src_07_catalog", union_all(
    f"SELECT '{n}' AS name, '{n.title()}' AS title, count(*) AS rows, CAST((SELECT count(*) FROM (DESCRIBE {n})) AS BIGINT) AS columns FROM {n}" for n in TABLES))
def _(t):
    return tables.catalog({n: getattr(t, n) for n in TABLES}).orderBy("name")


@query("src_08_profile_cache", union_all(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, CAST(4 AS BIGINT) AS profile_version FROM {LABELLED}"
    for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")))
def _(t):
    base = t.labelled()
    old = P.counts(base).withColumn("profile_version", F.lit(3))
    return tables.fresh_profile(old, lambda: P.counts(base)).select("column", "missing", "profile_version")


def _uniform_sql(key: str, salt: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{salt}', {key})), 1, 8)) AS UBIGINT) / 4294967296.0)"


def _poisson_sql(u: str, rate: float, top: int = 12) -> str:
    total = term = math.exp(-rate)
    cases = [f"WHEN {u} < {total!r}::DOUBLE THEN 0"]
    for k in range(1, top):
        term *= rate / k
        total += term
        cases.append(f"WHEN {u} < {total!r}::DOUBLE THEN {k}")
    return "CASE " + " ".join(cases) + f" ELSE {top} END"


_U = lambda salt: _uniform_sql("c_custkey", salt)


@query("src_09_demo_churn", f"""SELECT CASE WHEN {_U('contract')} < 0.55 THEN 'Monthly' WHEN {_U('contract')} < 0.55 + 0.3 THEN 'Annual' ELSE 'Two year' END AS contract_type,
    count(*) AS n, CAST(sum(floor({_U('tenure')} * 72) + 1) AS BIGINT) AS tenure, CAST(sum({_poisson_sql(_U('tickets'), 1.2)}) AS BIGINT) AS tickets,
    count(*) FILTER (WHERE {_U('gap')} < 55 / 2200.0) AS gaps FROM customer GROUP BY 1""")
def _(t):
    return demo.churn(t.customer, "c_custkey").groupBy("contract_type").agg(
        F.count("*").alias("n"), F.sum("tenure_months").alias("tenure"), F.sum("support_tickets").alias("tickets"),
        F.count_if(F.col("usage_gb").isNull()).alias("gaps"))


@query("src_10_demo_revenue", f"""SELECT count(*) AS n, CAST(sum(floor({_U('size')} * 3600) + 400) AS BIGINT) AS size,
    CAST(sum(floor({_U('staff')} * 27) + 3) AS BIGINT) AS staff FROM customer""")
def _(t):
    return demo.revenue(t.customer, "c_custkey").agg(F.count("*").alias("n"), F.sum("store_size").alias("size"), F.sum("employees").alias("staff"))


@query("src_11_demo_panel", f"""SELECT {stamp('CAST(m AS TIMESTAMP)', 'order_date')}, count(*) AS regions
    FROM (SELECT DISTINCT s_name FROM supplier), (SELECT unnest(generate_series(DATE '2022-01-01', DATE '2025-12-01', INTERVAL 1 MONTH)) AS m) GROUP BY 1""")
def _(t):
    panel = demo.monthly_panel(t.supplier.select("s_name").distinct(), "s_name")
    return panel.groupBy("order_date").agg(F.count("sales").alias("regions"))


@query("src_12_json_out", f"SELECT o_orderpriority, count(*) AS n, {r('max(o_totalprice)', 'top')} FROM orders GROUP BY 1")
def _(t):
    facts = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return tables.read_table(t.spark, tables.write_table(facts, t.scratch(".json")), facts.schema)


@query("src_13_json_in", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.select(F.from_json("props", "k long").alias("p")).groupBy("p.k").agg(F.count("*").alias("n"))


# ---- normalisation ----------------------------------------------------------------------------

@query("nrm_01_names", "SELECT max(o_orderkey) AS o_orderkey, max(o_custkey) AS column_1 FROM orders")
def _(t):
    odd = t.orders.select(F.col("o_orderkey").alias("  o_orderkey "), F.col("o_custkey").alias("   "))
    return normalize.normalize(odd).agg(F.max("o_orderkey").alias("o_orderkey"), F.max("column_1").alias("column_1"))


@query("nrm_02_text_cells", "SELECT CAST(label AS BIGINT) AS label, count(embedding) AS n, CAST(sum(len(embedding)) AS BIGINT) AS cells FROM embeddings GROUP BY 1")
def _(t):
    flat = normalize.normalize(t.embeddings)
    return flat.groupBy("label").agg(F.count("embedding").alias("n"), F.sum(F.size(F.split("embedding", ","))).alias("cells"))


@query("nrm_03_nonfinite", f"""WITH x AS (SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS v FROM events)
    SELECT count(*) - count(v) AS infinite_values, count(v) AS kept, {r('avg(v)', 'mean')} FROM x""")
def _(t):
    odd = t.events.withColumn("value", F.when(F.col("event_id") % 97 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    counted = normalize.nonfinite_counts(odd).filter(F.col("column") == "value").select("infinite_values", F.lit(0).alias("a"))
    clean = normalize.normalize(odd).agg(F.count("value").alias("kept"), F.avg("value").alias("mean"), F.lit(0).alias("a"))
    return counted.join(F.broadcast(clean.groupBy("a").agg(F.first("kept").alias("kept"), F.first("mean").alias("mean"))), "a").drop("a")


@query("nrm_04_dedup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem) GROUP BY ALL")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity").dropDuplicates().groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("nrm_05_null_target", f"SELECT lang, count(*) AS n FROM {LABELLED} WHERE quality IS NOT NULL GROUP BY 1")
def _(t):
    return t.labelled().na.drop(subset=["quality"]).groupBy("lang").agg(F.count("*").alias("n"))


@query("nrm_06_coerce", f"""SELECT count(*) AS n, {r('avg(v)', 'mean')} FROM (SELECT TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE substr(c_name, 10) END AS DOUBLE) AS v FROM customer) WHERE v IS NOT NULL""")
def _(t):
    odd = t.customer.select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.expr("substring(c_name, 10)")).alias("v"))
    return normalize.coerce_numbers(odd, "v").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


@query("nrm_07_complete", f"SELECT lang, count(*) AS n, {r('avg(n_chars)', 'mean')} FROM {LABELLED} WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1")
def _(t):
    return normalize.complete_cases(t.labelled(), ["quality", "toxic"]).groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"))


@query("nrm_08_page", "SELECT o_orderkey, o_custkey, o_orderstatus, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    return sampling.page(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], 40, 20)


@query("nrm_09_scatter", f"SELECT {r('l_quantity', 'x')}, {r('l_extendedprice', 'y')} FROM (SELECT * FROM lineitem ORDER BY {LINE_MD5}, {', '.join(LINE_KEY)} LIMIT 600)")
def _(t):
    return sampling.scatter(t.lineitem, "l_quantity", "l_extendedprice", LINE_KEY, 600)


@query("nrm_10_first_points", f"SELECT CAST(o_custkey AS BIGINT) AS x, {r('o_totalprice', 'y')} FROM orders ORDER BY o_orderkey LIMIT 500")
def _(t):
    return sampling.first_points(t.orders, "o_custkey", "o_totalprice", ["o_orderkey"], 500)


@query("nrm_11_sample", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM lineitem ORDER BY {LINE_MD5}, {', '.join(LINE_KEY)} LIMIT 500")
def _(t):
    return sampling.stable_sample(t.lineitem.select(*LINE_KEY), LINE_KEY, 500).select("l_orderkey", "l_linenumber", "l_partkey")


@query("nrm_11_strata", """SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS k FROM orders) WHERE k <= 25""")
def _(t):
    return sampling.stable_sample(t.orders, ["o_orderkey"], 25, ["o_orderpriority"]).select("o_orderpriority", "o_orderkey")


@query("nrm_13_violations", """SELECT event_id, 'k' AS "column", 'must be a finite number or null' AS reason FROM events WHERE event_id % 50 = 0""")
def _(t):
    odd = t.events.select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit("n/a")).otherwise(F.get_json_object("props", "$.k")).alias("k"))
    return normalize.input_violations(odd, ["event_id"], ["k"], ["k"])


@query("nrm_13_valid_inputs", f"SELECT count(*) AS n, {r('''sum(CAST(json_extract(props, '$.k') AS DOUBLE))''', 'total')} FROM events WHERE event_id % 50 <> 0")
def _(t):
    odd = t.events.select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit("n/a")).otherwise(F.get_json_object("props", "$.k")).alias("k"))
    return normalize.valid_inputs(odd, ["event_id"], ["k"], ["k"]).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("nrm_14_clean_text", "SELECT trim('  ' || p_type || ' ') AS p_type, count(*) AS n FROM part GROUP BY 1")
def _(t):
    padded = t.part.withColumn("p_type", F.concat(F.lit("  "), F.col("p_type"), F.lit(" ")))
    return normalize.clean_text(padded, ["p_type"]).groupBy("p_type").agg(F.count("*").alias("n"))


@query("nrm_15_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'blue')")
def _(t):
    return t.part.filter(text.contains_ignoring_case(["p_name", "p_brand"], "BLUE")).select("p_partkey", "p_name")


@query("nrm_16_owner", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 42")
def _(t):
    return t.orders.filter(F.col("o_custkey") == 42).select("o_orderkey", "o_orderstatus")


# ---- joins ------------------------------------------------------------------------------------

@query("jn_01_column_pairs", """WITH c AS (SELECT column_name AS name, row_number() OVER () AS i FROM (DESCRIBE lineitem))
    SELECT a.i AS i, b.i AS j, a.name AS "left", b.name AS "right" FROM c a JOIN c b ON a.i < b.i ORDER BY a.i, b.i LIMIT 24""")
def _(t):
    li = t.lineitem
    meta = P.counts(li).withColumn("position", F.array_position(F.array(*[F.lit(c) for c in li.columns]), F.col("column")))
    return inference.column_pairs(meta, 24).select("i", "j", "left", "right")


@query("jn_02_spine", f"""WITH b AS (SELECT date_trunc('hour', ts) AS p, avg(value) AS v, count(*) AS n FROM events GROUP BY 1),
    s AS (SELECT unnest(generate_series((SELECT min(p) FROM b), (SELECT max(p) FROM b), INTERVAL 1 HOUR)) AS p)
    SELECT {stamp('s.p', 'period')}, {r('b.v', 'value')}, coalesce(b.n, 0) AS rows FROM s LEFT JOIN b ON s.p = b.p""")
def _(t):
    return temporal.calendar_series(t.events, "ts", "value", frequency="h").select("period", "value", "rows")


@query("jn_03_group_median", f"""WITH m AS (SELECT l_returnflag, median(l_quantity) AS med FROM lineitem GROUP BY 1)
    SELECT l.l_returnflag AS label, count(*) AS n, {r('avg(abs(l_quantity - med))', 'mean')} FROM lineitem l JOIN m USING (l_returnflag) GROUP BY 1""")
def _(t):
    return inference.deviation_rows(t.lineitem, ["l_returnflag"], ["l_quantity"]).select("label", "n", "mean")


@query("jn_05_experiment_runs", f"""SELECT c_custkey, count(o_orderkey) AS runs, {r('max(o_totalprice)', 'best')} FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def _(t):
    runs = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    out = registry.with_runs(t.customer.select("c_custkey"), runs, "c_custkey", [F.count("o_orderkey").alias("runs"), F.max("o_totalprice").alias("best")])
    return out.withColumn("runs", F.coalesce("runs", F.lit(0)))


@query("jn_06_referenced", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(t):
    return registry.referenced(t.customer, t.orders, "c_custkey", "o_custkey").select("c_custkey")


@query("jn_06_unreferenced", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _(t):
    return registry.referenced(t.part, t.lineitem.filter("l_quantity > 49"), "p_partkey", "l_partkey", True).select("p_partkey")


@query("jn_07_actual_predicted", f"""SELECT o_orderkey, {r('o_totalprice', 'actual', 4)}, {r('m', 'predicted', 4)}, {r('o_totalprice - m', 'residual', 4)}
    FROM orders JOIN (SELECT o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY 1) USING (o_orderpriority)""", 4)
def _(t):
    means = t.orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("prediction"))
    pred = t.orders.join(means, "o_orderpriority").withColumnRenamed("o_totalprice", "label")
    return metrics.residuals(pred, ["o_orderkey"], None)


PLACED = "(SELECT *, row_number() OVER (ORDER BY md5('rows|' || o_orderkey), o_orderkey) - 1 AS place FROM orders)"


@query("jn_08_permuted", union_all(f"""SELECT '{s}' AS salt, a.o_orderkey, {r('b.o_totalprice', 'o_totalprice')} FROM {PLACED} a JOIN {moved_sql(PLACED, s)} b ON b.target = a.place""" for s in ("p", "q")))
def _(t):
    from assayer.operators.explain import permuted
    got = permuted(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"], ["o_orderkey"], ["p", "q"])
    return got.select(F.col("__salt").alias("salt"), "o_orderkey", F.col("__moved.o_totalprice").alias("o_totalprice"))


@query("jn_09_after_reference", f"""SELECT 'l_shipdate' AS feature, count(*) AS n, {r('avg(CAST(l_shipdate > o_orderdate AS DOUBLE))', 'after_share')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    from assayer.operators.leakage import after_reference
    return after_reference(t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")), ["l_shipdate"], "o_orderdate")


# ---- aggregations -------------------------------------------------------------------------------

@query("agg_01_group_summary", f"SELECT l_returnflag AS label, count(*) AS n, {r('avg(l_extendedprice)', 'mean')}, {r('median(l_extendedprice)', 'median')} FROM lineitem GROUP BY 1")
def _(t):
    return inference.group_summary(t.lineitem, "l_returnflag", "l_extendedprice")


@query("agg_02_contingency", "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    return inference.contingency(t.lineitem, [("l_returnflag", "l_linestatus")]).select("a", "b", "n")


BALANCE = """SELECT class, rows, round(rows / total, 6) + 0.0 AS share, round(least_rows / total, 6) + 0.0 AS minority_share, least_rows / total < 0.1 AS severe FROM (
    SELECT class, rows, CAST(sum(rows) OVER () AS DOUBLE) AS total, min(rows) OVER () AS least_rows FROM (SELECT {c} AS class, count(*) AS rows FROM {t} GROUP BY 1))"""


@query("agg_03_class_balance", BALANCE.format(c="event_type", t="events"))
def _(t):
    return metrics.class_balance(t.events, "event_type")


@query("agg_03_balance_distinct", BALANCE.format(c="l_returnflag", t="(SELECT DISTINCT l_returnflag, l_quantity, l_discount FROM lineitem)"))
def _(t):
    return metrics.class_balance(t.lineitem.select("l_returnflag", "l_quantity", "l_discount").dropDuplicates(), "l_returnflag")


@query("agg_04_periods", f"SELECT {stamp('''date_trunc('month', o_orderdate)''', 'period')}, {r('sum(o_totalprice)', 'value', 2)}, count(*) AS rows FROM orders GROUP BY 1", 2)
def _(t):
    return temporal.calendar_series(t.orders, "o_orderdate", "o_totalprice", frequency="MS", how="sum").select("period", "value", "rows")


def _runs(t):
    """Orders read as runs: status, task and score follow from their columns."""
    return t.orders.select(
        F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("experiment"), F.col("o_orderdate").alias("created"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued").alias("status"),
        F.when(F.col("o_custkey") % 2 == 0, "regression").otherwise("classification").alias("task"), F.col("o_orderpriority").alias("target"),
        F.lit("rmse").alias("metric"), F.lit("random").alias("split"), F.col("o_totalprice").alias("selection_score"))


RUNS = """(SELECT o_orderkey AS run, o_custkey AS experiment, o_orderdate AS created,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status,
    CASE WHEN o_custkey % 2 = 0 THEN 'regression' ELSE 'classification' END AS task, o_orderpriority AS target, 'rmse' AS metric, 'random' AS split,
    o_totalprice AS selection_score FROM orders)"""


@query("agg_05_dashboard", f"""SELECT (SELECT count(*) FROM customer) AS tables, (SELECT CAST(sum(c_nationkey) AS BIGINT) FROM customer) AS rows,
    (SELECT {r('avg(c_acctbal)', 'q', 1)} FROM customer) AS average_quality, count(*) FILTER (WHERE status = 'completed') AS models,
    count(*) FILTER (WHERE status IN ('queued', 'running')) AS active_runs FROM {RUNS}""")
def _(t):
    return registry.dashboard(t.customer.select(F.col("c_nationkey").alias("rows"), F.col("c_acctbal").alias("quality_score")), _runs(t))


@query("agg_06_cluster_profile", f"""WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL),
    m AS (SELECT s, arg_min(p, (-n, p)) AS mode_p FROM c GROUP BY 1)
    SELECT o_orderstatus, count(*) AS rows, {r('avg(o_totalprice)', 'mean_o_totalprice', 3)}, any_value(mode_p) AS mode_o_orderpriority,
    {r('count(*) / (SELECT count(*) FROM orders)', 'share')} FROM orders JOIN m ON o_orderstatus = s GROUP BY 1""")
def _(t):
    return metrics.cluster_profile(t.orders, "o_orderstatus", ["o_totalprice"], ["o_orderpriority"])


@query("agg_07_distinct", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def _(t):
    found = P.frequency_summary(P.frequencies(t.orders, ["o_custkey", "o_orderpriority"]))
    return found.agg(F.max(F.when(F.col("column") == "o_custkey", F.col("unique"))).alias("customers"),
                     F.max(F.when(F.col("column") == "o_orderpriority", F.col("unique"))).alias("priorities"))


@query("agg_08_row_accounting", f"""WITH x AS (SELECT lang, source, quality FROM {LABELLED}), d AS (SELECT DISTINCT * FROM x)
    SELECT (SELECT count(*) FROM x) AS original_rows, (SELECT count(*) FROM x) - (SELECT count(*) FROM d) AS removed_exact_duplicates,
    (SELECT count(*) FROM d WHERE quality IS NULL) AS excluded_target_rows, (SELECT count(quality) FROM d) AS usable_rows""")
def _(t):
    from assayer.operators.features import row_accounting
    return row_accounting(t.labelled().select("lang", "source", "quality"), "quality")


# ---- windows ------------------------------------------------------------------------------------

DAILY = """(WITH b AS (SELECT event_type, date_trunc('day', ts) AS p, avg(value) AS v FROM events GROUP BY ALL),
    e AS (SELECT event_type, unnest(generate_series(min(p), max(p), INTERVAL 1 DAY)) AS p FROM b GROUP BY 1)
    SELECT e.event_type, e.p, b.v FROM e LEFT JOIN b USING (event_type, p))"""


def _daily(t):
    return temporal.calendar_series(t.events, "ts", "value", ["event_type"], frequency="D")


@query("win_01_rolling", f"SELECT event_type, {stamp('p', 'period')}, {r('CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END', 'rolling_average')} FROM {DAILY} WINDOW w AS (PARTITION BY event_type ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(t):
    return temporal.rolling(_daily(t)).select("event_type", "period", "rolling_average")


@query("win_02_previous", f"SELECT event_type, {stamp('p', 'period')}, {r('CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END', 'previous_average')} FROM {DAILY} WINDOW w AS (PARTITION BY event_type ORDER BY p ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def _(t):
    return temporal.rolling(_daily(t)).select("event_type", "period", "previous_average")


@query("win_03_step", f"""WITH x AS (SELECT event_type, p, CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END AS a FROM {DAILY} WINDOW w AS (PARTITION BY event_type ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT event_type, {stamp('p', 'period')}, {r('abs(a - lag(a) OVER (PARTITION BY event_type ORDER BY p))', 'rolling_change')} FROM x""")
def _(t):
    return temporal.rolling(_daily(t)).select("event_type", "period", "rolling_change")


MONTHLY = """(WITH b AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate) AS p, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY ALL),
    e AS (SELECT k, unnest(generate_series(min(p), max(p), INTERVAL 1 MONTH)) AS p FROM b GROUP BY 1)
    SELECT e.k, e.p, b.v, coalesce(b.n, 0) AS n, row_number() OVER (PARTITION BY e.k ORDER BY e.p) - 1 AS i FROM e LEFT JOIN b USING (k, p))"""


def _monthly(t):
    return temporal.calendar_series(t.orders.withColumnRenamed("o_orderpriority", "k"), "o_orderdate", "o_totalprice", ["k"])


@query("win_04_growth", f"""WITH x AS (SELECT k, i, v, lag(v) OVER (PARTITION BY k ORDER BY i) AS prior, max(i) OVER (PARTITION BY k) AS last FROM {MONTHLY})
    SELECT k, {r('CASE WHEN prior <> 0 THEN (v - prior) / abs(prior) * 100 END', 'latest_growth_pct')} FROM x WHERE i = last""")
def _(t):
    return temporal.trend(_monthly(t)).select("k", "latest_growth_pct")


@query("win_05_gap", f"""WITH d AS (SELECT DISTINCT l_shipdate AS ts FROM lineitem) SELECT {stamp('ts', 'l_shipdate')}, {r('epoch(ts - lag(ts) OVER (ORDER BY ts))', 'gap_seconds')} FROM d""")
def _(t):
    return ranking.gaps(t.lineitem, "l_shipdate", rows=ranking.SMALL_ROWS + 1, buckets=64)


@query("win_06_average_rank", f"""WITH c AS (SELECT l_extendedprice AS value, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT {r('value', 'value')}, n, {r('sum(n) OVER (ORDER BY value) - (n - 1) / 2.0', 'avg_rank')} FROM c""")
def _(t):
    ranks = ranking.average_ranks(t.lineitem.select(F.col("l_extendedprice").alias("value")), "value", rows=ranking.SMALL_ROWS + 1, buckets=64)
    return ranks.select("value", "n", "avg_rank")


@query("win_07_fdr", f"""WITH g AS (SELECT l_suppkey AS id, least(1.0, abs(avg(l_extendedprice) - 53000) / 5000) AS p FROM lineitem GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rk, count(*) OVER () AS m FROM g)
    SELECT id, {r('least(1.0, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING))', 'q_value')} FROM k""")
def _(t):
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.least(F.lit(1.0), F.abs(F.avg("l_extendedprice") - 53000) / 5000).alias("p_value"))
    return inference.fdr(p).select("id", "q_value")


@query("win_08_period_index", f"SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderdate) AS code FROM orders")
def _(t):
    at = t.orders.select("o_orderdate").distinct().withColumns({"at": F.unix_micros("o_orderdate"), "one": F.lit(1)})
    codes = ranking.running_totals(at, "at", ["one"], rows=ranking.SMALL_ROWS + 1, buckets=64).select("o_orderdate", F.col("upto_one").alias("code"))
    return t.orders.join(codes, "o_orderdate").select("o_orderkey", "code")


@query("win_09_class_position", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS position FROM orders")
def _(t):
    return ranking.hash_positions(t.orders, ["o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "position")


@query("win_10_first_per_type", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
def _(t):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return t.events.withColumn("k", F.row_number().over(w)).filter("k = 1").select("event_type", "event_id")


# ---- top-k and sets -------------------------------------------------------------------------------

@query("top_05_candidates", f"SELECT l_suppkey AS name, {r('avg(l_extendedprice)', 'mean')} FROM lineitem GROUP BY 1 ORDER BY avg(l_extendedprice), l_suppkey LIMIT 10")
def _(t):
    from assayer.operators.models import ranking_of
    folds = t.lineitem.groupBy(F.col("l_suppkey").alias("name"), F.lit("tree").alias("family"), F.lit("rmse").alias("metric")).agg(
        F.avg("l_extendedprice").alias("score"), F.lit("completed").alias("status"))
    return ranking_of(folds).select("name", "mean").limit(10)


@query("top_06_newest", f"SELECT run, {stamp('created', 'created')} FROM {RUNS} ORDER BY created DESC, run LIMIT 50")
def _(t):
    return registry.newest(_runs(t), "created", ["run"], 50).select("run", "created")


@query("top_07_time_order", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events")
def _(t):
    # Rows before an instant by bucketed running counts, then the place among the rows of that instant.
    at = t.events.select("event_id", F.unix_micros("ts").alias("at"))
    before = ranking.running_totals(at.groupBy("at").agg(F.count(F.lit(1)).alias("n")), "at", ["n"])
    before = before.select("at", (F.col("upto_n") - F.col("n")).alias("before"))
    inside = at.withColumn("local", F.row_number().over(Window.partitionBy("at").orderBy("event_id")))
    return inside.join(before, "at").select("event_id", (F.col("before") + F.col("local")).alias("place"))


def _hash_parts_sql(table, key, cls=None, size=0.2):
    over = f"PARTITION BY {cls} " if cls else ""
    return f"""(SELECT *, CASE WHEN rk <= ceil(n * {size}) THEN 'test' WHEN rk <= ceil(n * {size}) + ceil((n - ceil(n * {size})) * 0.2) THEN 'validation' ELSE 'train' END AS part
        FROM (SELECT *, row_number() OVER ({over}ORDER BY md5(CAST({key} AS VARCHAR))) AS rk, count(*) OVER ({over}) AS n FROM {table}))"""


@query("set_01_union", f"SELECT part, count(*) AS n FROM {_hash_parts_sql('orders', 'o_orderkey')} WHERE part <> 'test' GROUP BY 1")
def _(t):
    parted = splits.random_split(t.orders, ["o_orderkey"])
    return parted.filter("part = 'train'").unionByName(parted.filter("part = 'validation'")).groupBy("part").agg(F.count("*").alias("n"))


@query("set_02_missing_classes", f"""SELECT p.part, c.class FROM (SELECT unnest(['train', 'validation', 'test']) AS part) p, (SELECT DISTINCT o_custkey AS class FROM orders) c
    WHERE NOT EXISTS (SELECT 1 FROM {_hash_parts_sql('orders', 'o_orderkey')} x WHERE x.part = p.part AND x.o_custkey = c.class)""")
def _(t):
    return splits.missing_classes(splits.random_split(t.orders, ["o_orderkey"]), "o_custkey")


@query("set_03_missing_features", "SELECT column_name AS feature FROM (DESCRIBE orders) WHERE column_name <> 'o_orderkey'")
def _(t):
    required = P.counts(t.orders).select(F.col("column").alias("feature"))
    return required.subtract(P.counts(t.orders.select("o_orderkey")).select(F.col("column").alias("feature")))


@query("set_04_disjoint_groups", "SELECT CAST(0 AS BIGINT) AS shared")
def _(t):
    parted = splits.group_split(t.conversations, "conv_id")
    return parted.filter("part = 'train'").select("conv_id").intersect(parted.filter("part = 'test'").select("conv_id")).agg(F.count("*").alias("shared"))


# ---- scalar functions -----------------------------------------------------------------------------

@query("set_05_name_clash", """SELECT 'free' AS source, CAST(NULL AS VARCHAR) AS message, count(*) AS rows FROM orders UNION ALL
    SELECT 'taken', 'Derived date columns would overwrite: o_orderdate__month, o_orderdate__year', count(*) FILTER (WHERE o_orderdate IS NULL) FROM orders""")
def _(t):
    """Derived columns never overwrite source columns."""
    from assayer.operators.features import date_features
    rows = []
    for name, extra in (("free", []), ("taken", ["o_orderdate__month", "o_orderdate__year"])):
        table = t.orders.select("o_orderkey", "o_orderdate", *[F.lit(1).alias(c) for c in extra])
        try:
            rows.append((name, None, date_features(table, ["o_orderdate"]).count()))
        except ValueError as error:
            rows.append((name, str(error), 0))
    return t.spark.createDataFrame(rows, "source string, message string, rows long")


@query("fn_s1_text", "SELECT p_partkey, lower(trim(p_brand)) AS low, substr(p_name, 1, 5) AS cut, replace(p_name, ' ', '_') AS joined FROM part")
def _(t):
    return t.part.select("p_partkey", F.lower(text.clean("p_brand")).alias("low"), F.substring("p_name", 1, 5).alias("cut"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("joined"))


@query("fn_s1_title", "SELECT p_partkey, upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) AS title FROM part")
def _(t):
    return t.part.select("p_partkey", text.title(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("title"))


@query("fn_s2_regex", """SELECT doc_id, regexp_matches(lower(text), 'http|www') AS has_link, length(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS squashed FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.col("text").rlike("(?i)http|www").alias("has_link"),
                              F.length(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("squashed"))


@query("fn_s3_tokens", """SELECT p_partkey, CAST(len(list_distinct(string_split(p_name, ' '))) AS BIGINT) AS words,
    CAST(len(list_intersect(string_split(p_name, ' '), ['blue', 'ring', 'small'])) AS BIGINT) AS hits FROM part""")
def _(t):
    own = text.tokens("p_name")
    return t.part.select("p_partkey", F.size(own).alias("words"), F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in ("blue", "ring", "small")]))).alias("hits"))


@query("fn_s4_file_name", """SELECT page_id, CASE WHEN n = '' THEN 'dataset.csv' ELSE n END AS name FROM (
    SELECT page_id, substr(regexp_replace(string_split(url, '/')[-1], '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 255) AS n FROM pages)""")
def _(t):
    return t.pages.select("page_id", text.file_name("url").alias("name"))


@query("fn_s5_length", f"SELECT lang, {r('avg(length(text))', 'mean')}, {r('median(length(text))', 'median')} FROM documents GROUP BY 1")
def _(t):
    from assayer.operators import quantiles as q
    sized = t.documents.select("lang", F.length("text").alias("n"))
    return sized.groupBy("lang").agg(F.avg("n").alias("mean")).join(q.medians(sized, ["n"], ["lang"]).withColumnRenamed("n", "median"), "lang")


@query("fn_d1_parse", f"SELECT o_orderkey, {stamp('CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END', 'ts')} FROM orders")
def _(t):
    day = F.col("o_orderdate")
    mixed = (F.when(F.col("o_orderkey") % 7 == 0, F.lit("not a date")).when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy/MM/dd"))
             .when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(day, "yyyy-MM-dd")))
    return t.orders.select("o_orderkey", dates.parse(mixed).alias("ts"))


@query("fn_d2_parts", f"""SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS d__year, CAST(month(o_orderdate) AS DOUBLE) AS d__month, CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS d__weekday,
    {r('sin(2 * pi() * month(o_orderdate) / 12)', 'd__month_sin')}, {r('cos(2 * pi() * month(o_orderdate) / 12)', 'd__month_cos')} FROM orders""")
def _(t):
    from assayer.operators.features import date_features
    return date_features(t.orders.select("o_orderkey", F.col("o_orderdate").alias("d")), ["d"])


@query("fn_d4_truncate", f"""SELECT event_id, {stamp("date_trunc('year', ts)", 'ys')}, {stamp("date_trunc('month', ts)", 'ms')},
    {stamp("date_trunc('week', CAST(ts AS DATE) + 6)", 'w')}, {stamp("date_trunc('day', ts)", 'd')}, {stamp("date_trunc('hour', ts)", 'h')} FROM events""")
def _(t):
    return t.events.select("event_id", *[dates.period("ts", f).alias(n) for f, n in (("YS", "ys"), ("MS", "ms"), ("W-MON", "w"), ("D", "d"), ("h", "h"))])


@query("fn_d5_duration", f"""SELECT l_orderkey, {r('epoch(l_shipdate - o_orderdate)', 'seconds')}, {stamp("o_orderdate + INTERVAL 3 MONTH", 'ahead')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", (dates.seconds("l_shipdate") - dates.seconds("o_orderdate")).alias("seconds"), dates.shift(F.col("o_orderdate"), F.lit(3), "MS").alias("ahead"))


@query("fn_m1_math", f"SELECT c_custkey, {r('abs(c_acctbal)', 'a')}, {r('sqrt(abs(c_acctbal))', 's')}, {r('log2(abs(c_acctbal) + 1)', 'l')}, {r('round_even(c_acctbal, 0)', 'i')}, {r('CAST(sign(c_acctbal) AS DOUBLE)', 'g')}, {r('tanh(c_acctbal / 10000)', 't')}, {r('atanh(greatest(-0.999999, least(0.999999, c_acctbal / 10000)))', 'z')} FROM customer")
def _(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.abs(b).alias("a"), F.sqrt(F.abs(b)).alias("s"), F.log2(F.abs(b) + 1).alias("l"), F.rint(b).alias("i"), F.signum(b).alias("g"),
                             F.tanh(b / 10000).alias("t"), F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), b / 10000))).alias("z"))


@query("fn_m2_ratio", f"SELECT lang, {r('count(quality) / greatest(count(*), 1)', 'share')}, {r('sum(toxic) / greatest(sum(quality), 1)', 'odds')} FROM {LABELLED} GROUP BY 1")
def _(t):
    g = t.labelled().groupBy("lang").agg(F.count("quality").alias("q"), F.count("*").alias("n"), F.sum("toxic").alias("x"), F.sum("quality").alias("y"))
    return g.select("lang", numbers.ratio("q", "n").alias("share"), numbers.ratio("x", "y").alias("odds"))


@query("fn_a1_maps", "SELECT o_orderstatus, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    per = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).groupBy("o_orderstatus").agg(
        F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))  # a few labels per status
    return per.select("o_orderstatus", F.explode("m").alias("value", "n"))


@query("fn_j1_json", """SELECT event_id, '{"event_id":' || event_id || CASE WHEN event_id % 97 = 0 THEN '' ELSE ',"kind":"' || event_type || '"' END || '}' AS doc FROM events""")
def _(t):
    kind = F.when(F.col("event_id") % 97 != 0, F.col("event_type"))
    return t.events.select("event_id", F.to_json(F.struct("event_id", kind.alias("kind"))).alias("doc"))


@query("fn_j2_config_digest", """SELECT c_custkey, sha256('{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}') AS config_digest FROM customer""")
def _(t):
    return tables.config_digest(t.customer, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "config_digest")


@query("fn_md5_uniform", f"SELECT o_orderkey, {r(_uniform_sql('o_orderkey', 'u'), 'u')} FROM orders")
def _(t):
    return t.orders.select("o_orderkey", digests.uniform(["o_orderkey"], "u").alias("u"))
