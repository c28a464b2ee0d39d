"""Queries over calendar series and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import temporal
from assayer.plans.base import NUDGE, query, r, stamp
from assayer.plans.tables import MONTHLY

HOURLY = """(WITH b AS (SELECT date_trunc('hour', ts) AS p, avg(value) AS v, count(*) AS n FROM events GROUP BY 1)
    SELECT s.p, b.v, coalesce(b.n, 0) AS n, row_number() OVER (ORDER BY s.p) - 1 AS i FROM (SELECT unnest(generate_series((SELECT min(p) FROM b), (SELECT max(p) FROM b), INTERVAL 1 HOUR)) AS p) s LEFT JOIN b USING (p))"""


def _monthly(t):
    return temporal.calendar_series(t.orders.withColumnRenamed("o_orderpriority", "k"), "o_orderdate", "o_totalprice", ["k"])


def _hourly(t):
    return temporal.calendar_series(t.events, "ts", "value")


@query("ts_01_usable", """SELECT 'all' AS series, count(*) AS usable_rows, count(DISTINCT o_orderdate) AS distinct_dates, count(DISTINCT date_trunc('month', o_orderdate)) AS complete_periods,
    CAST(NULL AS VARCHAR) AS reason, 'completed' AS status FROM orders WHERE o_orderkey % 50 <> 0""")
def _(t):
    odd = t.orders.select(F.when(F.col("o_orderkey") % 50 == 0, F.lit("unknown")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"), "o_totalprice")
    return temporal.suitability(odd, "d", "o_totalprice").drop("periods")


FREQUENCY = """WITH d AS (SELECT DISTINCT {ts} AS ts FROM {t}), g AS (SELECT epoch(ts - lag(ts) OVER (ORDER BY ts)) / 86400 AS gap FROM d),
    f AS (SELECT (SELECT median(gap) FROM g) AS gap, floor(epoch(max(ts) - min(ts)) / 86400) AS span FROM d)
    SELECT CASE WHEN gap > 300 OR span > 60000 THEN 'YS' WHEN gap >= 25 OR span > 2000 THEN 'MS' WHEN gap >= 6 THEN 'W-MON' WHEN gap < 1 AND span * 24 <= 2000 THEN 'h' ELSE 'D' END AS frequency,
    round(gap, 6) + 0.0 AS gap_days, CAST(span AS BIGINT) AS span_days FROM f"""


@query("ts_02_frequency_orders", FREQUENCY.format(ts="o_orderdate", t="orders"))
def _(t):
    return temporal.choose_frequency(temporal.usable_rows(t.orders, "o_orderdate", "o_totalprice"), ["series"]).select("frequency", "gap_days", "span_days")


@query("ts_02_frequency_events", FREQUENCY.format(ts="ts", t="events"))
def _(t):
    return temporal.choose_frequency(temporal.usable_rows(t.events, "ts", "value"), ["series"]).select("frequency", "gap_days", "span_days")


@query("ts_03_additive", f"SELECT {stamp('''date_trunc('month', l_shipdate)''', 'period')}, {r('sum(l_quantity)', 'value', 2)} FROM lineitem GROUP BY 1", 2)
def _(t):
    return temporal.calendar_series(t.lineitem, "l_shipdate", "l_quantity").select("period", "value")


@query("ts_04_calendar", f"SELECT k, {stamp('p', 'period')}, {r(f'v + {NUDGE:.7f}', 'value', 4)}, n AS rows, i AS idx FROM {MONTHLY}", 4, NUDGE)
def _(t):
    return _monthly(t).select("k", "period", "value", "rows", "idx")


@query("ts_04_weekly", f"""WITH b AS (SELECT date_trunc('week', CAST(o_orderdate AS DATE) + 6) AS p, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1)
    SELECT {stamp('s.p', 'period')}, {r(f'v + {NUDGE:.7f}', 'value', 4)}, coalesce(n, 0) AS rows FROM (SELECT unnest(generate_series((SELECT min(p) FROM b), (SELECT max(p) FROM b), INTERVAL 7 DAY)) AS p) s LEFT JOIN b USING (p)""", 4, NUDGE)
def _(t):
    return temporal.calendar_series(t.orders, "o_orderdate", "o_totalprice", frequency="W-MON").select("period", "value", "rows")


@query("ts_05_skip_rules", """SELECT c_nationkey AS k, 'skipped' AS status, 'fewer than eight distinct dates' AS reason FROM (SELECT c_nationkey, count(DISTINCT d) AS n FROM (SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey % 5 AS d FROM customer) GROUP BY 1) WHERE n < 8""")
def _(t):
    dated = t.customer.select(F.col("c_nationkey").cast("long").alias("k"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("c_custkey") % 5).cast("int")).cast("timestamp").alias("d"), "c_acctbal")
    return temporal.suitability(dated, "d", "c_acctbal", ["k"], "D").select("k", "status", "reason")


@query("ts_06_slope", f"SELECT k, {r('regr_slope(v, i)', 'slope_per_period', 4)}, CASE WHEN regr_slope(v, i) > 0 THEN 'positive' WHEN regr_slope(v, i) < 0 THEN 'negative' ELSE 'flat' END AS trend FROM {MONTHLY} GROUP BY 1", 4)
def _(t):
    return temporal.trend(_monthly(t)).select("k", "slope_per_period", "trend")


@query("ts_07_growth", f"""WITH x AS (SELECT i, v, lag(v) OVER (ORDER BY i) AS prior, max(i) OVER () AS last FROM {HOURLY}) SELECT {r('CASE WHEN prior <> 0 THEN (v - prior) / abs(prior) * 100 END', 'latest_growth_pct')} FROM x WHERE i = last""")
def _(t):
    return temporal.trend(_hourly(t)).select("latest_growth_pct")


@query("ts_08_rolling", f"SELECT {stamp('p', 'period')}, {r('CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END', 'rolling_average')} FROM {HOURLY} WINDOW w AS (ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(t):
    return temporal.rolling(_hourly(t)).select("period", "rolling_average")


@query("ts_09_residuals", f"""WITH x AS (SELECT p, i, v, v - CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END AS e FROM {HOURLY} WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
    m AS (SELECT median(e) AS c, 1.4826 * mad(e) AS s FROM x) SELECT {stamp('p', 'period')}, {r('e', 'residual')} FROM x, m WHERE s > 0 AND abs(e - c) > 3 * s ORDER BY i LIMIT 20""")
def _(t):
    return temporal.residual_anomalies(_hourly(t)).select("period", "residual")


@query("ts_10_season", f"""WITH l AS (SELECT k, regr_slope(v, i) AS a, regr_intercept(v, i) AS b, count(*) AS n, count(v) = count(*) AS whole FROM {MONTHLY} GROUP BY 1), d AS (SELECT k, i, l.n AS n, l.whole, v - (b + a * i) AS e FROM {MONTHLY} m JOIN l USING (k)),
    g AS (SELECT k, n, whole, e, lag(e, 12) OVER (PARTITION BY k ORDER BY i) AS f FROM d) SELECT k, n AS periods, CAST(12 AS BIGINT) AS lag, {r('CASE WHEN bool_and(whole) THEN corr(e, f) END', 'autocorrelation', 5)} FROM g GROUP BY k, n""", 5)
def _(t):
    return temporal.seasonality(_monthly(t)).select("k", "periods", "lag", "autocorrelation")


@query("ts_11_change_points", f"""WITH a AS (SELECT p, i, CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END AS a FROM {HOURLY} WINDOW w AS (ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    x AS (SELECT p, i, abs(a - lag(a) OVER (ORDER BY i)) AS e FROM a), m AS (SELECT median(e) AS c, 1.4826 * mad(e) AS s FROM x)
    SELECT row_number() OVER (ORDER BY e DESC, i) AS place, {stamp('p', 'period')}, {r('e', 'rolling_change')} FROM x, m WHERE s > 0 AND e > c + 3 * s ORDER BY e DESC, i LIMIT 5""")
def _(t):
    return temporal.change_points(_hourly(t)).select("place", "period", "rolling_change")


@query("top_01_change_points", f"""WITH a AS (SELECT k, p, i, CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END AS a FROM {MONTHLY} WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    x AS (SELECT k, p, i, abs(a - lag(a) OVER (PARTITION BY k ORDER BY i)) AS e FROM a), m AS (SELECT k, median(e) AS c, 1.4826 * mad(e) AS s FROM x GROUP BY 1),
    f AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY e DESC, i) AS place FROM x JOIN m USING (k) WHERE s > 0 AND e > c + 3 * s) SELECT k, place, {stamp('p', 'period')} FROM f WHERE place <= 5""")
def _(t):
    return temporal.change_points(_monthly(t)).select("k", "place", "period")


GATE = f"(SELECT k, p, v, i, count(*) OVER (PARTITION BY k) AS m FROM {MONTHLY} QUALIFY count(*) OVER (PARTITION BY k) >= 24 AND count(v) OVER (PARTITION BY k) = count(*) OVER (PARTITION BY k))"
SES = f"""RECURSIVE g AS {GATE}, s AS (SELECT k, i, v AS level FROM g WHERE i = 0 UNION ALL SELECT g.k, g.i, 0.3 * g.v + 0.7 * s.level FROM s JOIN g ON g.k = s.k AND g.i = s.i + 1),
    f AS (SELECT g.k, g.p, g.i, g.v, g.m, lag(g.v) OVER w AS naive, avg(g.v) OVER (PARTITION BY g.k ORDER BY g.i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ma, lag(s.level) OVER w AS ses,
        CASE WHEN g.i < floor(g.m * 0.6) THEN 'train' WHEN g.i < floor(g.m * 0.8) THEN 'validation' ELSE 'test' END AS part FROM g JOIN s ON s.k = g.k AND s.i = g.i WINDOW w AS (PARTITION BY g.k ORDER BY g.i)),
    e AS (SELECT k, part, 0 AS o, 'Naive' AS model, v - naive AS e FROM f UNION ALL SELECT k, part, 1, 'Moving average', v - ma FROM f UNION ALL SELECT k, part, 2, 'Exponential smoothing', v - ses FROM f),
    q AS (SELECT k, o, model, part, count(*) AS periods, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM e WHERE part <> 'train' GROUP BY ALL),
    b AS (SELECT k, arg_min(model, (mae, o)) AS best FROM q WHERE part = 'validation' GROUP BY 1)"""


@query("ts_12_gate", f"SELECT k, count(*) AS periods FROM {MONTHLY} GROUP BY 1 HAVING count(*) >= 24 AND count(v) = count(*)")
def _(t):
    return temporal.one_step_forecasts(_monthly(t)).groupBy("k").agg(F.count("*").alias("periods"))


@query("ts_13_one_step", f"WITH {SES} SELECT k, {stamp('p', 'period')}, {', '.join(r(f'{c} + {NUDGE:.7f}', n, 3) for c, n in (('naive', 'naive'), ('ma', 'moving'), ('ses', 'smoothed')))}, part FROM f", 3, NUDGE)
def _(t):
    f = temporal.one_step_forecasts(_monthly(t))
    return f.select("k", "period", F.col("Naive").alias("naive"), F.col("`Moving average`").alias("moving"), F.col("`Exponential smoothing`").alias("smoothed"), "part")


@query("ts_16_evaluation", f"WITH {SES} SELECT q.k, model, part, periods, {r('mae', 'mae', 3)}, {r('rmse', 'rmse', 3)}, model = best AS selected FROM q JOIN b ON q.k = b.k", 3)
def _(t):
    return temporal.evaluate_forecasts(_monthly(t))


@query("ts_17_winner", f"WITH {SES} SELECT q.k, best AS selected_model, {r('''max(mae) FILTER (WHERE part = 'validation')''', 'validation_mae', 3)}, {r('''max(mae) FILTER (WHERE part = 'test')''', 'test_mae', 3)}, {r('''max(rmse) FILTER (WHERE part = 'test')''', 'test_rmse', 3)} FROM q JOIN b ON q.k = b.k AND model = best GROUP BY ALL", 3)
def _(t):
    return temporal.forecast_summary(_monthly(t))


@query("ts_18_forecast", f"""WITH {SES}, z AS (SELECT g.k, max_by(g.v, g.i) AS last, max(g.p) AS p FROM g GROUP BY 1), l AS (SELECT k, max_by(level, i) AS level FROM s GROUP BY 1),
    t3 AS (SELECT k, list(v ORDER BY i DESC)[1:3] AS h FROM g GROUP BY 1),
    m AS (SELECT k, 0 AS step, h[3] AS x, h[2] AS y, h[1] AS w FROM t3 UNION ALL SELECT k, step + 1, y, w, (x + y + w) / 3 FROM m WHERE step < 6)
    SELECT b.k, m.step, {stamp("z.p + to_months(CAST(m.step AS INTEGER))", 'period')}, {r("CASE best WHEN 'Naive' THEN last WHEN 'Moving average' THEN m.w ELSE level END", 'value', 3)} FROM b JOIN z USING (k) JOIN l USING (k) JOIN m USING (k) WHERE m.step > 0""".replace("SELECT b.k, m.step,", "SELECT b.k, CAST(m.step AS BIGINT) AS step,"), 3)
def _(t):
    return temporal.forecast(_monthly(t)).select("k", "step", "period", "value")


@query("ts_19_points", f"SELECT {stamp('p', 'period')}, {r('v', 'value')}, n AS rows FROM {HOURLY} ORDER BY p DESC LIMIT 400")
def _(t):
    return temporal.points(_hourly(t)).select("period", "value", "rows")


@query("ts_20_summary", f"""SELECT k, count(*) AS periods, count(*) - count(v) AS missing_periods, any_value(d.dup) AS duplicate_dates FROM {MONTHLY} JOIN (SELECT o_orderpriority AS k, count(*) - count(DISTINCT o_orderdate) AS dup FROM orders GROUP BY 1) d USING (k) GROUP BY 1""")
def _(t):
    s = temporal.temporal_summary(t.orders.withColumnRenamed("o_orderpriority", "k"), "o_orderdate", "o_totalprice", ["k"])
    return s.select("k", "periods", "missing_periods", "duplicate_dates")
