"""Queries over tests, effect sizes, evidence rules, leakage and anomalies."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from assayer.functions import numbers, tails
from assayer.operators import anomaly, inference, leakage, ranking
from assayer.operators import evidence as E
from assayer.operators import profile as P
from assayer.plans.base import LABELLED, LINE_KEY, query, r, union_all

PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_tax")]


def _strength_sql(effect: str, cuts=(0.1, 0.3, 0.5)) -> str:
    low, mid, high = cuts
    return f"CASE WHEN abs({effect}) >= {high} THEN 'large' WHEN abs({effect}) >= {mid} THEN 'moderate' WHEN abs({effect}) >= {low} THEN 'small' ELSE 'negligible' END"


@query("st_02_skip_rule", f"""SELECT d.lang AS lang, count(*) FILTER (WHERE quality IS NOT NULL) AS n, count(*) FILTER (WHERE quality IS NOT NULL) >= 8
    AND min(quality) < max(quality) AND min(n_chars) FILTER (WHERE quality IS NOT NULL) < max(n_chars) FILTER (WHERE quality IS NOT NULL) AS tested FROM {LABELLED} d GROUP BY 1""")
def _(t):
    base, out = t.labelled(), None
    for row in base.select("lang").distinct().orderBy("lang").collect():  # four languages
        one = inference.pearson(base.filter(F.col("lang") == row["lang"]), [("quality", "n_chars")]).select(
            F.lit(row["lang"]).alias("lang"), "n", ((F.col("n") >= 8) & F.col("varies")).alias("tested"))
        out = one if out is None else out.unionByName(one)
    return out


@query("st_03_pearson", union_all(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) AS n, {r(f'corr({a}, {b})', 'coefficient')}, {r(f'corr({a}, {b}) * sqrt((count(*) - 2) / (1 - corr({a}, {b}) ^ 2))', 't')} FROM lineitem" for a, b in PAIRS))
def _(t):
    return inference.pearson(t.lineitem, PAIRS).select("left", "right", "n", "coefficient", "t")


@query("st_04_fisher_z", union_all(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {r(f'tanh(atanh(corr({a}, {b})) - 1.96 / sqrt(count(*) - 3))', 'lower')}, {r(f'tanh(atanh(corr({a}, {b})) + 1.96 / sqrt(count(*) - 3))', 'upper')} FROM lineitem" for a, b in PAIRS))
def _(t):
    return inference.pearson(t.lineitem, PAIRS).select("left", "right", "lower", "upper")


def _rank_sql(value, table, extra="", where=""):
    return f"SELECT {extra}rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0 AS k FROM {table} {where}"


@query("st_05_spearman", f"""WITH x AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a,
    rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b FROM orders)
    SELECT count(*) AS n, {r('corr(a, b)', 'coefficient')}, {r('corr(a, b) * sqrt((count(*) - 2) / (1 - corr(a, b) ^ 2))', 't')} FROM x""")
def _(t):
    return inference.spearman(t.orders, [("o_totalprice", "o_custkey")], ["o_totalprice", "o_custkey"]).select("n", "coefficient", "t")


@query("st_05_spearman_gaps", f"""WITH c AS (SELECT n_chars AS x, quality AS y FROM {LABELLED} WHERE quality IS NOT NULL), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a,
    rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM c) SELECT count(*) AS n, {r('corr(a, b)', 'coefficient')} FROM k""")
def _(t):
    return inference.spearman(t.labelled(), [("n_chars", "quality")]).select("n", "coefficient")


def _chi_sql(a, b, table, columns):
    return f"""WITH o AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL), ra AS (SELECT a, sum(n) AS m FROM o GROUP BY 1), cb AS (SELECT b, sum(n) AS m FROM o GROUP BY 1),
    g AS (SELECT ra.a, cb.b, coalesce(o.n, 0) AS o, ra.m * cb.m / (SELECT CAST(sum(n) AS DOUBLE) FROM o) AS e FROM ra CROSS JOIN cb LEFT JOIN o ON o.a = ra.a AND o.b = cb.b),
    s AS (SELECT sum((o - e) ^ 2 / e) AS x, CAST(sum(o) AS BIGINT) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c, min(e) AS m, avg(CAST(e < 5 AS INTEGER)) AS low FROM g)
    SELECT {columns} FROM s"""


FLAGS = ("l_returnflag", "l_linestatus", "lineitem")


@query("st_06_chi_square", _chi_sql(*FLAGS, f"n, {r('x', 'statistic')}, CAST((r - 1) * (c - 1) AS DOUBLE) AS df, {r('exp(-x / 2)', 'p_value')}"))
def _(t):
    return inference.chi_square(inference.contingency(t.lineitem, [FLAGS[:2]])).select("n", "statistic", "df", tails.chi_square_p("statistic", "df").alias("p_value"))


@query("st_07_sparse", _chi_sql("lang", "source", "documents", f"{r('m', 'expected_min')}, {r('low', 'low_expected_share')}, low > 0.2 OR m < 1 AS sparse_expected"))
def _(t):
    return inference.chi_square(inference.contingency(t.documents, [("lang", "source")])).select("expected_min", "low_expected_share", "sparse_expected")


def _log_choose(n, k):
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


@query("st_08_fisher", f"""WITH t AS (SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS a, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS b,
    count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS c, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS d FROM labels),
    k AS (SELECT t.*, unnest(generate_series(greatest(0, a + c - (c + d)), least(a + b, a + c))) AS k FROM t),
    p AS (SELECT k, a, {_log_choose('(a + b)', 'k')} + {_log_choose('(c + d)', '(a + c - k)')} - {_log_choose('(a + b + c + d)', '(a + c)')} AS lp FROM k)
    SELECT {r('sum(exp(lp)) FILTER (WHERE lp <= (SELECT lp FROM p WHERE k = a) + 1e-7)', 'p_value')} FROM p""")
def _(t):
    return inference.fisher_exact(inference.contingency(t.labels, [("quality", "toxic")])).select("p_value")


@query("st_09_cramers_v", _chi_sql(*FLAGS, f"{r('sqrt(x / (n * (least(r, c) - 1)))', 'cramers_v')}, {_strength_sql('sqrt(x / (n * (least(r, c) - 1)))')} AS strength"))
def _(t):
    chi = inference.chi_square(inference.contingency(t.lineitem, [FLAGS[:2]]))
    return chi.select("cramers_v", numbers.strength("cramers_v", F.lit("cramers_v")).alias("strength"))


@query("st_10_payload", """SELECT string_agg(a, ',' ORDER BY a) AS row_labels, 'F,O' AS column_labels, string_agg(f || '/' || o, ' ' ORDER BY a) AS counts FROM (
    SELECT l_returnflag AS a, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1)""")
def _(t):
    p = inference.contingency_payload(inference.contingency(t.lineitem, [FLAGS[:2]]))
    return p.select(F.array_join("row_labels", ",").alias("row_labels"), F.array_join("column_labels", ",").alias("column_labels"),
                    F.array_join(F.transform("counts", lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "/")), " ").alias("counts"))


GROUPS = "SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v, skewness(l_extendedprice) AS k FROM lineitem GROUP BY 1"


@query("st_11_groups", "SELECT l_returnflag AS label, count(*) AS n, count(*) OVER () AS k FROM lineitem GROUP BY 1")
def _(t):
    return inference.eligible_groups(inference.group_rows(t.lineitem, ["l_returnflag"], ["l_quantity"])).select("label", "n", "k")


@query("st_12_normality", "SELECT event_type IS NOT NULL AS a, bool_and(abs(k) < 2) AS normal FROM (SELECT event_type, skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS k FROM events GROUP BY 1) GROUP BY 1")
def _(t):
    return inference.normality(inference.group_rows(t.events, ["event_type"], ["value"])).select(F.lit(True).alias("a"), "normal")


@query("st_12_shapiro")
def _(t):
    return inference.shapiro_groups(t.events, [("event_type", "value")], ["event_id"]).select("label", "shapiro_p")


TWO = """(SELECT max(n) FILTER (WHERE g = 'F') AS n1, max(n) FILTER (WHERE g = 'O') AS n2, max(m) FILTER (WHERE g = 'F') AS m1, max(m) FILTER (WHERE g = 'O') AS m2,
    max(v) FILTER (WHERE g = 'F') AS v1, max(v) FILTER (WHERE g = 'O') AS v2 FROM (SELECT l_linestatus AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1))"""


def _two(t):
    return inference.two_groups(inference.group_rows(t.lineitem, ["l_linestatus"], ["l_extendedprice"]))


@query("st_13_cohens_d", f"SELECT {r('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))', 'cohens_d')} FROM {TWO}")
def _(t):
    return _two(t).select("cohens_d")


@query("st_14_variance_ratio", f"SELECT {r('greatest(v1, v2) / least(v1, v2)', 'variance_ratio')}, greatest(v1, v2) / least(v1, v2) <= 1.15 AS alike FROM {TWO}")
def _(t):
    return _two(t).select("variance_ratio", (F.col("variance_ratio") <= 1.15).alias("alike"))


@query("st_15_t_tests", f"""SELECT {r('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))', 'student_t')}, {r('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)', 'welch_t')},
    {r('(v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1))', 'welch_df', 3)} FROM {TWO}""")
def _(t):
    return _two(t).select("student_t", "welch_t", F.round("welch_df", 3).alias("welch_df"))


# Far out in the degrees of freedom the t quantile is an expansion in 1 / d around the normal one.
_Z = 1.959963984540054
_T_FAR = f"({_Z} + {(_Z**3 + _Z) / 4!r} / d + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / (d * d) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / (d * d * d))"


@query("st_16_interval", f"""SELECT {r('m1 - m2', 'mean_difference', 4)}, {r(f'm1 - m2 - {_T_FAR} * se', 'difference_low', 4)}, {r(f'm1 - m2 + {_T_FAR} * se', 'difference_high', 4)} FROM (SELECT *, sqrt(v1 / n1 + v2 / n2) AS se,
    (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS d FROM {TWO})""", 4)
def _(t):
    return inference.mean_difference_interval(_two(t)).select("mean_difference", "difference_low", "difference_high")


def _simpson(f: str, low: str, high: str, steps: int = 4000) -> str:
    """Integral of ``f`` (in x) by Simpson's rule, as a scalar of SQL."""
    at = f"({low} + ({high} - ({low})) * i / {steps}.0)"
    return f"(SELECT sum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f.replace('@', at)}) * ({high} - ({low})) / {3 * steps} FROM range({steps + 1}) g(i))"


_NATIONS = """(SELECT c_nationkey AS nation, (avg(c_acctbal) - 4000) / sqrt(var_samp(c_acctbal) / count(*)) AS t, CAST(count(*) - 1 AS DOUBLE) AS d, var_samp(c_acctbal) / (SELECT var_samp(c_acctbal) FROM customer) AS f,
    (SELECT CAST(count(*) - 1 AS DOUBLE) FROM customer) AS e FROM customer GROUP BY 1 HAVING count(*) > 3)"""


def _nations(t):
    c = t.customer
    whole = c.agg(F.var_samp("c_acctbal").alias("v"), F.count("*").alias("n")).first()
    n = F.count("*").cast("double")
    return c.groupBy(F.col("c_nationkey").alias("nation")).agg(((F.avg("c_acctbal") - 4000) / F.sqrt(F.var_samp("c_acctbal") / n)).alias("t"), (n - 1).alias("d"), (F.var_samp("c_acctbal") / F.lit(whole["v"])).alias("f"),
                                                               F.lit(float(whole["n"] - 1)).alias("e")).filter("d > 2")


# With x = sqrt(d) tan(angle) the density of t becomes a power of the cosine; F likewise with both functions.
@query("fn_m3_t_tail", f"SELECT nation, {r('a / b', 'p_value')} FROM (SELECT nation, {_simpson('power(cos(@), d - 1)', 'atan(abs(t) / sqrt(d))', 'pi() / 2')} AS a, {_simpson('power(cos(@), d - 1)', '0.0', 'pi() / 2')} AS b FROM {_NATIONS})")
def _(t):
    return _nations(t).select("nation", tails.t_p(F.col("t"), F.col("d")).alias("p_value"))


_F_DENSITY = "power(sin(@), d - 1) * power(cos(@), e - 1)"


@query("fn_m3_f_tail", f"SELECT nation, {r('a / b', 'p_value')} FROM (SELECT nation, {_simpson(_F_DENSITY, 'asin(sqrt(d * f / (d * f + e)))', 'pi() / 2')} AS a, {_simpson(_F_DENSITY, '0.0', 'pi() / 2')} AS b FROM {_NATIONS})")
def _(t):
    return _nations(t).select("nation", tails.f_p(F.col("f"), F.col("d"), F.col("e")).alias("p_value"))


@query("fn_m3_t_quantile", f"""WITH g AS (SELECT n_nationkey AS nation, n_nationkey + 1 AS d, i, i * pi() / 2 / 20000 AS angle, power(cos(i * pi() / 2 / 20000), n_nationkey) AS f FROM nation, range(20001) r(i)),
    c AS (SELECT *, coalesce(sum(f + before) OVER (PARTITION BY nation ORDER BY i), 0) AS upto FROM (SELECT *, lag(f, 1, 0.0) OVER (PARTITION BY nation ORDER BY i) AS before FROM g) WHERE i > 0),
    h AS (SELECT *, 0.95 * max(upto) OVER (PARTITION BY nation) AS want, lag(upto, 1, 0.0) OVER (PARTITION BY nation ORDER BY i) AS under FROM c)
    SELECT nation, {r('tan(angle - (upto - want) / (upto - under) * pi() / 2 / 20000) * sqrt(d)', 'quantile', 4)} FROM h WHERE upto >= want AND under < want""", 4)
def _(t):
    return t.nation.select(F.col("n_nationkey").alias("nation"), tails.t_975((F.col("n_nationkey") + 1).cast("double")).alias("quantile"))


MW = """(WITH x AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS g, c_acctbal AS v FROM customer), k AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM x)
    SELECT sum(k) FILTER (WHERE g = 'a') AS r1, CAST(count(*) FILTER (WHERE g = 'a') AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE g = 'b') AS DOUBLE) AS n2 FROM k)"""


@query("st_17_mann_whitney", f"SELECT CAST(n1 AS BIGINT) AS n1, {r('r1 - n1 * (n1 + 1) / 2', 'statistic')}, {r('2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) - 1', 'rank_biserial')} FROM {MW}")
def _(t):
    halves = t.customer.withColumn("g", F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b"))
    return inference.mann_whitney(inference.rank_rows(halves, [("g", "c_acctbal")])).select("n1", "statistic", "rank_biserial")


def _anova_sql(source, columns):
    return f"""WITH x AS ({source}), g AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM x GROUP BY 1),
    a AS (SELECT sum(n * (m - (SELECT avg(v) FROM x)) ^ 2) AS b, sum((n - 1) * s) AS w, count(*) AS k, CAST(sum(n) AS BIGINT) AS n FROM g) SELECT {columns} FROM a"""


F_VALUE = r("(b / (k - 1)) / (w / (n - k))", "statistic")


@query("st_18_levene", _anova_sql("SELECT l_returnflag AS g, abs(l_extendedprice - med) AS v FROM lineitem JOIN (SELECT l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY 1) USING (l_returnflag)", f"k, n, {F_VALUE}"))
def _(t):
    return inference.levene(t.lineitem, ["l_returnflag"], ["l_extendedprice"]).select("k", "n", "statistic")


@query("st_19_anova", _anova_sql("SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem", f"k, n, {F_VALUE}, {r('b / (b + w)', 'eta_squared', 9)}").replace(", 9) + 0.0 AS eta", ", 6) + 0.0 AS eta"))
def _(t):
    return inference.anova(inference.group_rows(t.lineitem, ["l_returnflag"], ["l_extendedprice"])).select("k", "n", "statistic", "eta_squared")


def _kruskal_sql(g, v, table, p):
    return f"""WITH x AS (SELECT {g} AS g, {v} AS v FROM {table}), k AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k, CAST(count(*) OVER (PARTITION BY v) AS DOUBLE) AS t FROM x),
    s AS (SELECT sum(rs ^ 2 / n) AS q, CAST(sum(n) AS DOUBLE) AS n, count(*) AS g, sum(tie) AS tie FROM (SELECT g, sum(k) AS rs, CAST(count(*) AS DOUBLE) AS n, sum(t * t - 1) AS tie FROM k GROUP BY 1)),
    h AS (SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n ^ 3 - n)) AS h, n, g FROM s)
    SELECT g AS k, CAST(n AS BIGINT) AS n, {r('h', 'statistic', 5)}, {r('greatest(0.0, (h - g + 1) / (n - g))', 'epsilon_squared', 5)}, {r(p, 'p_value', 5)} FROM h"""


@query("st_20_kruskal", _kruskal_sql("l_returnflag", "l_extendedprice", "lineitem", "exp(-h / 2)"), 5)
def _(t):
    h = inference.kruskal(inference.rank_rows(t.lineitem, [("l_returnflag", "l_extendedprice")]))
    return h.select("k", "n", "statistic", "epsilon_squared", tails.chi_square_p("statistic", "df").alias("p_value"))


@query("st_20_kruskal_ties", _kruskal_sql("event_type", "user_id", "events", "exp(-h / 2) * (1 + h / 2)"), 5)
def _(t):
    h = inference.kruskal(inference.rank_rows(t.events, [("event_type", "user_id")], ranking.SMALL_ROWS + 1))
    return h.select("k", "n", "statistic", "epsilon_squared", tails.chi_square_p("statistic", "df").alias("p_value"))


CHOSEN = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]


def _tests(t, columns=CHOSEN):
    li = t.lineitem
    return inference.test_pairs(li, P.profile(li), columns, key=LINE_KEY)


@query("st_21_all_pairs")
def _(t):
    return _tests(t).drop("notes")


@query("st_21_methods", """SELECT * FROM (VALUES ('l_quantity', 'l_extendedprice', 'Pearson correlation'), ('l_quantity', 'l_extendedprice', 'Spearman correlation'), ('l_quantity', 'l_discount', 'Pearson correlation'),
    ('l_quantity', 'l_discount', 'Spearman correlation'), ('l_extendedprice', 'l_discount', 'Pearson correlation'), ('l_extendedprice', 'l_discount', 'Spearman correlation'),
    ('l_returnflag', 'l_quantity', 'One-way ANOVA'), ('l_returnflag', 'l_extendedprice', 'One-way ANOVA'), ('l_returnflag', 'l_discount', 'One-way ANOVA'), ('l_linestatus', 'l_quantity', 'Student''s t-test'),
    ('l_linestatus', 'l_extendedprice', 'Student''s t-test'), ('l_linestatus', 'l_discount', 'Student''s t-test'), ('l_returnflag', 'l_linestatus', 'Chi-square association')) v("left", "right", method)""")
def _(t):
    return _tests(t).select("left", "right", "method")


@query("st_22_fdr", f"""WITH g AS (SELECT c_nationkey AS id, exp(-abs(avg(c_acctbal) - 4500) / 100) AS p FROM customer GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rk, count(*) OVER () AS m FROM g)
    SELECT CAST(id AS BIGINT) AS id, {r('least(1.0, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING))', 'q_value')}, least(1.0, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) < 0.05 AS significant, m AS tests_in_family FROM k""")
def _(t):
    p = t.customer.groupBy(F.col("c_nationkey").alias("id")).agg(F.exp(-F.abs(F.avg("c_acctbal") - 4500) / 100).alias("p_value"))
    return inference.fdr(p).select("id", "q_value", "significant", "tests_in_family")


@query("st_23_strength", f"""SELECT o_orderkey, {_strength_sql('o_totalprice / 500000')} AS correlation, {_strength_sql('o_totalprice / 500000', (0.2, 0.5, 0.8))} AS d, {_strength_sql('o_totalprice / 500000', (0.01, 0.06, 0.14))} AS eta FROM orders""")
def _(t):
    e = F.col("o_totalprice") / 500000
    return t.orders.select("o_orderkey", numbers.strength(e, F.lit("correlation")).alias("correlation"), numbers.strength(e, F.lit("cohens_d")).alias("d"), numbers.strength(e, F.lit("eta_squared")).alias("eta"))


@query("st_24_notes", "SELECT count(*) * 0 + 13 AS tests, true AS exploratory, true AS temporal, false AS sampled FROM region")
def _(t):
    tests = _tests(t)
    has = lambda w: F.bool_and(F.exists("notes", lambda n: n.startswith(w)))
    return tests.agg(F.count("*").alias("tests"), has("Exploratory").alias("exploratory"), has("Temporal").alias("temporal"), has("Computed on").alias("sampled"))


_MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber"]


@query("st_25_matrix", union_all(f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})', 'value')} FROM lineitem" for a, b in itertools.combinations(_MATRIX, 2)))
def _(t):
    """All pairs of all numeric columns."""
    li = t.lineitem.select(*LINE_KEY, *[c for c in _MATRIX if c not in LINE_KEY])
    found = inference.association_matrix(inference.test_pairs(li, P.profile(li), _MATRIX, key=LINE_KEY))
    return found.filter(F.col("method") == "Pearson correlation").select("x", "y", "value")


@query("st_26_nominal", "SELECT 'quality' AS \"left\", 'toxic' AS \"right\", count(*) AS n FROM labels")
def _(t):
    got = inference.test_pairs(t.labels, P.profile(t.labels, ["doc_id"]), ["quality", "toxic"], ["quality", "toxic"], ["doc_id"])
    return got.select("left", "right", "n")


@query("st_27_hypotheses", f"""SELECT 'l_quantity goes together with l_extendedprice.' AS hypothesis, 'inconclusive' AS status, 'LOW' AS confidence, {r('corr(l_quantity, l_extendedprice)', 'effect')} FROM lineitem""")
def _(t):
    h = E.hypotheses(E.evidence(E.from_tests(_tests(t, ["l_quantity", "l_extendedprice"]))))
    return h.filter(F.col("method") == "Pearson correlation").select("hypothesis", "status", "confidence", "effect")


@query("st_28_provenance", "SELECT CAST(2 AS BIGINT) AS tests, 'completed' AS status, 'e001,e002' AS evidence_ids FROM lineitem LIMIT 1")
def _(t):
    return E.group_provenance(E.evidence(E.from_tests(_tests(t, ["l_quantity", "l_extendedprice", "l_returnflag"]).filter("kind = 'group_difference'"))))


# ---- evidence rules -------------------------------------------------------------------------------

def _made(t):
    """Evidence rows made from orders: effects, q-values and sizes follow from its columns."""
    o, price = t.orders, F.col("o_totalprice")
    rows = E.shaped(
        o, kind=F.when(F.col("o_orderstatus") == "F", "association").when(F.col("o_orderstatus") == "O", "group_difference").otherwise("temporal"),
        title=F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), method=F.lit("rule"), left=F.lit("a"), right=F.lit("b"), status=F.lit("completed"),
        sample_rows=F.col("o_custkey"), q_value=price / 5_000_000, significant=price / 5_000_000 < 0.05, effect=price / 500_000, measure=F.lit("correlation"),
        strength=numbers.strength(price / 500_000, F.lit("correlation")), sparse=F.col("o_orderkey") % 11 == 0, dependent=F.col("o_orderkey") % 7 == 0,
        growth_pct=price / 10_000 - 20, trend=F.lit("flat"), frequency=F.lit("MS"), periods=F.col("o_custkey"), missing_periods=F.col("o_orderkey") % 2)
    return rows.withColumn("place", F.regexp_extract("title", r"(\d+)", 1).cast("int")).withColumn("id", F.format_string("e%03d", "place"))


MADE = f"""(SELECT o_orderkey AS place, 'e' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(3, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS id,
    CASE o_orderstatus WHEN 'F' THEN 'association' WHEN 'O' THEN 'group_difference' ELSE 'temporal' END AS kind, o_custkey AS n, o_totalprice / 5000000 AS q,
    {_strength_sql('o_totalprice / 500000')} AS strength, o_orderkey % 11 = 0 AS sparse, o_orderkey % 7 = 0 AS dependent, o_totalprice / 10000 - 20 AS growth, o_custkey AS periods, o_orderkey % 2 AS missing FROM orders)"""
GRADED = f"""(SELECT *, CASE WHEN kind = 'temporal' THEN CASE WHEN missing = 0 AND periods >= 24 THEN 'MEDIUM' ELSE 'LOW' END
    WHEN q < 0.01 AND strength IN ('moderate', 'large') AND n >= 100 AND NOT sparse AND NOT dependent THEN 'HIGH' WHEN q < 0.05 AND strength <> 'negligible' AND n >= 30 AND NOT sparse THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    CASE WHEN kind = 'temporal' THEN CASE WHEN abs(growth) >= 10 THEN 'high' ELSE 'medium' END WHEN strength = 'large' THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN kind = 'temporal' THEN 'trend' ELSE kind END AS type FROM {MADE} WHERE kind = 'temporal' OR q < 0.05)"""
EV_ORDER = "CASE severity WHEN 'high' THEN 0 ELSE 1 END, CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, place"


@query("ev_01_ids", "SELECT 'e' || lpad(CAST(row_number() OVER (ORDER BY o_orderpriority) AS VARCHAR), 3, '0') AS id, o_orderpriority AS title FROM orders GROUP BY 2")
def _(t):
    one = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return E.evidence(E.shaped(one, kind=F.lit("dataset"), title=F.col("o_orderpriority"), left=F.col("o_orderpriority"), status=F.lit("completed"))).select("id", "title")


@query("ev_02_findings", f"SELECT id AS evidence_id, type, severity FROM {GRADED}")
def _(t):
    return E.findings(_made(t), None).select("evidence_id", "type", "severity")


@query("ev_03_confidence", f"SELECT id AS evidence_id, confidence FROM {GRADED}")
def _(t):
    return E.findings(_made(t), None).select("evidence_id", "confidence")


@query("ev_04_order", f"SELECT id AS evidence_id, severity, confidence FROM {GRADED} ORDER BY {EV_ORDER} LIMIT 16")
def _(t):
    return E.findings(_made(t), 16).select("evidence_id", "severity", "confidence")


@query("ev_05_recommendations", f"SELECT type, id AS evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY {EV_ORDER}) AS k FROM {GRADED}) WHERE k = 1")
def _(t):
    return E.recommendations(E.findings(_made(t), None)).select("type", "evidence_id")


@query("jn_04_finding_evidence", f"SELECT id AS evidence_id, q IS NOT NULL AS has_q, severity FROM {GRADED}")
def _(t):
    made = _made(t)
    return E.findings(made, None).join(made.select(F.col("id").alias("evidence_id"), F.col("q_value").isNotNull().alias("has_q")), "evidence_id").select("evidence_id", "has_q", "severity")


@query("ev_07_analyze")
def _(t):
    """The whole analysis over all columns, with the review of a target."""
    from assayer.plans.analysis import analyze
    return analyze(t.orders, ["o_orderkey"], target="o_orderstatus").findings


@query("ev_08_leaking_names", "SELECT count(*) FILTER (WHERE o_orderkey < 0) + 2 AS flags, 'o_status_copy, target_status' AS features FROM orders")
def _(t):
    """The finding names the columns that may carry the outcome."""
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", F.col("o_orderstatus").alias("o_status_copy"), F.concat(F.lit("s"), "o_orderstatus").alias("target_status"))
    flags = leakage.leakage(o, "o_orderstatus", P.profile(o, ["o_orderkey"]))
    return E.evidence(E.from_leakage(flags, "o_orderstatus")).select("flags", "features")


# ---- leakage --------------------------------------------------------------------------------------

@query("lk_02_correlation", f"""SELECT 'net' AS feature, count(*) AS n, {r('corr(l_extendedprice * 0.9 + 3, l_extendedprice)', 'correlation')} FROM lineitem UNION ALL SELECT 'l_quantity', count(*), {r('corr(l_quantity, l_extendedprice)', 'correlation')} FROM lineitem""")
def _(t):
    li = t.lineitem.withColumn("net", F.col("l_extendedprice") * 0.9 + 3)
    return leakage.target_correlations(li, "l_extendedprice", ["net", "l_quantity"])


@query("lk_03_association", "SELECT 'code' AS feature, count(*) AS n, CAST(1 AS DOUBLE) AS cramers_v FROM orders")
def _(t):
    return leakage.target_associations(t.orders.withColumn("code", F.substring("o_orderpriority", 1, 1)), "o_orderpriority", ["code"])


@query("lk_04_separation", f"""WITH x AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS g, c_acctbal AS v FROM customer), k AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM x),
    a AS (SELECT (sum(k) FILTER (WHERE g = 'a') - n1 * (n1 + 1) / 2.0) / (n1 * n2) AS auc FROM k, (SELECT CAST(count(*) FILTER (WHERE g = 'a') AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE g = 'b') AS DOUBLE) AS n2 FROM x) GROUP BY n1, n2)
    SELECT 'c_acctbal' AS feature, {r('greatest(auc, 1 - auc)', 'separation')} FROM a""")
def _(t):
    halves = t.customer.withColumn("g", F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b"))
    return leakage.target_separation(halves, "g", ["c_acctbal"]).select("feature", "separation")


@query("lk_05_prediction_time", "SELECT count(*) AS rows, 'prediction_date' AS reference FROM orders")
def _(t):
    dated = t.orders.withColumnRenamed("o_orderdate", "prediction_date")
    return dated.agg(F.count("*").alias("rows"), F.lit(leakage.prediction_time(dated.columns)).alias("reference"))


@query("lk_06_after", f"SELECT {r('avg(CAST(l_shipdate > o_orderdate AS DOUBLE))', 'after_share')}, avg(CAST(l_shipdate > o_orderdate AS DOUBLE)) > 0.1 AS flagged FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return leakage.after_reference(joined, ["l_shipdate"], "o_orderdate").select("after_share", (F.col("after_share") > leakage.LATE_SHARE).alias("flagged"))


@query("lk_07_review", "SELECT feature, reason FROM (VALUES ('net', 'near-perfect correlation'), ('target_copy', 'near-perfect correlation'), ('target_copy', 'outcome-like name')) v(feature, reason)")
def _(t):
    li = t.lineitem.select("l_extendedprice", "l_quantity", (F.col("l_extendedprice") * 0.9).alias("net"), F.col("l_extendedprice").alias("target_copy"), "l_returnflag")
    return leakage.leakage(li, "l_extendedprice", P.profile(li)).select("feature", "reason")


# ---- anomalies --------------------------------------------------------------------------------------

AN = ["l_quantity", "l_extendedprice", "l_discount"]


_AN_COLUMNS = {"l_quantity": "l_quantity", "same": "1.0", "none": "CAST(NULL AS DOUBLE)", "l_discount": "l_discount", "l_extendedprice": "l_extendedprice"}
_AN_FACTS = union_all(f"SELECT '{c}' AS feature, {k} AS place, count({e}) AS cells, coalesce(min({e}) < max({e}), false) AS varies, count(*) AS n FROM lineitem" for k, (c, e) in enumerate(_AN_COLUMNS.items()))


@query("an_01_columns", f"""SELECT feature, cells, omitted IS NULL AS scored, omitted FROM (SELECT *, CASE WHEN n < 20 THEN 'fewer than 20 rows' WHEN NOT varies THEN 'constant or empty'
    WHEN sum(CAST(varies AS INTEGER)) OVER (ORDER BY place) > 2 THEN 'beyond the number of columns' END AS omitted FROM ({_AN_FACTS}))""")
def _(t):
    """Which columns are scored, and why the others are not."""
    li = t.lineitem.withColumns({"same": F.lit(1.0), "none": F.lit(None).cast("double")})
    return anomaly.column_review(li, list(_AN_COLUMNS), 2)


@query("an_02_scaling", f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM events), m AS (SELECT greatest(max(abs(v)), 1) AS f, median(v) AS med FROM x)
    SELECT event_id, {r('coalesce(v, med) / f', 's')} FROM x, m""")
def _(t):
    gaps = t.events.select("event_id", F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"))
    return anomaly.scaled_columns(gaps, ["value"])[0].select("event_id", F.col("s0").alias("s"))


MAD = union_all(f"SELECT '{c}' AS c, (SELECT median({c}) FROM lineitem) AS med, 1.4826 * (SELECT median(abs({c} - (SELECT median({c}) FROM lineitem))) FROM lineitem) AS s" for c in AN)


@query("an_04_drivers", f"""WITH m AS ({MAD}), d AS (SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f"abs({c} - (SELECT med FROM m WHERE c = '{c}')) / (SELECT s FROM m WHERE c = '{c}') AS d_{c}" for c in AN)} FROM lineitem)
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, {', '.join(r(f'd_{c}', f'd_{c}', 5) for c in AN)} FROM d""", 5)
def _(t):
    return anomaly.deviations(t.lineitem.select(*LINE_KEY, "l_quantity", "l_extendedprice", "l_discount"), AN, LINE_KEY).select("l_orderkey", "l_linenumber", "l_partkey", *[f"d_{c}" for c in AN])


@query("top_02_drivers", f"""WITH m AS (SELECT median(value) AS a, 1.4826 * median(abs(value - (SELECT median(value) FROM events))) AS sa, median(user_id) AS b,
    1.4826 * median(abs(user_id - (SELECT median(user_id) FROM events))) AS sb FROM events)
    SELECT event_id, CASE WHEN abs(value - a) / sa >= abs(user_id - b) / sb THEN 'value' ELSE 'user_id' END AS driver FROM events, m""")
def _(t):
    d = anomaly.deviations(t.events.select("event_id", "value", F.col("user_id").cast("double").alias("user_id")), ["value", "user_id"], ["event_id"])
    return anomaly.drivers(d, ["value", "user_id"], 1).select("event_id", F.get("drivers", F.lit(0))["feature"].alias("driver"))


@query("an_05_flags", f"SELECT count(*) AS rows, count(*) FILTER (WHERE 40 - value < 0) AS flagged_rows, {r('count(*) FILTER (WHERE 40 - value < 0) / count(*) * 100', 'flagged_pct')} FROM events")
def _(t):
    return anomaly.flag_summary(t.events.withColumn("score", 40 - F.col("value")))


@query("top_02_worst", f"SELECT event_id, {r('40 - value', 'score')} FROM events WHERE 40 - value < 0 ORDER BY 40 - value, event_id LIMIT 12")
def _(t):
    return anomaly.worst_rows(t.events.withColumn("score", 40 - F.col("value")), ["event_id"]).select("event_id", "score")


@query("an_03_forest")
def _(t):
    return anomaly.flag_summary(anomaly.isolation_forest(t.lineitem.select(*LINE_KEY, "l_quantity", "l_extendedprice", "l_discount"), AN, LINE_KEY))


@query("an_03_detect")
def _(t):
    scored = anomaly.detect(t.events.select("event_id", "value", "user_id"), ["value", "user_id"], ["event_id"])
    return anomaly.worst_rows(scored, ["event_id"]).select("event_id", "score", F.to_json("drivers").alias("drivers"))


