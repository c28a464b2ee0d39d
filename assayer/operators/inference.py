"""Association and group-difference tests over all rows.

Every test is reduced to sufficient statistics by grouped aggregates; p-values are computed
on the result, which has one row per pair of columns.
"""

from __future__ import annotations

import functools
import itertools
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import numbers, tails
from assayer.operators import quantiles as q
from assayer.operators import ranking
from assayer.operators.normalize import long_form, quoted
from assayer.operators.sampling import stable_sample
from assayer.operators.together import run_together

LEVELS = 20
PAIRS_PER_SCAN = 30
LEAST_ROWS, LEAST_GROUP = 8, 3
SKETCH_REGISTERS = 512  # of a distinct-count sketch with a relative error of 5 %
HELD_RANKS = 250_000  # distinct values of a column whose table of ranks is broadcast
HELD_GROUPS = 10_000  # groups whose medians are broadcast
PAIR = ["category", "numeric"]


def _q(name: str):
    return F.col(f"`{name}`")


# ---- pairs ---------------------------------------------------------------------------------

def column_pairs(profile_table: DataFrame, most: int | None = None) -> DataFrame:
    """Each unordered pair of columns once, in column order."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("position", "column"))), lambda s: s["column"])
    one = profile_table.agg(names.alias("names"))  # one short array: the column names
    pairs = (one.select("names", F.posexplode("names").alias("i", "left"))
             .select("i", "left", F.posexplode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("step", "right"))
             .select((F.col("i") + 1).alias("i"), (F.col("i") + F.col("step") + 2).alias("j"), "left", "right"))
    return pairs if most is None else pairs.orderBy("i", "j").limit(most)


def eligible(profile_table: DataFrame, columns=None) -> DataFrame:
    """Columns that take part in tests, and ``skipped`` rows for extreme magnitudes."""
    chosen = profile_table if columns is None else profile_table.filter(F.col("column").isin(list(columns)))
    usable = (F.col("kind") != "datetime") & ~F.col("possible_id") & (F.col("unique") > 1)
    return (chosen.filter(usable | F.col("extreme_magnitude"))
            .select("column", "kind", F.when(F.col("extreme_magnitude"), "skipped").otherwise("eligible").alias("status")))


# ---- numeric by numeric -----------------------------------------------------------------------

def pearson(df: DataFrame, pairs) -> DataFrame:
    """r, its t statistic and Fisher-z interval for every pair, a few dozen pairs in one scan."""
    pairs = list(pairs)
    if len(pairs) > PAIRS_PER_SCAN:  # one aggregate of all pairs would take longer to compile than to run
        parts = [pearson(df, pairs[k:k + PAIRS_PER_SCAN]) for k in range(0, len(pairs), PAIRS_PER_SCAN)]
        return functools.reduce(DataFrame.unionByName, parts)
    names = list(dict.fromkeys(itertools.chain(*pairs)))
    aggregates, cells = [], {}
    for i, (a, b) in enumerate(pairs):
        x, y = f"`{a}`", f"`{b}`"
        xs, ys = f"if({y} IS NULL, NULL, {x})", f"if({x} IS NULL, NULL, {y})"
        aggregates += [f"count({xs}) AS n{i}", numbers.corr_sql(x, y) + f" AS r{i}", f"min({xs}) < max({xs}) AS vx{i}", f"min({ys}) < max({ys}) AS vy{i}"]
        cells[i] = {"left": quoted(a), "right": quoted(b), "n": f"n{i}", "coefficient": f"r{i}", "varies": f"coalesce(vx{i} AND vy{i}, false)"}
    wide = df.selectExpr(*[f"{numbers.finite_sql(c)} AS `{c}`" for c in names]).selectExpr(*aggregates)
    out = long_form(wide, cells, "pair").drop("pair")
    # least and greatest skip nulls, so an undefined r must not reach them.
    z = F.when(F.col("coefficient").isNotNull(), F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("coefficient")))))
    reach = F.when(F.col("n") > 3, 1.96 / F.sqrt(F.col("n") - 3))
    return _correlation_t(out).withColumns({"lower": F.tanh(z - reach), "upper": F.tanh(z + reach)})


def _correlation_t(df: DataFrame) -> DataFrame:
    r, n = F.col("coefficient"), F.col("n")
    t = F.when(n > 2, r * F.sqrt(F.try_divide(n - 2, F.greatest(1 - r * r, F.lit(1e-300)))))
    return df.withColumns({"t": t, "df": (n - 2).cast("double")})


def spearman(df: DataFrame, pairs, complete=(), rows: int | None = None) -> DataFrame:
    """Pearson correlation of average ranks for every pair.

    Columns without gaps are ranked once for all their pairs; a pair with gaps is ranked on its
    own complete rows. The rank table has one row per distinct value, so a hot value is hot on
    one side of the join only and adaptive execution can split it.
    """
    rows = df.count() if rows is None else rows
    whole = [p for p in pairs if set(p) <= set(complete)]
    out = None
    if whole:
        names = list(dict.fromkeys(itertools.chain(*whole)))
        out = _rank_correlations(df, names, whole, rows)
    for a, b in pairs:
        if (a, b) not in whole:
            part = df.select(numbers.finite(_q(a)).alias(a), numbers.finite(_q(b)).alias(b)).na.drop()
            one = _rank_correlations(part, [a, b], [(a, b)], rows)
            out = one if out is None else out.unionByName(one)
    return _correlation_t(out)


def _rank_correlations(df: DataFrame, names, pairs, rows) -> DataFrame:
    ranked = df.select(*[numbers.finite(_q(c)).alias(f"v{i}") for i, c in enumerate(names)])
    # How finely a column is cut depends on its distinct values, not on the rows.
    sizes = [rows] * len(names) if rows <= ranking.SMALL_ROWS else [
        min(rows, int(n * 1.2) + 1) for n in ranked.agg(*[F.approx_count_distinct(f"v{i}") for i in range(len(names))]).first()]
    # Unless a short table is broadcast, all rows are shuffled by its column before Spark has measured it.
    for i in sorted(range(len(names)), key=lambda i: sizes[i]):
        table = ranking.average_ranks(ranked.select(f"v{i}"), f"v{i}", rows=sizes[i]).select(f"v{i}", F.col("avg_rank").alias(f"k{i}"))
        ranked = ranked.join(F.broadcast(table) if sizes[i] <= HELD_RANKS else table, f"v{i}")
    at = {c: i for i, c in enumerate(names)}
    wide = ranked.agg(F.count(F.lit(1)).alias("n"), *[F.expr(numbers.corr_sql(f"k{at[a]}", f"k{at[b]}")).alias(f"r{j}") for j, (a, b) in enumerate(pairs)])
    return long_form(wide, {j: {"left": quoted(a), "right": quoted(b), "n": "n", "coefficient": f"r{j}"}
                            for j, (a, b) in enumerate(pairs)}, "pair").drop("pair")


# ---- categorical by categorical -----------------------------------------------------------------

def contingency(df: DataFrame, pairs) -> DataFrame:
    """Cells (left, right, a, b, n) of the tables of all pairs, in one scan."""
    cells = F.array(*[F.struct(F.lit(x).alias("left"), F.lit(y).alias("right"), _q(x).cast("string").alias("a"),
                               _q(y).cast("string").alias("b")) for x, y in pairs])
    return (df.select(F.explode(cells).alias("c")).select("c.*")
            .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
            .groupBy("left", "right", "a", "b").agg(F.count(F.lit(1)).alias("n")))


def chi_square(cells: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Chi-square without correction, Cramer's V, expected-count screen; pairs with more than
    ``levels`` labels on a side are left out. Empty cells count: sum((o-e)^2/e) = n (sum o^2/(r c) - 1)."""
    pair = ["left", "right"]
    a = cells.groupBy(*pair, "a").agg(F.sum("n").alias("row_total"))
    b = cells.groupBy(*pair, "b").agg(F.sum("n").alias("column_total"))
    sizes = (a.groupBy(*pair).agg(F.count(F.lit(1)).alias("r"), F.sum("row_total").alias("total"))
             .join(b.groupBy(*pair).agg(F.count(F.lit(1)).alias("c")), pair)
             .filter((F.greatest("r", "c") <= levels) & (F.least("r", "c") >= 2)))
    margins = (a.join(sizes, pair).groupBy(*pair, "r", "c", "total").agg(F.collect_list("row_total").alias("rows"))  # <= levels each
               .join(b.join(sizes.select(*pair), pair).groupBy(*pair).agg(F.collect_list("column_total").alias("columns")), pair))
    fit = (cells.join(sizes.select(*pair), pair).join(a, [*pair, "a"]).join(b, [*pair, "b"]).groupBy(*pair)
           .agg(F.sum(F.col("n") * F.col("n") / (F.col("row_total") * F.col("column_total"))).alias("s")))
    small = F.aggregate("rows", F.lit(0), lambda acc, r: acc + F.size(F.filter("columns", lambda c: r * c < 5 * F.col("total"))))
    out = margins.join(fit, pair).withColumns({
        "statistic": F.col("total") * (F.col("s") - 1),
        "df": ((F.col("r") - 1) * (F.col("c") - 1)).cast("double"),
        "expected_min": F.array_min("rows") * F.array_min("columns") / F.col("total"),
        "low_expected_share": small / (F.col("r") * F.col("c"))})
    return out.withColumns({
        "cramers_v": F.sqrt(F.greatest(F.lit(0.0), F.col("statistic")) / (F.col("total") * (F.least("r", "c") - 1))),
        "sparse_expected": (F.col("low_expected_share") > 0.2) | (F.col("expected_min") < 1),
    }).select(*pair, F.col("total").alias("n"), "r", "c", "statistic", "df", "cramers_v", "expected_min", "low_expected_share", "sparse_expected")


def contingency_payload(cells: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Ordered labels and counts of each table with at most ``levels`` labels per side."""
    pair = ["left", "right"]
    sides = cells.groupBy(*pair).agg(F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    fits = sides.filter(F.greatest("r", "c") <= levels).select(*pair)
    return (cells.join(fits, pair).groupBy(*pair).agg(
        F.array_sort(F.collect_set("a")).alias("row_labels"), F.array_sort(F.collect_set("b")).alias("column_labels"),
        F.map_from_entries(F.collect_list(F.struct(F.struct("a", "b"), F.col("n")))).alias("m"))  # <= levels^2 cells
        .withColumn("counts", F.transform("row_labels", lambda a: F.transform(
            "column_labels", lambda b: F.coalesce(F.try_element_at("m", F.struct(a.alias("a"), b.alias("b"))), F.lit(0)))))
        .drop("m"))


def fisher_exact(cells: DataFrame) -> DataFrame:
    """Two-sided exact test of the 2x2 tables among the pairs."""
    pair = ["left", "right"]
    two = contingency_payload(cells, 2).filter((F.size("row_labels") == 2) & (F.size("column_labels") == 2))
    at = lambda i, j: F.col("counts")[i][j]
    return (two.select(*pair, at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 0).alias("c"), at(1, 1).alias("d"))
            .withColumn("p_value", tails.fisher_p(*[F.col(v).cast("double") for v in "abcd"])))


# ---- numeric by category ---------------------------------------------------------------------------

def _by_category(df: DataFrame, categories, numerics) -> DataFrame:
    """Rows once per category column: category, label and the numeric columns v0, v1, ..."""
    labels = F.array(*[F.struct(F.lit(c).alias("category"), _q(c).cast("string").alias("label")) for c in categories])
    return (df.select(F.explode(labels).alias("g"), *[numbers.finite(_q(x)).alias(f"v{i}") for i, x in enumerate(numerics)])
            .select("g.category", "g.label", *[f"v{i}" for i in range(len(numerics))]).filter(F.col("label").isNotNull()))


def _group_statistics(rows: DataFrame, numerics) -> DataFrame:
    aggregates, cells = [], []
    for i, x in enumerate(numerics):
        aggregates += [F.expr(f"{f}(v{i}) AS {a}{i}") for f, a in (("count", "n"), ("avg", "m"), ("var_samp", "s"), ("skewness", "g"))]
        cells.append(f"named_struct('numeric', {quoted(x)}, 'n', n{i}, 'mean', m{i}, 'variance', s{i}, 'g1', g{i})")
    return (rows.groupBy("category", "label").agg(*aggregates)
            .selectExpr("category", "label", f"inline(array({', '.join(cells)}))").filter(F.col("n") > 0))


def group_rows(df: DataFrame, categories, numerics) -> DataFrame:
    """n, mean, sample variance and population skewness per (category, numeric, label)."""
    return _group_statistics(_by_category(df, categories, numerics), numerics)


def group_medians(df: DataFrame, categories, numerics, rows: int | None = None) -> DataFrame:
    """Median per (category, numeric, label)."""
    rows = (df.count() if rows is None else rows) * len(categories)
    wide = q.medians(_by_category(df, categories, numerics), [f"v{i}" for i in range(len(numerics))], ["category", "label"], rows)
    cells = [F.struct(F.lit(x).alias("numeric"), F.col(f"v{i}").alias("median")) for i, x in enumerate(numerics)]
    return wide.select("category", "label", F.inline(F.array(*cells)))


def group_summary(df: DataFrame, category: str, numeric: str, rows: int | None = None) -> DataFrame:
    """n, mean and median per label, in label order."""
    return (group_rows(df, [category], [numeric]).join(group_medians(df, [category], [numeric], rows), [*PAIR, "label"])
            .select("label", "n", "mean", "median").orderBy("label"))


def deviation_rows(df: DataFrame, categories, numerics, rows: int | None = None) -> DataFrame:
    """Group statistics of the distance to the group median (the data of the Brown-Forsythe test)."""
    count = (df.count() if rows is None else rows) * len(categories)
    cells = _by_category(df, categories, numerics)
    names = [f"v{i}" for i in range(len(numerics))]
    centre = q.medians(cells, names, ["category", "label"], count).withColumnsRenamed({v: f"c_{v}" for v in names})
    few = centre.limit(HELD_GROUPS + 1).collect()
    centre = F.broadcast(df.sparkSession.createDataFrame(few, centre.schema)) if len(few) <= HELD_GROUPS else centre
    away = cells.join(centre, ["category", "label"])
    return _group_statistics(away.select("category", "label", *[F.abs(F.col(v) - F.col(f"c_{v}")).alias(v) for v in names]), numerics)


def eligible_groups(groups: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Group rows of the pairs with 2 to ``levels`` groups of three rows or more."""
    sizes = groups.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("smallest"))
    return groups.join(sizes.filter(F.col("k").between(2, levels) & (F.col("smallest") >= 3)).select(*PAIR, "k"), PAIR)


def anova(groups: DataFrame) -> DataFrame:
    """F and eta squared per pair from group sizes, means and variances."""
    total = groups.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    parts = groups.select(*PAIR, F.col("n").alias("size"), "mean", "variance").join(total, PAIR)
    sums = parts.groupBy(*PAIR, "k", "n").agg(
        F.sum(F.col("size") * (F.col("mean") - F.col("grand")) ** 2).alias("between"),
        F.sum((F.col("size") - 1) * F.col("variance")).alias("within"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return sums.select(
        *PAIR, "k", "n", F.try_divide(F.col("between") / d1, F.try_divide(F.col("within"), d2.cast("double"))).alias("statistic"),
        d1.cast("double").alias("df1"), d2.cast("double").alias("df2"),
        F.coalesce(F.try_divide(F.col("between"), F.col("between") + F.col("within")), F.lit(0.0)).alias("eta_squared"))


def levene(df: DataFrame, categories, numerics, rows: int | None = None) -> DataFrame:
    """Median-centred Levene statistic per pair."""
    return anova(deviation_rows(df, categories, numerics, rows).persist()).drop("eta_squared")  # a row per group and column, read twice


def two_groups(groups: DataFrame) -> DataFrame:
    """Student and Welch statistics, Cohen's d and variance ratio of the pairs with two groups."""
    sides = groups.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("label", "n", "mean", "variance"))).alias("g"),  # <= LEVELS groups
                                      F.count(F.lit(1)).alias("k")).filter(F.col("k") == 2)
    a, b = F.col("g")[0], F.col("g")[1]
    n1, n2, v1, v2 = a["n"], b["n"], a["variance"], b["variance"]
    difference = a["mean"] - b["mean"]
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    se2 = v1 / n1 + v2 / n2
    return sides.select(
        *PAIR, (n1 + n2).alias("n"), n1.alias("n1"), n2.alias("n2"), difference.alias("mean_difference"),
        F.when(pooled > 0, difference / F.sqrt(pooled)).alias("cohens_d"),
        F.try_divide(F.greatest(v1, v2), F.least(v1, v2)).alias("variance_ratio"),
        F.try_divide(difference, F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("student_t"),
        (n1 + n2 - 2).cast("double").alias("student_df"),
        F.try_divide(difference, F.sqrt(se2)).alias("welch_t"), F.sqrt(se2).alias("welch_se"),
        F.try_divide(se2 * se2, (v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)).alias("welch_df"))


def mean_difference_interval(pairs: DataFrame) -> DataFrame:
    """95% Welch interval of the mean difference, from the rows of ``two_groups``."""
    reach = tails.t_975(F.col("welch_df")) * F.col("welch_se")
    return pairs.withColumns({"difference_low": F.col("mean_difference") - reach, "difference_high": F.col("mean_difference") + reach})


def rank_rows(df: DataFrame, pairs, rows: int | None = None) -> DataFrame:
    """Rank sums per (category, numeric, label) with the tie term of the pair."""
    rows = df.count() if rows is None else rows
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(x).alias("numeric"), _q(c).cast("string").alias("label"),
                               numbers.finite(_q(x)).alias("value")) for c, x in pairs])
    cells = df.select(F.explode(cells).alias("c")).select("c.*").filter(F.col("label").isNotNull() & F.col("value").isNotNull())
    ranks = ranking.average_ranks(cells, "value", PAIR, ["label"], rows * len(pairs))
    return ranks.groupBy(*PAIR, "label").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("avg_rank")).alias("rank_sum"),
        F.sum(F.col("n") * (F.col("ties").cast("double") * F.col("ties") - 1)).alias("tie_term"))


def kruskal(ranks: DataFrame) -> DataFrame:
    """Kruskal-Wallis H with tie correction and epsilon squared per pair."""
    s = ranks.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("tie_term").alias("ties"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"))
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    out = s.withColumn("statistic", h)
    return out.select(*PAIR, "k", "n", "statistic", (F.col("k") - 1).cast("double").alias("df"), F.greatest(
        F.lit(0.0), (F.col("statistic") - F.col("k") + 1) / (n - F.col("k"))).alias("epsilon_squared"))


def arrangements_upto(u: int, n1: int, n2: int) -> int:
    """Arrangements of two untied groups with U <= u, for a first group of eight at most and a second of any size.

    U counts partitions into n1 parts of at most n2. Without that bound their running number is a
    polynomial of degree n1 on every residue class modulo lcm(1..n1), so a short table and forward
    differences give it anywhere; the bound comes back by inclusion and exclusion.
    """
    period = math.lcm(*range(1, n1 + 1))
    table = [1] * (period * (n1 + 1))  # parts of size 1 to n1, and slack
    for part in range(1, n1 + 1):
        for m in range(part, len(table)):
            table[m] += table[m - part]

    def free(m: int) -> int:
        if m < 0:
            return 0
        t, r = divmod(m, period)
        steps, total = [table[r + period * k] for k in range(n1 + 1)], 0
        for k in range(n1 + 1):
            total += steps[0] * math.comb(t, k)
            steps = [b - a for a, b in itertools.pairwise(steps)]
        return total

    return sum((-1) ** size * free(u - sum(n2 + i for i in chosen))
               for size in range(n1 + 1) for chosen in itertools.combinations(range(1, n1 + 1), size))


def exact_rank_tail(u, n1, n2):
    """P(U >= u) over all arrangements of two groups without ties, the smaller one of eight rows at most."""
    def one(u, n1, n2):
        return arrangements_upto(n1 * n2 - math.ceil(u), n1, n2) / math.comb(n1 + n2, n1)
    return np.array([one(float(a), int(min(b, c)), int(max(b, c))) if a == a else math.nan for a, b, c in zip(u, n1, n2)])


def mann_whitney(ranks: DataFrame, with_p: bool = False) -> DataFrame:
    """U of the first label, z with tie and continuity correction, rank-biserial correlation.

    The p-value is exact where a group has eight rows at most and nothing is tied.
    """
    s = (ranks.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("label", "n", "rank_sum"))).alias("g"),  # two rows kept
                                  F.sum("tie_term").alias("ties"), F.count(F.lit(1)).alias("k")).filter(F.col("k") == 2))
    a, b = F.col("g")[0], F.col("g")[1]
    n1, n2 = a["n"].cast("double"), b["n"].cast("double")
    u = a["rank_sum"] - n1 * (n1 + 1) / 2
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    out = s.select(*PAIR, (a["n"] + b["n"]).alias("n"), a["n"].alias("n1"), b["n"].alias("n2"), u.alias("statistic"),
                   F.try_divide(F.greatest(F.lit(0.0), F.abs(u - n1 * n2 / 2) - 0.5), sd).alias("z"),
                   (2 * u / (n1 * n2) - 1).alias("rank_biserial"), (F.col("ties") == 0).alias("untied"))
    if not with_p:
        return out
    exact = F.col("untied") & (F.least("n1", "n2") <= 8)
    best = F.when(exact, F.greatest(F.col("statistic"), F.col("n1") * F.col("n2") - F.col("statistic")))
    tail = tails._udf(exact_rank_tail, 3)(best, F.col("n1").cast("double"), F.col("n2").cast("double"))
    return out.withColumn("p_value", F.when(exact, F.least(F.lit(1.0), 2 * tail)).otherwise(tails.normal_p(F.col("z"))))


def rank_p(u, n1, n2, z, untied):
    """Two-sided p-values by the same rule, for a few rows."""
    return np.array([min(1.0, 2 * float(exact_rank_tail([max(a, b * c - a)], [b], [c])[0])) if free and min(b, c) <= 8 else float(tails.normal_two_sided(np.array([w]))[0])
                     for a, b, c, w, free in zip(u, n1, n2, z, untied)])


def shapiro_wilk(x) -> float:
    """p-value of the Shapiro-Wilk test by Royston's 1995 approximation, for 4 to 5000 values."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return math.nan
    m = _normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    length, u = float(m @ m), 1 / math.sqrt(n)
    # Royston's polynomials, highest power first.
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(length)], u)
    a = np.empty(n)
    if n > 5:
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(length)], u)
        phi = (length - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last ** 2 - 2 * second ** 2)
        a[2:-2], a[1], a[-2] = m[2:-2] / math.sqrt(phi), -second, second
    else:
        phi = (length - 2 * m[-1] ** 2) / (1 - 2 * last ** 2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[0], a[-1] = -last, last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        g = np.polyval([0.459, -2.273], n)
        if y >= g:
            return 0.0
        y = -math.log(g - y)
        mean = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        k = math.log(n)
        mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))


def _normal_quantile(p):
    from statistics import NormalDist
    inverse = NormalDist().inv_cdf
    return np.array([inverse(float(v)) for v in p])


def shapiro_groups(df: DataFrame, pairs, key, most: int = 500) -> DataFrame:
    """Shapiro-Wilk p-value per (category, numeric, label) on the first ``most`` rows in md5 order."""
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(x).alias("numeric"), _q(c).cast("string").alias("label"),
                               numbers.finite(_q(x)).alias("value")) for c, x in pairs])
    cells = (df.select(F.explode(cells).alias("c"), *[_q(k).alias(f"__k{i}") for i, k in enumerate(key)])
             .select("c.*", *[f"__k{i}" for i in range(len(key))]).filter(F.col("label").isNotNull() & F.col("value").isNotNull()))
    few = stable_sample(cells, [f"__k{i}" for i in range(len(key))], most, strata=[*PAIR, "label"]).select(*PAIR, "label", "value")

    def test(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        return pd.DataFrame({"category": [first.category], "numeric": [first.numeric], "label": [first.label],
                             "shapiro_p": [shapiro_wilk(part["value"])]})
    return few.groupBy(*PAIR, "label").applyInPandas(test, "category string, numeric string, label string, shapiro_p double")


def normality(groups: DataFrame, shapiro: DataFrame | None = None) -> DataFrame:
    """Per pair: does every group pass the normality screen (mild skew on 30 rows, or Shapiro-Wilk)?"""
    mild = (F.abs(F.col("g1")) < 2) & (F.col("n") >= 30)
    if shapiro is not None:
        groups = groups.join(shapiro, [*PAIR, "label"], "left")
        mild = mild | F.coalesce(F.col("shapiro_p") >= 0.05, F.lit(False))
    passes = F.coalesce((F.col("variance") > 0) & (F.col("n") >= 8) & mild, F.lit(False))
    return groups.groupBy(*PAIR).agg(F.bool_and(passes).alias("normal"), F.min("variance").alias("smallest_variance"))


# ---- one run over all pairs ---------------------------------------------------------------------------

def fdr(df: DataFrame, p: str = "p_value", alpha: float = 0.05, by=()) -> DataFrame:
    """Benjamini-Hochberg q-values over all finite p-values (one row per test, so one sort is enough)."""
    family = Window.partitionBy(*(by or [F.lit(0)]))
    tested = F.col(p).isNotNull() & ~F.isnan(F.col(p))
    ranked = df.withColumn("tests_in_family", F.count(F.when(tested, F.lit(1))).over(family)).withColumn(
        "__rank", F.row_number().over(family.orderBy(F.col(p).asc_nulls_last())))
    later = family.orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(tested, F.col(p) * F.col("tests_in_family") / F.col("__rank"))
    return (ranked.withColumn("q_value", F.when(tested, F.least(F.lit(1.0), F.min(step).over(later))))
            .withColumn("significant", F.col("q_value") < alpha).drop("__rank"))


RESULT = """left string, right string, kind string, method string, n long, statistic double, df1 double, df2 double,
p_value double, effect double, measure string, lower double, upper double, sparse boolean, normal boolean,
groups string, expected_min double, status string"""

SHORT = "Insufficient complete observations"
MANY_LABELS = "More labels than a test takes"
ONE_LABEL = "Fewer than two labels among the complete rows"
SMALL_GROUP = "A group has fewer than three rows"
NO_SPREAD = "The numbers do not vary"


def _shape(df: DataFrame, p=None, **values) -> list:
    """The result rows of one family of tests: one row per pair.

    ``p``: a tail function and its argument columns; a handful of rows is not worth a worker.
    """
    fields = T._parse_datatype_string(RESULT).fields
    kernel, arguments = p or (None, ())
    rows = df.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields],
                     *[a.cast("double").alias(f"__a{i}") for i, a in enumerate(arguments)]).collect()
    out, place = [], [f.name for f in fields].index("p_value")
    for r in rows:
        row, given = list(r[:len(fields)]), list(r[len(fields):])
        if kernel is not None and None not in given:
            value = float(kernel(*[np.array([g]) for g in given])[0])
            row[place] = None if math.isnan(value) else value
        out.append(tuple(row))
    return out


def _skipped(pair, kind: str, reason: str, n) -> tuple:
    """The result row of a pair that is not tested."""
    left = RESULT.count(",") + 1 - 6
    return (*pair, kind, reason, n, *[None] * left, "skipped")


def overfull_pairs(df: DataFrame, pairs, kinds: dict, unique: dict, levels: int = LEVELS) -> dict:
    """Complete rows of the pairs in which a column surely has more than ``levels`` labels.

    Labels count on the complete rows of the pair, so a column of many labels may have few beside a
    sparse one. A sketch of m registers that has seen at most k values estimates at most
    m ln(m / (m - k)), so a higher estimate proves more than k labels; the other pairs are counted
    exactly afterwards, and no column of free text has its labels shuffled or collected.
    """
    wide = {c for c in kinds if kinds[c] == "categorical" and unique[c] > levels}
    asked = [(p, [c for c in p if c in wide]) for p in pairs]
    asked = [(p, cs) for p, cs in asked if cs]
    most = SKETCH_REGISTERS * math.log(SKETCH_REGISTERS / (SKETCH_REGISTERS - levels)) + 1 if levels < SKETCH_REGISTERS else math.inf
    out = {}
    for begin in range(0, len(asked), PAIRS_PER_SCAN):
        cells = []
        for k, (pair, columns) in enumerate(asked[begin:begin + PAIRS_PER_SCAN]):
            whole = [(_q(c) if kinds[c] == "categorical" else numbers.finite(_q(c))).isNotNull() for c in pair]
            complete = whole[0] & whole[1]
            cells.append(F.count_if(complete).alias(f"n{k}"))
            cells += [F.approx_count_distinct(F.when(complete, _q(c).cast("string"))).alias(f"d{k}_{j}") for j, c in enumerate(columns)]
        row = df.agg(*cells).first()
        for k, (pair, columns) in enumerate(asked[begin:begin + PAIRS_PER_SCAN]):
            if max(row[f"d{k}_{j}"] for j in range(len(columns))) > most:
                out[pair] = row[f"n{k}"]
    return out


def test_pairs(df: DataFrame, profile_table: DataFrame, columns=None, nominal=(), key=None, max_pairs: int | None = None,
               sample: int | None = None) -> DataFrame:
    """Tests of all pairs of eligible columns with effect size, interval, q-value and notes.

    ``nominal`` names numeric columns to be read as categories. Rows and pairs are not limited
    unless ``sample`` or ``max_pairs`` say so. The families of tests run side by side. Labels and
    group sizes are those of the complete rows of a pair; every pair has a row, and one that is not
    tested has the status skipped and the reason as its method.
    """
    spark = df.sparkSession
    meta = profile_table.collect()  # a row per column
    rows = population = meta[0]["total_rows"]
    chosen = [r for r in meta if columns is None or r["column"] in columns]
    kinds = {r["column"]: "categorical" if r["column"] in nominal else r["kind"] for r in chosen
             if not r["extreme_magnitude"] and r["kind"] != "datetime" and not r["possible_id"] and r["unique"] > 1}
    names = [c for c in (columns or df.columns) if c in kinds]
    if sample is not None and rows > sample:
        df, rows = stable_sample(df, key or df.columns, sample), sample
    pairs = list(itertools.combinations(names, 2))[:max_pairs]
    df = df.select(*[_q(c) for c in dict.fromkeys([*names, *(key or [])])])
    numeric = [p for p in pairs if kinds[p[0]] == kinds[p[1]] == "numeric"]
    unique = {r["column"]: r["unique"] for r in chosen}
    ordered = [(a, b) if kinds[a] == "categorical" else (b, a) for a, b in pairs]
    full = overfull_pairs(df, [p for p in ordered if kinds[p[0]] == "categorical"], kinds, unique)
    tables = [p for p in pairs if kinds[p[0]] == kinds[p[1]] == "categorical" and p not in full]
    mixed = [p for p in ordered if kinds[p[0]] != kinds[p[1]] and p not in full]
    jobs = [lambda f=f, p=p: f(df, p, key, rows)
            for f, p in ((_numeric_tests, numeric), (_table_tests, tables), (_group_tests, mixed)) if p]
    out = list(itertools.chain(*run_together(spark, *jobs))) if jobs else []
    for p, n in full.items():
        out.append(_skipped(p, "association" if kinds[p[0]] == kinds[p[1]] else "group_difference", MANY_LABELS if n >= LEAST_ROWS else SHORT, n))
    for r in chosen:
        if r["extreme_magnitude"]:
            out.append(_skipped((r["column"], None), "statistics", "Numeric range suitability", 0))
    found = fdr(spark.createDataFrame(out, RESULT))
    dated = any(r["kind"] == "datetime" for r in meta)
    return (found.withColumn("strength", F.when(F.col("effect").isNotNull(), numbers.strength("effect", "measure")))
            .withColumn("population", F.lit(population))
            .withColumn("notes", notes(rows < population, dated, meta[0]["duplicates"] > 0, F.coalesce(F.col("sparse"), F.lit(False)))))


def _numeric_tests(df: DataFrame, pairs, key, rows) -> list:
    spark = df.sparkSession
    linear = pearson(df, pairs)
    state = linear.collect()  # a row per pair
    good = [(r["left"], r["right"]) for r in state if r["n"] >= LEAST_ROWS and r["varies"]]
    full = {c for r in state if r["n"] == rows for c in (r["left"], r["right"])}
    base = {"left": F.col("left"), "right": F.col("right"), "kind": F.lit("association"), "n": F.col("n"), "status": F.lit("completed"),
            "statistic": F.col("t"), "df1": F.col("df"), "effect": F.col("coefficient"), "measure": F.lit("correlation")}
    known = spark.createDataFrame(state, linear.schema)
    usable = (F.col("n") >= LEAST_ROWS) & F.col("varies")

    def skipped():
        return _shape(known.filter(~usable), left=F.col("left"), right=F.col("right"), kind=F.lit("association"), n=F.col("n"),
                      method=F.lit(SHORT), status=F.lit("skipped"))

    def straight():
        return _shape(known.filter(usable), p=(tails.t_two_sided, (F.col("t"), F.col("df"))), **base, method=F.lit("Pearson correlation"),
                      lower=F.col("lower"), upper=F.col("upper"))

    def ranked():
        found = spearman(df, good, full, rows)
        return _shape(found, p=(tails.t_two_sided, (F.col("t"), F.col("df"))), **base, method=F.lit("Spearman correlation"))

    jobs = [straight, ranked] if good else []
    if len(good) < len(pairs):
        jobs.append(skipped)
    return list(itertools.chain(*run_together(spark, *jobs)))


def _table_tests(df: DataFrame, pairs, key, rows) -> list:
    """One scan for the tables of all pairs; the exact test only where expected counts are sparse."""
    few = contingency(df, pairs)
    counted = few.collect()  # overfull pairs are gone, so this is short
    labels: dict = {p: (set(), set()) for p in pairs}
    total = dict.fromkeys(pairs, 0)
    for r in counted:
        pair = (r["left"], r["right"])
        labels[pair][0].add(r["a"])
        labels[pair][1].add(r["b"])
        total[pair] += r["n"]

    def reason(pair):
        many = [len(side) for side in labels[pair]]
        return SHORT if total[pair] < LEAST_ROWS else MANY_LABELS if max(many) > LEVELS else ONE_LABEL if min(many) < 2 else None

    out = [_skipped(p, "association", reason(p), total[p]) for p in pairs if reason(p)]
    counted = [tuple(r) for r in counted if not reason((r["left"], r["right"]))]
    if not counted:
        return out
    chi = chi_square(df.sparkSession.createDataFrame(counted, few.schema))
    cells = {(left, right, a, b): n for left, right, a, b, n in counted}
    exact_p = {}
    for r in chi.filter("sparse_expected AND r = 2 AND c = 2").select("left", "right").collect():
        pair = (r["left"], r["right"])
        a, b = (sorted(side) for side in labels[pair])
        exact_p[pair] = float(tails.fisher_two_sided(*[[cells.get((*pair, x, y), 0)] for x in a for y in b])[0])
    known = df.sparkSession.createDataFrame([(*p, v) for p, v in exact_p.items()], "left string, right string, exact_p double")
    chi = chi.join(F.broadcast(known), ["left", "right"], "left")  # a row per pair
    exact = F.col("exact_p").isNotNull()
    return out + _shape(
        chi, p=(lambda given, x, d: np.where(given >= 0, given, tails.chi_square_upper(x, d)), (F.coalesce("exact_p", F.lit(-1.0)), F.col("statistic"), F.col("df"))),
        left=F.col("left"), right=F.col("right"), kind=F.lit("association"), n=F.col("n"), measure=F.lit("cramers_v"),
        method=F.when(exact, "Fisher exact association").otherwise("Chi-square association"), statistic=F.col("statistic"), df1=F.col("df"),
        effect=F.col("cramers_v"), sparse=F.col("sparse_expected"), expected_min=F.col("expected_min"), status=F.lit("completed"))


def _group_tests(df: DataFrame, mixed, key, rows) -> list:
    """Screens first: they decide which of the costlier statistics a pair needs."""
    spark = df.sparkSession
    categories, numerics = list(dict.fromkeys(c for c, _ in mixed)), list(dict.fromkeys(x for _, x in mixed))
    found: dict = {}
    schema = "category string, label string, numeric string, n long, mean double, variance double, g1 double"
    # A category that is overfull beside one column may be tested beside another: only the asked pairs come back.
    asked = F.concat_ws("|", "category", "numeric").isin(["|".join(p) for p in mixed])
    for r in group_rows(df, categories, numerics).filter(asked).collect():
        if (r["category"], r["numeric"]) in mixed:
            found.setdefault((r["category"], r["numeric"]), []).append(r)

    def reason(groups):
        sizes = [g["n"] for g in groups]
        return (SHORT if sum(sizes) < LEAST_ROWS else MANY_LABELS if len(sizes) > LEVELS else ONE_LABEL if len(sizes) < 2
                else SMALL_GROUP if min(sizes) < LEAST_GROUP else None)

    out = [_skipped(p, "group_difference", reason(found.get(p, [])), sum(g["n"] for g in found.get(p, []))) for p in mixed if reason(found.get(p, []))]
    found = {p: gs for p, gs in found.items() if not reason(gs)}
    if not found:
        return out

    def frame(chosen):
        return spark.createDataFrame([tuple(g[k] for k in ("category", "label", "numeric", "n", "mean", "variance", "g1"))
                                      for p in chosen for g in found[p]], schema)

    def mild(g):
        return g["g1"] is not None and abs(g["g1"]) < 2 and g["n"] >= 30

    sound = [p for p, gs in found.items() if all(g["n"] >= 8 and (g["variance"] or 0) > 0 for g in gs)]
    doubtful = [p for p in sound if not all(mild(g) for g in found[p])]
    tested = {}
    if doubtful:
        tested = {(r["category"], r["numeric"], r["label"]): r["shapiro_p"] for r in shapiro_groups(df, doubtful, key or df.columns).collect()}
    normal = [p for p in sound if all(mild(g) or (tested.get((*p, g["label"])) or 0) >= 0.05 for g in found[p])]
    several = [p for p, gs in found.items() if len(gs) > 2]
    level, ranks = {}, None
    certain = [p for p in found if p not in normal]

    def spreads():
        if not normal:
            return {}
        away = levene(df, list(dict.fromkeys(c for c, _ in normal)), list(dict.fromkeys(x for _, x in normal)), rows).collect()
        return {(r["category"], r["numeric"]): float(tails.f_upper([r["statistic"]], [r["df1"]], [r["df2"]])[0])
                for r in away if r["statistic"] is not None}

    def rank_table(chosen):
        table = rank_rows(df, chosen, rows) if chosen else None
        return table and [tuple(r) for r in table.collect()]

    level, ranks = run_together(spark, spreads, lambda: rank_table(certain) or [])
    more = [p for p in several if p in normal and not level.get(p, 0) >= 0.05]
    if more:
        ranks = ranks + rank_table(more)
    rank_frame = "category string, numeric string, label string, n long, rank_sum double, tie_term double"
    base = {"left": F.col("category"), "right": F.col("numeric"), "kind": F.lit("group_difference"), "n": F.col("n"), "status": F.lit("completed")}
    jobs = []
    two = [p for p in normal if p not in several]
    equal = {p for p in two if level.get(p, 0) >= 0.1}
    if two:
        def t_tests():
            t = mean_difference_interval(two_groups(frame(two)))
            alike = (F.col("variance_ratio") <= 1.15) & F.concat_ws("|", "category", "numeric").isin(["|".join(p) for p in equal] or [""])
            stat = F.when(alike, F.col("student_t")).otherwise(F.col("welch_t"))
            d = F.when(alike, F.col("student_df")).otherwise(F.col("welch_df"))
            return _shape(t, **base, method=F.when(alike, "Student's t-test").otherwise("Welch's t-test"), statistic=stat, df1=d,
                          p=(tails.t_two_sided, (stat, d)), effect=F.coalesce("cohens_d", F.lit(0.0)), measure=F.lit("cohens_d"),
                          lower=F.col("difference_low"), upper=F.col("difference_high"))
        jobs.append(t_tests)
    even = [p for p in several if p in normal and p not in more]
    if even:
        jobs.append(lambda: _shape(anova(frame(even)), **base, method=F.lit("One-way ANOVA"), statistic=F.col("statistic"), df1=F.col("df1"),
                                   df2=F.col("df2"), p=(tails.f_upper, tuple(F.col(c) for c in ("statistic", "df1", "df2"))), effect=F.col("eta_squared"),
                                   measure=F.lit("eta_squared")))
    two_ranks = [r for r in ranks if (r[0], r[1]) not in several]
    many_ranks = [r for r in ranks if (r[0], r[1]) in several]
    if two_ranks:
        jobs.append(lambda: _shape(mann_whitney(spark.createDataFrame(two_ranks, rank_frame)), p=(rank_p, tuple(F.col(c) for c in ("statistic", "n1", "n2", "z", "untied"))),
                                   **base, method=F.lit("Mann-Whitney U"), statistic=F.col("statistic"), effect=F.col("rank_biserial"),
                                   measure=F.lit("rank_biserial")))
    if many_ranks:
        jobs.append(lambda: _shape(kruskal(spark.createDataFrame(many_ranks, rank_frame)).filter(F.col("statistic").isNotNull()), **base,
                                   method=F.lit("Kruskal-Wallis"), statistic=F.col("statistic"), df1=F.col("df"),
                                   p=(tails.chi_square_upper, (F.col("statistic"), F.col("df"))), effect=F.col("epsilon_squared"),
                                   measure=F.lit("epsilon_squared")))
    at = {name.split()[0]: i for i, name in enumerate(part.strip() for part in RESULT.replace("\n", " ").split(","))}
    tested_pairs = set()
    for row in itertools.chain(*run_together(spark, *jobs)):
        row, pair = list(row), (row[at["left"]], row[at["right"]])
        tested_pairs.add(pair)
        row[at["normal"]] = pair in normal
        row[at["groups"]] = json.dumps([{"label": g["label"], "n": g["n"], "mean": g["mean"]} for g in sorted(found[pair], key=lambda g: g["label"])])
        out.append(tuple(row))
    return out + [_skipped(p, "group_difference", NO_SPREAD, sum(g["n"] for g in gs)) for p, gs in found.items() if p not in tested_pairs]


def notes(sampled: bool, dated: bool, repeated: bool, sparse):
    """Limitations that apply to a test."""
    return F.filter(F.array(
        F.lit("Exploratory analysis of pairwise complete rows; other variables may explain it."),
        F.when(F.lit(sampled), "Computed on a deterministic sample."),
        F.when(F.lit(dated), "Temporal dependence may violate independence."),
        F.when(F.lit(repeated), "Duplicate records may violate independence."),
        F.when(sparse, "Expected counts are sparse; significance is provisional.")), lambda x: x.isNotNull())


def association_matrix(tests: DataFrame) -> DataFrame:
    """x, y, method and effect of every completed test."""
    return tests.filter(F.col("status") == "completed").select(
        F.col("left").alias("x"), F.col("right").alias("y"), "method", F.col("effect").alias("value"))
