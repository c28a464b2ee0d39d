"""Column-by-column profile of a table: a few passes, none of which gathers rows.

Results here have one row per column, or per column and value; only such results reach the
driver, where they decide what the next pass has to compute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import dates, numbers, text
from assayer.operators import quantiles as q
from assayer.operators import ranking
from assayer.operators.normalize import long_form, quoted
from assayer.operators.together import run_together

EXTREME = 1e100
LARGEST = 1.7976931348623157e308
QUANTILES = [0.01, 0.25, 0.5, 0.75, 0.99]
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _q(name: str):
    return F.col(f"`{name}`")


def types_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


# ---- column kinds -----------------------------------------------------------------------

def first_values(df: DataFrame, columns, key, n: int, cell) -> dict[str, list]:
    """First n non-null cells per column in key order, as ``cell(column)`` gives them.

    One top-k over all columns; a column with many nulls at the start gets its own top-k. The
    cells are computed on the few rows that are left.
    """
    raw = df.select(*[_q(c) for c in columns], *[_q(k).alias(f"__k{i}") for i, k in enumerate(key)])
    order = [f"__k{i}" for i in range(len(key))]
    rows = (raw.orderBy(*order).limit(4 * n)
            .select(*[F.when(_q(c).isNotNull(), cell(c)).alias(c) for c in columns]).collect())
    found = {c: [r[c] for r in rows if r[c] is not None][:n] for c in columns}
    if len(rows) == 4 * n:
        for c in columns:
            if len(found[c]) < n:
                some = raw.filter(_q(c).isNotNull()).orderBy(*order).limit(n)
                found[c] = [r[0] for r in some.select(cell(c)).collect()]
    return found


def date_evidence(df: DataFrame, columns, key, n: int = 80) -> dict[str, tuple[float, float]]:
    """Per text column: share of the first n values that look like dates, and that parse."""
    def cell(c):
        return F.struct(_q(c).rlike(text.DATE_VALUE).alias("looks"), dates.parse(_q(c)).isNotNull().alias("parses"))
    found = first_values(df, columns, key, n, cell) if columns else {}
    return {c: (sum(v.looks for v in vs) / max(len(vs), 1), sum(v.parses for v in vs) / max(len(vs), 1))
            for c, vs in found.items()}


def column_kinds(df: DataFrame, key=None) -> dict[str, str]:
    """numeric, datetime or categorical per column; text counts as datetime by name or look and parse."""
    import re
    types = types_of(df)
    strings = [c for c, t in types.items() if isinstance(t, T.StringType)]
    evidence = date_evidence(df, strings, key or df.columns)
    kinds = {}
    for c, t in types.items():
        if isinstance(t, T.NumericType):
            kinds[c] = "numeric"
        elif isinstance(t, TIME_TYPES):
            kinds[c] = "datetime"
        elif c in evidence:
            looks, parses = evidence[c]
            named = re.search(text.DATE_NAME, c) is not None
            kinds[c] = "datetime" if (named or looks >= 0.9) and parses >= 0.9 else "categorical"
        else:
            kinds[c] = "categorical"
    return kinds


def of_kind(kinds: dict[str, str], kind: str) -> list[str]:
    return [c for c, k in kinds.items() if k == kind]


# ---- pass 1: one aggregate over all columns ------------------------------------------------

def _real(df: DataFrame, c: str) -> str:
    """SQL text of the column without NaN and infinities."""
    return numbers.finite_sql(c) if isinstance(types_of(df)[c], (T.DoubleType, T.FloatType)) else f"`{c}`"


def _count_part(df: DataFrame, columns):
    types = types_of(df)
    real = {c for c in columns if isinstance(types[c], (T.DoubleType, T.FloatType))}
    aggregates = ["count(1) AS __rows", *[f"count(`v_{c}`) AS `n_{c}`" for c in columns],
                  *[f"count_if(`i_{c}`) AS `inf_{c}`" for c in columns if c in real]]
    inputs = [f"{_real(df, c)} AS `v_{c}`" for c in columns]
    inputs += [f"abs(`{c}`) = double('Infinity') AS `i_{c}`" for c in columns if c in real]
    cells = {c: {
        "rows": "__rows", "non_null": f"`n_{c}`", "missing": f"__rows - `n_{c}`",
        "missing_pct": f"round((__rows - `n_{c}`) / greatest(__rows, 1) * 100, 2)",
        "infinite_values": f"`inf_{c}`" if c in real else "0L"} for c in columns}
    return inputs, aggregates, cells


def _moment_part(columns):
    aggregates, cells = [], {}
    for c in columns:
        v, n = f"`v_{c}`", f"double(`n_{c}`)"
        aggregates += [
            f"avg({v}) AS `mean_{c}`", f"var_samp({v}) AS `var_{c}`", f"skewness({v}) AS `g1_{c}`", f"kurtosis({v}) AS `g2_{c}`",
            f"count_if({v} = 0) AS `zero_{c}`", f"count_if({v} < 0) AS `neg_{c}`", f"min({v}) AS `min_{c}`", f"max({v}) AS `max_{c}`"]
        cells[c] = {
            "n": f"`n_{c}`", "mean": f"double(`mean_{c}`)", "std": f"sqrt(`var_{c}`)", "variance": f"`var_{c}`",
            # Bias corrections of the population moments.
            "skewness": f"if({n} >= 3, try_divide(`g1_{c}` * sqrt({n} * ({n} - 1)), {n} - 2), NULL)",
            "kurtosis": f"if({n} >= 4, try_divide(({n} - 1) * (({n} + 1) * `g2_{c}` + 6), ({n} - 2) * ({n} - 3)), NULL)",
            "zero_pct": f"try_divide(double(`zero_{c}`), {n}) * 100", "negative_pct": f"try_divide(double(`neg_{c}`), {n}) * 100",
            "min": f"double(`min_{c}`)", "max": f"double(`max_{c}`)"}
    return aggregates, cells


def _text_part(columns):
    aggregates, cells = [], {}
    for c in columns:
        v = f"string(`v_{c}`)"
        aggregates += [f"avg(length({v})) AS `len_{c}`",
                       f"avg(if({v} IS NOT NULL, double(try_cast({v} AS double) IS NOT NULL), NULL)) AS `num_{c}`"]
        cells[c] = {"mean_length": f"`len_{c}`", "numeric_share": f"`num_{c}`",
                    "mixed_numeric_text": f"`num_{c}` >= 0.2 AND `num_{c}` < 0.95"}
    return aggregates, cells


def _aggregated(df: DataFrame, inputs, aggregates) -> DataFrame:
    return df.selectExpr(*inputs).selectExpr(*aggregates)


def counts(df: DataFrame) -> DataFrame:
    """rows, non_null, missing, missing_pct and infinite values per column."""
    inputs, aggregates, cells = _count_part(df, df.columns)
    return long_form(_aggregated(df, inputs, aggregates), cells)


def moments(df: DataFrame, columns) -> DataFrame:
    """Mean, spread, shape, sign shares and range per numeric column, in one scan."""
    aggregates, cells = _moment_part(columns)
    sizes = [f"count(`v_{c}`) AS `n_{c}`" for c in columns]
    return long_form(_aggregated(df, [f"{_real(df, c)} AS `v_{c}`" for c in columns], sizes + aggregates), cells)


def column_scan(df: DataFrame, numeric, texts, batch: int = 4) -> dict[str, dict]:
    """Counts, moments and text shape of all columns, by column name.

    A few columns per aggregate: columnar files hand over each column once either way, and small
    aggregates compile to code the virtual machine can optimise.
    """
    def part(names):
        inputs, aggregates, cells = _count_part(df, names)
        for more, extra in (_moment_part([c for c in names if c in numeric]), _text_part([c for c in names if c in texts])):
            aggregates += more
            for c, fields in extra.items():
                cells[c] = {**cells[c], **fields}
        row = _aggregated(df, inputs, aggregates).selectExpr(*[
            "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + f") AS `{c}`" for c, fields in cells.items()]).first()
        return {c: row[c].asDict() for c in cells}

    names = df.columns
    parts = run_together(df.sparkSession, *[lambda p=names[i:i + batch]: part(p) for i in range(0, len(names), batch)])
    return {c: facts for found in parts for c, facts in found.items()}


def scaled_moments(df: DataFrame, columns) -> DataFrame:
    """Moments of columns with huge magnitudes, taken on values divided by the largest one.

    Whatever cannot be written as a double afterwards is null.
    """
    top = df.agg(*[F.max(F.abs(numbers.finite(_q(c)))).alias(c) for c in columns]).first()
    scale = {c: max(top[c] or 1.0, 1.0) for c in columns}
    small = df.select(*[(numbers.finite(_q(c)) / F.lit(scale[c])).alias(c) for c in columns])
    factor = F.element_at(F.create_map(*[v for c in columns for v in (F.lit(c), F.lit(scale[c]))]), F.col("column"))
    out = moments(small, columns).withColumn("scale", factor)
    for name in ("mean", "std", "min", "max"):
        out = out.withColumn(name, numbers.finite(F.col(name) * F.col("scale")))
    return (out.withColumn("variance", numbers.finite(F.col("variance") * F.col("scale") * F.col("scale")))
            .withColumn("extreme_magnitude", F.col("scale") > EXTREME))


def text_shape(df: DataFrame, columns) -> DataFrame:
    """Mean length and share of cells that read as numbers, per text column."""
    aggregates, cells = _text_part(columns)
    return long_form(_aggregated(df, [f"`{c}` AS `v_{c}`" for c in columns], aggregates), cells)


# ---- pass 2: frequencies --------------------------------------------------------------------

def _cell(name: str, kind: str) -> str:
    """A cell as it counts: NaN and infinities are missing, minus zero is zero."""
    return f"if(abs(`{name}`) < {kind}('Infinity'), `{name}` + {kind}(0), NULL)" if kind in ("double", "float") else f"`{name}`"


def frequencies(df: DataFrame, columns) -> DataFrame:
    """column, value, n over non-null cells. Partial counts come first, so a value that fills a
    third of the table crosses the network once per task."""
    types = dict(df.dtypes)
    cells = ", ".join(f"named_struct('column', {quoted(c)}, 'value', string({_cell(c, types[c])}))" for c in columns)
    return (df.selectExpr(f"inline(array({cells}))")
            .filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def frequency_summary(freq: DataFrame) -> DataFrame:
    """Distinct count, dominant value and share, rarest count, entropy in bits, rare share.

    Values are first counted by how often they occur; that table is short and holds everything.
    """
    levels = freq.groupBy("column", "n").agg(F.count(F.lit(1)).alias("values"), F.min("value").alias("first"))
    totals = F.broadcast(levels.groupBy("column").agg(F.sum(F.col("n") * F.col("values")).alias("total")))  # a row per column
    n, total, rows = F.col("n"), F.col("total"), F.col("n") * F.col("values")
    return (levels.join(totals, "column").groupBy("column").agg(
        F.sum("values").alias("unique"), F.first("total").alias("non_null"), F.min("n").alias("minimum_class_count"),
        F.max("n").alias("dominant_count"), F.max_by("first", "n").alias("dominant_category"),
        (F.log2(F.first("total")) - F.sum(rows * F.log2(n)) / F.first("total")).alias("entropy"),
        F.coalesce(F.sum(F.when(n / total < 0.01, rows)), F.lit(0)).alias("rare_rows"))
        .withColumn("dominant_share", F.col("dominant_count") / F.col("non_null"))
        .withColumn("rare_category_pct", F.col("rare_rows") / F.col("non_null") * 100)
        .withColumn("near_constant", F.col("dominant_share") >= 0.95)
        .withColumn("constant", F.col("unique") <= 1).drop("rare_rows"))


def top_values(df: DataFrame, columns, n: int = 10, missing: str | None = "(missing)") -> DataFrame:
    """The n most frequent labels per column, cut to 50 characters, nulls under one label."""
    filled = df.select(*[(F.coalesce(_q(c).cast("string"), F.lit(missing)) if missing else _q(c).cast("string")).alias(c)
                         for c in columns])
    place = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (frequencies(filled, columns).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n)
            .select("column", "place", F.substring("value", 1, 50).alias("label"), F.col("n").alias("rows")))


def class_counts(freq: DataFrame, most: int = 20) -> DataFrame:
    """value -> count map and the smallest count of every column with at most ``most`` values."""
    few = freq.groupBy("column").agg(F.count(F.lit(1)).alias("unique")).filter(F.col("unique") <= most)
    return (freq.join(F.broadcast(few), "column").groupBy("column", "unique").agg(  # a row per column
        F.min("n").alias("minimum_class_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("category_counts")))


# ---- duplicates -----------------------------------------------------------------------------

def duplicates(df: DataFrame) -> DataFrame:
    """rows, distinct rows, exact duplicates and their percent (nulls count as equal)."""
    copies = df.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    return (copies.agg(F.coalesce(F.sum("__copies"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
            .withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))
            .withColumn("duplicate_pct", numbers.ratio("duplicates", "rows") * 100))


def usable_counts(df: DataFrame) -> DataFrame:
    """Non-null cells per column after exact duplicates are removed."""
    return counts(df.dropDuplicates()).select("column", F.col("non_null").alias("usable_non_missing_rows"))


def usable_frequencies(df: DataFrame, coded) -> DataFrame:
    """Counts after duplicate removal in one shuffle of the distinct rows: per value for the
    columns in ``coded``, per column for the others, and the row count under column '*'."""
    types = dict(df.dtypes)
    cells = ["named_struct('column', '*', 'value', '')"]
    for c in df.columns:
        cell = _cell(c, types[c])
        value = f"string({cell})" if c in coded else f"if({cell} IS NOT NULL, '', NULL)"
        cells.append(f"named_struct('column', {quoted(c)}, 'value', {value})")
    return (df.dropDuplicates().selectExpr(f"inline(array({', '.join(cells)}))")
            .filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


# ---- quantiles, outliers, histogram -----------------------------------------------------------

def quantile_table(df: DataFrame, columns, shares=QUANTILES, rows=None) -> DataFrame:
    """One row per column with its quantiles q1, q25, ... (linear interpolation)."""
    clean = df.selectExpr(*[f"{_real(df, c)} AS `{c}`" for c in columns])
    wide = q.quantiles(clean, columns, shares, rows=rows)
    label = {s: "q" + f"{s * 100:g}".replace(".", "_") for s in shares}
    return long_form(wide, {c: {label[s]: f"get(`{c}`, {i})" for i, s in enumerate(shares)} for c in columns})


def iqr_bounds(df: DataFrame, columns, rows=None) -> DataFrame:
    """q1 - 1.5 iqr and q3 + 1.5 iqr per column."""
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    return quantile_table(df, columns, [0.25, 0.75], rows).select(
        "column", (F.col("q25") - reach).alias("lower"), (F.col("q75") + reach).alias("upper"))


def _number(v) -> str:
    return "double(NULL)" if v is None else f"double('{v!r}')"


def _outside(c: str, bounds) -> str:
    v = numbers.finite_sql(c)
    return f"coalesce({v} < {_number(bounds[c][0])} OR {v} > {_number(bounds[c][1])}, false)"


def outliers(df: DataFrame, columns, rows=None, bounds=None) -> DataFrame:
    """Cells outside the IQR bounds per column (percent of all rows), and the rows with any under '*'."""
    if bounds is None:
        bounds = {r["column"]: (r["lower"], r["upper"]) for r in iqr_bounds(df, columns, rows).collect()}
    flagged = df.selectExpr(*[f"{_outside(c, bounds)} AS `o_{c}`" for c in columns])
    wide = flagged.selectExpr("count(1) AS __rows", f"count_if({' OR '.join(f'`o_{c}`' for c in columns)}) AS `o_*`",
                              *[f"count_if(`o_{c}`) AS `o_{c}`" for c in columns])
    bounds = {**bounds, "*": (None, None)}
    return long_form(wide, {c: {
        "outliers": f"`o_{c}`", "outlier_pct": f"round(`o_{c}` / greatest(__rows, 1) * 100, 2)",
        "lower": _number(bounds[c][0]), "upper": _number(bounds[c][1])} for c in [*columns, "*"]})


def outlier_rows(df: DataFrame, columns, rows=None) -> DataFrame:
    """The rows with at least one outlying cell and the names of those cells."""
    bounds = {r["column"]: (r["lower"], r["upper"]) for r in iqr_bounds(df, columns, rows).collect()}
    named = F.filter(F.array(*[F.when(F.expr(_outside(c, bounds)), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return df.withColumn("outlying", named).filter(F.size("outlying") > 0)


def histogram(df: DataFrame, columns, distinct: dict[str, int] | None = None, ranges=None, most: int = 18) -> DataFrame:
    """Equal-width bins per column: bin number, lower and upper edge, rows; empty bins included.

    min(18, distinct values) bins, the last one closed; a constant column gets half a unit on
    either side.
    """
    if distinct is None:
        found = frequency_summary(frequencies(df.select(*[numbers.finite(_q(c)).alias(c) for c in columns]), columns))
        distinct = {r["column"]: r["unique"] for r in found.select("column", "unique").collect()}
    if ranges is None:
        one = df.agg(*[F.struct(F.min(numbers.finite(_q(c))).alias("lo"), F.max(numbers.finite(_q(c))).alias("hi")).alias(c)
                       for c in columns]).first()
        ranges = {c: (one[c].lo, one[c].hi) for c in columns}
    cells, spine = [], []
    for c in columns:
        lo, hi = ranges[c]
        if lo is None:
            continue
        bins = min(most, max(1, int(distinct.get(c, 1))))
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        scale = max(abs(lo), abs(hi), 1.0) if max(abs(lo), abs(hi)) > EXTREME else 1.0
        v = numbers.finite_sql(c) if scale == 1.0 else f"{numbers.finite_sql(c)} / {_number(scale)}"
        # least skips nulls: a missing cell must stay without a bin.
        place = f"if({v} IS NULL, NULL, int(least(width_bucket({v}, {_number(lo / scale)}, {_number(hi / scale)}, {bins}), {bins}L)))"
        cells.append(f"named_struct('column', {quoted(c)}, 'bin', {place})")
        width = (hi / scale - lo / scale) / bins
        spine += [(c, i + 1, (lo / scale + width * i) * scale, (lo / scale + width * (i + 1)) * scale) for i in range(bins)]
    counted = (df.selectExpr(f"inline(array({', '.join(cells)}))")
               .filter(F.col("bin").isNotNull()).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("rows")))
    edges = df.sparkSession.createDataFrame(spine, "column string, bin int, lower double, upper double")
    return (edges.join(counted, ["column", "bin"], "left")
            .withColumn("rows", F.coalesce("rows", F.lit(0))))


# ---- dates --------------------------------------------------------------------------------------

def frequency_label(n, low, high, months_low, months_high, first_days, one_month, first, weekdays):
    """Calendar frequency of distinct instants from the extremes of their steps.

    ``low``/``high``: smallest and largest step in microseconds; ``months_*``: the same in
    calendar months; ``first_days``: every instant is on the first of a month.
    """
    day = 86_400_000_000

    def counted(times, unit):
        return F.concat(F.when(times == 1, F.lit("")).otherwise(times.cast("long").cast("string")), unit)

    month_name = F.upper(F.date_format(first, "MMM"))
    # Quarters are named by the last start of the year: January starts count as October.
    quarter_name = F.element_at(F.array(F.lit("DEC"), F.lit("OCT"), F.lit("NOV")), (F.month(first) % 3 + 1).cast("int"))
    even_months = first_days & (months_low == months_high) & (months_low > 0)
    single = low == high
    fine = F.lit(None).cast("string")
    for size, unit in ((1, "us"), (1_000, "ms"), (1_000_000, "s"), (60_000_000, "min"), (3_600_000_000, "h")):
        fine = F.when(low % size == 0, counted(low / size, F.lit(unit))).otherwise(fine)
    weekly = F.concat(F.lit("W-"), F.upper(F.date_format(first, "EEE")))
    daily = (F.when(even_months & one_month & (months_low % 12 == 0), counted(months_low / 12, F.concat(F.lit("YS-"), month_name)))
             .when(even_months & (months_low % 3 == 0), counted(months_low / 3, F.concat(F.lit("QS-"), quarter_name)))
             .when(even_months, counted(months_low, F.lit("MS")))
             .when(single & (low % (7 * day) == 0), counted(low / (7 * day), weekly))
             .when(single, counted(low / day, F.lit("D")))
             .when(weekdays, F.lit("B")))
    return F.when(n >= 3, F.when(low % day == 0, daily).when(single, fine))


def temporal_profile(df: DataFrame, ts: str, as_of=None, by=(), rows: int | None = None) -> DataFrame:
    """Range, invalid, duplicate and future dates, median step, missing periods, frequency.

    ``as_of`` stands in for the present, so that a result can be repeated.
    """
    by = list(by)
    rows = df.count() if rows is None else rows
    at = df.select(*by, _q(ts).isNotNull().alias("__given"),
                   dates.instant(_q(ts), types_of(df)[ts].simpleString()).alias("__ts"))
    future = F.count_if(F.col("__ts") > F.lit(as_of).cast("timestamp")) if as_of is not None else F.lit(None).cast("long")
    totals = at.groupBy(*by).agg(F.min("__ts").alias("first_ts"), F.max("__ts").alias("last_ts"),
                                 F.count_if(F.col("__given")).alias("given"), F.count("__ts").alias("parsed"),
                                 future.alias("future_timestamps"))
    steps = ranking.gaps(at, "__ts", by, rows)
    median = q.medians(steps, ["gap_seconds"], by, rows).withColumnRenamed("gap_seconds", "median_interval_seconds")
    months = F.year("__ts") * 12 + F.month("__ts")
    previous = F.timestamp_micros(F.unix_micros("__ts") - F.round(F.col("gap_seconds") * F.lit(1e6)).cast("long"))
    month_step = F.when(F.col("gap_seconds").isNotNull(), months - (F.year(previous) * 12 + F.month(previous)))
    weekday_step = F.when(F.weekday("__ts") == 0, F.lit(3)).otherwise(F.lit(1)) * 86400
    shape = steps.withColumn("__m", month_step)
    shape = (ranking.join_groups(shape, median, by) if by else
             shape.withColumn("__all", F.lit(0)).join(F.broadcast(median.withColumn("__all", F.lit(0))), "__all"))
    m, g = F.col("median_interval_seconds"), F.col("gap_seconds")
    shape = shape.groupBy(*by).agg(
        F.count(F.lit(1)).alias("distinct_ts"), F.first("median_interval_seconds").alias("median_interval_seconds"),
        F.coalesce(F.sum(F.when(m > 0, F.greatest(F.rint(g / m) - 1, F.lit(0)))), F.lit(0)).cast("long").alias("missing_periods"),
        F.round(F.min(g) * F.lit(1e6)).cast("long").alias("__low"), F.round(F.max(g) * F.lit(1e6)).cast("long").alias("__high"),
        F.min("__m").alias("__mlow"), F.max("__m").alias("__mhigh"), F.min("__ts").alias("__first"),
        F.bool_and(F.dayofmonth("__ts") == 1).alias("__first_days"),
        (F.min(F.month("__ts")) == F.max(F.month("__ts"))).alias("__one_month"),
        F.coalesce(F.bool_and((F.weekday("__ts") < 5) & (g.isNull() | (g == weekday_step))), F.lit(False)).alias("__weekdays"))
    out = (ranking.join_groups(totals, shape, by) if by else
           totals.withColumn("__all", F.lit(0)).join(F.broadcast(shape.withColumn("__all", F.lit(0))), "__all", "left").drop("__all"))
    label = frequency_label(F.col("distinct_ts"), F.col("__low"), F.col("__high"), F.col("__mlow"), F.col("__mhigh"),
                            F.col("__first_days"), F.col("__one_month"), F.col("__first"), F.col("__weekdays"))
    n = F.coalesce("distinct_ts", F.lit(0))
    return out.select(
        *by, F.col("first_ts").alias("min_ts"), F.col("last_ts").alias("max_ts"),
        (F.col("given") - F.col("parsed")).alias("invalid_dates"), (F.col("parsed") - n).alias("duplicate_dates"),
        label.alias("frequency"), F.col("median_interval_seconds"), label.isNotNull().alias("regular"),
        F.coalesce("missing_periods", F.lit(0)).alias("missing_periods_estimate"), n.alias("distinct_dates"),
        (n >= 8).alias("trend_suitable"), (n >= 24).alias("seasonality_suitable"), "future_timestamps")


# ---- correlation ----------------------------------------------------------------------------------

def correlations(df: DataFrame, columns, digits: int | None = 3, batch: int = 400) -> DataFrame:
    """Pearson matrix over pairwise complete rows: both triangles and the diagonal."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    clean = df.selectExpr(*[f"{_real(df, c)} AS `v_{c}`" for c in columns])
    out = None
    for start in range(0, len(pairs), batch):  # keeps the generated code compilable
        part = pairs[start:start + batch]
        wide = clean.selectExpr(*[
            f"if(min(`v_{a}`) < max(`v_{a}`), 1.0D, NULL) AS r{i}" if a == b else numbers.corr_sql(f"`v_{a}`", f"`v_{b}`") + f" AS r{i}"
            for i, (a, b) in enumerate(part)])
        cells = [f"named_struct('x', {quoted(x)}, 'y', {quoted(y)}, 'value', r{i})"
                 for i, (a, b) in enumerate(part) for x, y in dict.fromkeys([(a, b), (b, a)])]
        one = wide.selectExpr(f"inline(array({', '.join(cells)}))")
        out = one if out is None else out.unionByName(one)
    return out if digits is None else out.withColumn("value", F.round("value", digits))


def strongest_pairs(matrix: DataFrame, n: int = 5) -> DataFrame:
    """The n largest absolute correlations, every pair once."""
    return (matrix.filter((F.col("x") < F.col("y")) & F.col("value").isNotNull())
            .orderBy(F.desc(F.abs(F.col("value"))), "x", "y").limit(n))


# ---- the profile as one table ---------------------------------------------------------------------

SCHEMA = """column string, position int, dtype string, kind string, rows long, missing long, missing_pct double,
unique long, cardinality_ratio double, usable_non_missing_rows long, constant boolean, near_constant boolean,
possible_id boolean, high_cardinality boolean, possible_free_text boolean, mixed_numeric_text boolean,
infinite_values long, extreme_magnitude boolean, mean double, median double, std double, variance double,
skewness double, kurtosis double, zero_pct double, negative_pct double, min double, max double, q1 double,
q25 double, q75 double, q99 double, outliers long, outlier_pct double, lower double, upper double,
dominant_category string, dominant_share double, entropy double, rare_category_pct double,
minimum_class_count long, usable_minimum_class_count long, category_counts map<string,long>,
examples array<string>, distribution array<struct<label:string,value:long,upper:double>>,
min_ts timestamp, max_ts timestamp, invalid_dates long, duplicate_dates long, frequency string,
median_interval_seconds double, regular boolean, missing_periods_estimate long, trend_suitable boolean,
seasonality_suitable boolean, future_timestamps long, total_rows long, duplicates long, outlier_rows long"""


def _frequency_facts(freq: DataFrame) -> dict[str, dict]:
    return {r["column"]: r.asDict() for r in frequency_summary(freq).collect()}


def _frequent_values(freq: DataFrame, columns, most: int = 20) -> dict[str, list]:
    """The ``most`` top (value, rows) per column; each task keeps that many per column."""
    if not columns:
        return {}
    place = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = freq.filter(F.col("column").isin(columns)).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)
    values: dict[str, list] = {}
    for r in sorted(top.collect(), key=lambda r: r["place"]):
        values.setdefault(r["column"], []).append((r["value"], r["n"]))
    return values


def _usable_facts(df: DataFrame, coded, summary: dict[str, dict], rows: int) -> dict[str, tuple[int, int]]:
    """Rows and rarest value per column without exact duplicates; without any of those the counts at hand are the answer."""
    if duplicates(df).first()["distinct_rows"] == rows:
        return {"*": (rows, rows), **{c: (s["non_null"], s["minimum_class_count"]) for c, s in summary.items()}}
    per_column = usable_frequencies(df, coded).groupBy("column").agg(F.sum("n").alias("rows"), F.min("n").alias("least"))
    return {r["column"]: (r["rows"], r["least"]) for r in per_column.collect()}


def profile(df: DataFrame, key=None, as_of=None) -> DataFrame:
    """One row per column. Independent passes run side by side; only column facts reach the driver."""
    import re
    spark: SparkSession = df.sparkSession
    key = list(key or [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])
    types, kinds = types_of(df), column_kinds(df, key)
    numeric, texts, times = (of_kind(kinds, k) for k in ("numeric", "categorical", "datetime"))

    # Every cell crosses the network once: all facts about values come from this table.
    freq = frequencies(df, df.columns).persist()
    scanned, summary, examples = run_together(
        spark, lambda: column_scan(df, numeric, texts),
        lambda: _frequency_facts(freq),
        lambda: first_values(df, df.columns, key, 3, lambda c: F.substring(_q(c).cast("string"), 1, 100)))
    rec = {c: {"column": c, "position": i, "dtype": types[c].simpleString(), "kind": kinds[c], "unique": 0, "examples": examples[c],
               **scanned[c], **summary.get(c, {})} for i, c in enumerate(df.columns)}
    rows = rec[df.columns[0]]["rows"]
    present = [c for c in numeric if rec[c]["min"] is not None]
    extreme = [c for c in present if max(abs(rec[c]["min"]), abs(rec[c]["max"])) > EXTREME]
    ordinary = [c for c in present if c not in extreme]
    coded = [c for c in df.columns if 1 <= rec[c]["unique"] <= 20]

    def middle():
        shares = [0.5] if not ordinary else QUANTILES
        inputs = df.selectExpr(*[f"{_real(df, c)} AS `{c}`" for c in ordinary], *[f"length(string(`{c}`)) AS `{c}`" for c in texts])
        return q.quantiles(inputs, [*ordinary, *texts], shares, rows=rows).first() if inputs.columns else None

    def scaled():
        return {r["column"]: r.asDict() for r in scaled_moments(df, extreme).collect()} if extreme else {}

    usable, huge, half, values, *dated = run_together(
        spark, lambda: _usable_facts(df, coded, summary, rows), scaled, middle, lambda: _frequent_values(freq, list(dict.fromkeys([*coded, *texts, *times]))),
        *[lambda c=c: temporal_profile(df, c, as_of, rows=rows).first().asDict() for c in times])
    freq.unpersist()
    for c, facts in huge.items():
        rec[c].update({k: v for k, v in facts.items() if k not in ("column", "scale")})
    for c, facts in zip(times, dated):
        rec[c].update({k: v for k, v in facts.items() if k != "distinct_dates"})
    bounds = {}
    for c in ordinary:
        for name, v in zip(("q1", "q25", "median", "q75", "q99"), half[c]):
            rec[c][name] = v
        reach = 1.5 * (rec[c]["q75"] - rec[c]["q25"])
        bounds[c] = (rec[c]["q25"] - reach, rec[c]["q75"] + reach)
    for c in texts:
        rec[c]["median_length"] = half[c][QUANTILES.index(0.5) if ordinary else 0] if half and half[c] else 0

    outlier_count = 0
    if present:
        ranges = {c: (rec[c]["min"], rec[c]["max"]) for c in present}
        outside, bins = run_together(
            spark, lambda: outliers(df, ordinary, rows, bounds).collect() if ordinary else [],
            lambda: histogram(df, present, {c: rec[c]["unique"] for c in present}, ranges).collect())
        for r in outside:
            if r["column"] == "*":
                outlier_count = r["outliers"]
            else:
                rec[r["column"]].update({k: r[k] for k in ("outliers", "outlier_pct", "lower", "upper")})
        for r in sorted(bins, key=lambda r: r["bin"]):
            rec[r["column"]].setdefault("distribution", []).append((f"{r['lower']:.3g}", r["rows"], r["upper"]))

    names = [f.name for f in T._parse_datatype_string(SCHEMA).fields]
    distinct_rows = usable.get("*", (rows, 0))[0]
    table = []
    for c, r in rec.items():
        ratio, category = r["unique"] / max(rows, 1), kinds[c] == "categorical"
        r["cardinality_ratio"] = ratio
        r["usable_non_missing_rows"] = usable.get(c, (0, 0))[0]
        r["constant"], r["near_constant"] = r["unique"] <= 1, bool(r.get("near_constant"))
        r["possible_id"] = bool(re.search(text.IDENTIFIER_NAME, c)) and ratio > 0.8 or (
            category and ratio > 0.98 and (r.get("mean_length") or 0) < 40)
        r["high_cardinality"] = category and r["unique"] > 100
        r["possible_free_text"] = category and (r.get("median_length") or 0) > 60
        r["extreme_magnitude"] = bool(r.get("extreme_magnitude"))
        if c in coded:
            r["category_counts"] = dict(values[c])
            r["usable_minimum_class_count"] = usable.get(c, (0, 0))[1]
        else:
            r["minimum_class_count"] = None
        if category:
            labels = [*values.get(c, []), *([("(missing)", r["missing"])] if r["missing"] else [])]
            labels.sort(key=lambda v: (-v[1], v[0]))
            r["distribution"] = [(label[:50], n, None) for label, n in labels[:10]]
        elif kinds[c] == "datetime":
            r["distribution"] = [(label[:50], n, None) for label, n in values.get(c, [])[:10]]
        if not category:
            r["entropy"] = r["rare_category_pct"] = r["dominant_category"] = None
        r.update(total_rows=rows, duplicates=rows - distinct_rows, outlier_rows=outlier_count)
        table.append(tuple(r.get(k) for k in names))
    return spark.createDataFrame(table, SCHEMA)


def profile_totals(profile_table: DataFrame) -> DataFrame:
    """Table-level facts from the column profile: one row."""
    def listed(flag):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(flag), F.struct("position", "column")))),
                                        lambda s: s["column"]), ", ")
    kinds = {k: F.avg((F.col("kind") == k).cast("double")).alias(f"{k}_ratio") for k in ("numeric", "categorical", "datetime")}
    one = profile_table.agg(
        F.max("total_rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("missing").alias("missing_cells"),
        F.max("duplicates").alias("duplicates"), F.max("outlier_rows").alias("outlier_rows"),
        F.sum(F.coalesce("infinite_values", F.lit(0)) + F.coalesce("invalid_dates", F.lit(0))).alias("invalid_values"),
        F.count_if(F.col("missing") > 0).alias("incomplete_columns"), *kinds.values(),
        listed("constant").alias("constant_columns"), listed("near_constant").alias("near_constant_columns"),
        listed("possible_id").alias("possible_ids"), listed("high_cardinality").alias("high_cardinality_columns"),
        listed("possible_free_text").alias("free_text_columns"))
    missing = F.col("missing_cells") / F.greatest(F.col("rows") * F.col("columns"), F.lit(1)) * 100
    repeated = numbers.ratio("duplicates", "rows") * 100
    return (one.withColumn("missing_pct", F.round(missing, 2)).withColumn("duplicate_pct", repeated)
            .withColumn("quality_score", quality_score(missing, repeated)))


def quality_score(missing_pct, duplicate_pct):
    return F.round(F.greatest(F.lit(0.0), 100 - missing_pct - duplicate_pct), 1)


def missing_report(profile_table: DataFrame) -> DataFrame:
    """Columns with missing cells, most missing first."""
    return (profile_table.filter(F.col("missing") > 0).select("column", "missing", "missing_pct")
            .orderBy(F.desc("missing"), "column"))


def column_summary(profile_table: DataFrame, name: str) -> DataFrame:
    """Kind, distinct count, missing share and range or most frequent values of one column."""
    top = F.array_join(F.transform(F.slice("distribution", 1, 4), lambda d: F.format_string("%s (%d)", d["label"], d["value"])), ", ")
    return profile_table.filter(F.col("column") == name).select(
        "column", "kind", "unique", "missing_pct", "mean", "median", "min", "max",
        F.when(F.col("kind") != "numeric", top).alias("top_values"))


def quality_issues(totals: DataFrame) -> DataFrame:
    """Seven review points with their value and advice."""
    def joined(*lists):
        merged = F.array_distinct(F.filter(F.concat(*[F.split(F.col(c), ", ") for c in lists]), lambda s: s != ""))
        return F.when(F.size(merged) == 0, F.lit("None detected")).otherwise(F.array_join(merged, ", "))

    def number(c):
        return F.format_number(F.col(c), 0)

    points = [
        ("Empty cells", F.concat(number("missing_cells"), F.lit(" cells ("), F.col("missing_pct").cast("string"), F.lit("%)")),
         "Find out why cells are empty; imputation is learned inside model fits only."),
        ("Repeated rows", number("duplicates"), "Check whether the repeats are meant; model fits leave them out and say so."),
        ("Rows beyond the quartile fences", number("outlier_rows"), "Look at unusual rows; none is deleted."),
        ("Cells without a finite value", number("invalid_values"), "Such cells count as missing; check where they come from."),
        ("Columns of nearly one value", joined("constant_columns", "near_constant_columns"), "Check whether the columns carry information."),
        ("Likely identifiers", joined("possible_ids"), "Confirm the identifiers and split by group where rows belong together."),
        ("Too many labels or long texts", joined("high_cardinality_columns", "free_text_columns"), "Such columns are left out of model fits."),
    ]
    return totals.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(n).alias("issue"), v.alias("value"), F.lit(a).alias("advice"))
                                            for i, (n, v, a) in enumerate(points)])))


def overview(totals: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Four or five sentences about the table with the kind of notice each one is."""
    complete = 100 - F.col("missing_cells") / F.greatest(F.col("rows") * F.col("columns"), F.lit(1)) * 100

    def notice(condition):
        return F.when(condition, "warning").otherwise("success")

    lines = [
        ("Table overview", F.format_string("%,d rows in %,d columns.", "rows", "columns"), F.lit("info")),
        ("Completeness", F.format_string("%.1f%% of cells are filled; %d columns have gaps.", complete, "incomplete_columns"),
         notice(100 - complete > 5)),
        ("Duplicate records", F.format_string("%,d rows repeat another one exactly.", "duplicates"), notice(F.col("duplicates") > 0)),
        ("Potential outliers", F.format_string("%,d rows have a number beyond the quartile fences.", "outlier_rows"),
         notice(F.col("outlier_rows") > 0)),
    ]
    out = totals.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(t).alias("title"), s.alias("sentence"), k.alias("kind"))
                                           for i, (t, s, k) in enumerate(lines)])))
    if pairs is not None:
        best = strongest_pairs(pairs, 1).select(F.lit(5).alias("place"), F.lit("Strongest numeric relationship").alias("title"),
                                                F.format_string("%s and %s have a Pearson correlation of %.2f.", "x", "y", "value").alias("sentence"),
                                                F.lit("info").alias("kind"))
        out = out.unionByName(best)
    return out


# ---- targets and roles -----------------------------------------------------------------------------

def infer_task(kind, unique, non_null):
    """classification for anything but a varying number."""
    few = (F.col(unique) <= 15) & (F.col(unique) / F.greatest(F.col(non_null), F.lit(1)) < 0.1)
    return F.when((F.col(kind) != "numeric") | few, "classification").otherwise("regression")


def roles(profile_table: DataFrame) -> DataFrame:
    """Role flags per column: usable number, bounded category, date, usable model input."""
    usable = ~F.col("possible_id")
    return profile_table.select(
        "column", "kind",
        ((F.col("kind") == "numeric") & usable & (F.col("unique") > 1)).alias("usable_numeric"),
        ((F.col("kind") == "categorical") & usable & F.col("unique").between(2, 20)).alias("bounded_category"),
        (F.col("kind") == "datetime").alias("is_date"),
        (~F.col("constant") & usable & ~((F.col("kind") == "categorical") & (F.col("unique") > 100))).alias("usable_feature"))


def rank_targets(profile_table: DataFrame, objective: str = "", n: int = 8) -> DataFrame:
    """Suitability of each column as an outcome: a rule score between 0 and 1, best first."""
    goal = text.squash(F.lit(objective))
    words = F.array(*[F.lit(t) for t in text.OUTCOME_TOKENS])
    own = text.tokens(F.col("column"))
    outcome_like = F.arrays_overlap(own, words)
    name = text.squash(F.col("column"))
    named = (F.concat(F.lit(" "), goal, F.lit(" ")).contains(F.concat(F.lit(" "), name, F.lit(" ")))
             | (F.size(F.array_intersect(F.array_intersect(own, text.tokens(F.lit(objective))), words)) > 0))
    numeric = F.col("kind") == "numeric"
    raw = (0.2 + F.when(numeric, 0.15).otherwise(0.1) + F.when(outcome_like, 0.2).otherwise(0.0)
           + F.when(named, 0.4).otherwise(0.0) - F.when(F.col("missing_pct") > 30, 0.2).otherwise(0.0))
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 2)
    task = F.when(~numeric | ((F.col("unique") <= 15) & (F.col("cardinality_ratio") < 0.1)), "classification").otherwise("regression")
    return (profile_table
            .filter(~F.col("constant") & ~F.col("possible_id") & (F.col("unique") >= 2) & (F.col("kind") != "datetime")
                    & (numeric | (F.col("unique") <= 20)))
            .select("column", task.alias("task"), score.alias("score"))
            .withColumn("confidence", F.when(F.col("score") >= 0.85, "HIGH").when(F.col("score") >= 0.6, "MEDIUM").otherwise("LOW"))
            .orderBy(F.desc("score"), "column").limit(n))


def auto_target(ranked: DataFrame) -> DataFrame:
    """The first candidate where its score is 0.75 or more and 0.1 ahead of the next."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "column")  # eight rows at most
    lead = F.coalesce(F.lead("score").over(order), F.lit(-1.0))
    return (ranked.withColumn("place", F.row_number().over(order)).withColumn("margin", F.col("score") - lead)
            .filter((F.col("place") == 1) & (F.col("score") >= 0.75) & (F.col("margin") >= 0.1 - 1e-9)).select("column", "score"))


def match_targets(objectives: DataFrame, objective: str, columns) -> DataFrame:
    """The one column named in each objective text (underscores read as spaces), if exactly one is."""
    goal = F.replace(F.lower(F.col(objective)), F.lit("_"), F.lit(" "))
    spoken = [(c, c.lower().replace("_", " ")) for c in columns if len(c) > 2]
    hits = F.filter(F.array(*[F.when(goal.contains(s), F.lit(c)) for c, s in spoken]), lambda c: c.isNotNull())
    return (objectives.withColumn("__hits", hits).filter(F.size("__hits") == 1)
            .withColumn("target", F.get("__hits", F.lit(0))).drop("__hits"))
