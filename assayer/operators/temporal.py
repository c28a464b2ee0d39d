"""Calendar series, trend, season, change points and evaluated baseline forecasts.

Any number of keyed series is handled in one job. Rows are aggregated to calendar buckets
first; the chosen frequency keeps a series at a few thousand periods, so the windows per
series stay short however many rows a series has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import dates, numbers, text
from assayer.operators import quantiles as q
from assayer.operators import ranking
from assayer.operators.profile import EXTREME, types_of

ROBUST = 1.4826  # fixed value: median absolute deviation to standard deviation
MODELS = ["Naive", "Moving average", "Exponential smoothing"]


def additive(measure: str) -> bool:
    """Measures that add up over time, by a part of their name."""
    return any(t in measure.lower() for t in text.ADDITIVE_TOKENS)


def usable_rows(df: DataFrame, ts: str, measure: str, keys=()) -> DataFrame:
    """series keys, ts and value of the rows that have both; ``series`` is 'all' without keys."""
    names = list(keys) or ["series"]
    base = df if keys else df.withColumn("series", F.lit("all"))
    return (base.select(*names, dates.instant(F.col(ts), types_of(df)[ts].simpleString()).alias("ts"),
                        numbers.finite(F.col(measure).try_cast("double")).alias("value"))
            .filter(F.col("ts").isNotNull() & F.col("value").isNotNull()))


def frequency_rule(gap_days: Column, span_days: Column) -> Column:
    """Calendar frequency by the median gap between instants and the span, both in days."""
    return (F.when((gap_days > 300) | (span_days > 60000), "YS").when((gap_days >= 25) | (span_days > 2000), "MS")
            .when(gap_days >= 6, "W-MON").when((gap_days < 1) & (span_days * 24 <= 2000), "h").otherwise("D"))


def choose_frequency(rows: DataFrame, keys, n: int | None = None) -> DataFrame:
    """Frequency per series with the facts behind it."""
    n = rows.count() if n is None else n
    keys = list(keys)
    gap = q.medians(ranking.gaps(rows, "ts", keys, n), ["gap_seconds"], keys, n)
    span = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(F.abs("value")).alias("largest"))
    days = F.floor((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(86_400_000_000))
    return (ranking.join_groups(span, gap, keys).withColumn("gap_days", F.col("gap_seconds") / 86400).withColumn("span_days", days)
            .withColumn("frequency", frequency_rule(F.col("gap_days"), F.col("span_days"))).drop("gap_seconds"))


def calendar_series(df: DataFrame, ts: str, measure: str, keys=(), frequency: str | None = None, how: str | None = None) -> DataFrame:
    """Regular grid per series: period, value (null in empty periods), rows, idx from 0.

    The frequency and sum or mean are chosen by rule unless given.
    """
    names = list(keys) or ["series"]
    rows = usable_rows(df, ts, measure, keys)
    total = (how or ("sum" if additive(measure) else "mean")) == "sum"
    if frequency is None:
        # Without keys the gaps are one column without groups, whose quantiles take fewer scans.
        chosen = choose_frequency(rows, keys).select(*names, "frequency") if keys else choose_frequency(rows, []).select(F.lit("all").alias("series"), "frequency")
        # A row per series, broadcast when it measures small; a single row in any case, or Spark may take the source rows for the smaller side.
        rows = ranking.join_groups(rows, chosen if keys else F.broadcast(chosen), names)
    else:
        rows = rows.withColumn("frequency", F.lit(frequency))
    label = frequency if frequency is not None else F.col("frequency")
    buckets = (rows.withColumn("period", dates.period(F.col("ts"), label)).groupBy(*names, "frequency", "period")
               .agg((F.sum("value") if total else F.avg("value")).alias("value"), F.count(F.lit(1)).alias("rows")))
    return fill_grid(buckets, names, label)


def step_of(frequency) -> Column:
    """The calendar step as an interval."""
    steps = {"YS": "interval 1 year", "MS": "interval 1 month", "W-MON": "interval 1 week", "D": "interval 1 day", "h": "interval 1 hour"}
    if isinstance(frequency, str):
        return F.expr(steps[frequency])
    units = {"YS": "years", "MS": "months", "W-MON": "weeks", "D": "days", "h": "hours"}
    return F.make_interval(**{u: F.when(frequency == f, 1).otherwise(0) for f, u in units.items()})


def fill_grid(buckets: DataFrame, names, frequency) -> DataFrame:
    """Left join of the calendar spine with the buckets: empty periods come out with null."""
    ends = buckets.groupBy(*names, "frequency").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    spine = ends.select(*names, "frequency", F.posexplode(F.sequence("lo", "hi", step_of(frequency))).alias("idx", "period"))
    renamed = buckets.select(*[F.col(n).alias(f"__r_{n}") for n in names], F.col("period").alias("__r_period"), "value", "rows")
    on = F.col("period") == F.col("__r_period")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"__r_{n}"))
    return (spine.join(renamed, on, "left")
            .select(*names, "frequency", "idx", "period", "value", F.coalesce("rows", F.lit(0)).alias("rows")))


def _keys(series: DataFrame) -> list[str]:
    fixed = {"frequency", "idx", "period", "value", "rows"}
    return series.columns[: next(i for i, c in enumerate(series.columns) if c in fixed)]


def _order(names) -> Window:
    return Window.partitionBy(*names).orderBy("idx")


def _mean_of(names, first: int, last: int, least: int) -> Column:
    over = _order(names).rowsBetween(first, last)
    return F.when(F.count("value").over(over) >= least, F.avg("value").over(over))


def rolling(series: DataFrame) -> DataFrame:
    """Adds the mean of the last three periods, of the three before, and the step of the former."""
    names = _keys(series)
    return (series.withColumn("rolling_average", _mean_of(names, -2, 0, 2)).withColumn("previous_average", _mean_of(names, -3, -1, 2))
            .withColumn("rolling_change", F.abs(F.col("rolling_average") - F.lag("rolling_average").over(_order(names)))))


def points(series: DataFrame, last: int = 400) -> DataFrame:
    """The last periods of each series with rows and rolling average."""
    names = _keys(series)
    newest = Window.partitionBy(*names).orderBy(F.desc("idx"))
    return (rolling(series).withColumn("__place", F.row_number().over(newest)).filter(F.col("__place") <= last)
            .select(*names, "period", "value", "rows", "rolling_average"))


def trend(series: DataFrame) -> DataFrame:
    """Periods, gaps, slope per period with its sign, and growth of the last grid period."""
    names = _keys(series)
    before = F.lag("value").over(_order(names))
    s = series.withColumn("__prior", before).groupBy(*names, "frequency").agg(
        F.count(F.lit(1)).alias("periods"), F.count_if(F.col("value").isNull()).alias("missing_periods"),
        F.regr_slope("value", "idx").alias("slope"), F.max_by("value", "idx").alias("__last"), F.max_by("__prior", "idx").alias("__prior"))
    slope = F.coalesce("slope", F.lit(0.0))
    growth = F.when(F.col("__prior") != 0, (F.col("__last") - F.col("__prior")) / F.abs("__prior") * 100)
    return (s.withColumn("slope_per_period", slope)
            .withColumn("trend", F.when(slope > 0, "positive").when(slope < 0, "negative").otherwise("flat"))
            .withColumn("latest_growth_pct", growth).drop("slope", "__last", "__prior"))


def _robust(frame: DataFrame, names, value: str) -> DataFrame:
    """Adds median and scaled median absolute deviation of a column per series (short grids)."""
    centre = frame.groupBy(*names).agg(F.percentile(value, F.lit(0.5)).alias("__median"))
    with_centre = ranking.join_groups(frame, centre, names)
    spread = with_centre.groupBy(*names).agg((F.percentile(F.abs(F.col(value) - F.col("__median")), F.lit(0.5)) * ROBUST).alias("__scale"))
    return ranking.join_groups(with_centre, spread, names)


def residual_anomalies(series: DataFrame, first: int | None = 20) -> DataFrame:
    """Periods whose distance to the mean of the three before is far from its median."""
    names = _keys(series)
    residual = rolling(series).withColumn("residual", F.col("value") - F.col("previous_average"))
    flagged = _robust(residual, names, "residual").filter(
        (F.col("__scale") > 0) & (F.abs(F.col("residual") - F.col("__median")) > 3 * F.col("__scale")))
    if first is not None:
        flagged = flagged.withColumn("__place", F.row_number().over(_order(names))).filter(F.col("__place") <= first)
    return flagged.select(*names, "period", "value", "residual")


def change_points(series: DataFrame, n: int = 5) -> DataFrame:
    """The n largest unusual steps of the rolling average per series."""
    names = _keys(series)
    flagged = _robust(rolling(series), names, "rolling_change").filter(
        (F.col("__scale") > 0) & (F.col("rolling_change") > F.col("__median") + 3 * F.col("__scale")))
    largest = Window.partitionBy(*names).orderBy(F.desc("rolling_change"), "idx")
    return (flagged.withColumn("place", F.row_number().over(largest)).filter(F.col("place") <= n)
            .select(*names, "place", "period", "rolling_change"))


def seasonality(series: DataFrame) -> DataFrame:
    """Autocorrelation of the detrended series at 12 months, 7 days or 52 weeks."""
    names = _keys(series)
    lag = F.lit(0)
    for f, steps in dates.SEASON_LAG.items():
        lag = F.when(F.col("frequency") == f, steps).otherwise(lag)
    line = series.groupBy(*names).agg(
        F.regr_slope("value", "idx").alias("__slope"), F.regr_intercept("value", "idx").alias("__intercept"),
        F.count(F.lit(1)).alias("periods"), F.count("value").alias("__full"))
    rest = ranking.join_groups(series, line, names).withColumn(
        "__rest", F.col("value") - (F.col("__intercept") + F.col("__slope") * F.col("idx")))
    earlier = F.lit(None).cast("double")
    for f, steps in dates.SEASON_LAG.items():
        earlier = F.when(F.col("frequency") == f, F.lag("__rest", steps).over(_order(names))).otherwise(earlier)
    s = rest.withColumn("__earlier", earlier).withColumn("lag", lag).groupBy(*names, "frequency", "lag", "periods", "__full").agg(
        F.expr(numbers.corr_sql("__rest", "__earlier")).alias("__r"), F.stddev_pop("__rest").alias("__sd"))
    suits = (F.col("lag") > 0) & (F.col("periods") >= 2 * F.col("lag")) & (F.col("__full") == F.col("periods")) & (F.col("__sd") > 1e-9)
    return s.withColumn("autocorrelation", F.when(suits, F.col("__r"))).select(*names, "frequency", "lag", "periods", "autocorrelation")


# ---- baseline forecasts ---------------------------------------------------------------------

def _gated(series: DataFrame, least: int = 24) -> DataFrame:
    """Series with at least ``least`` periods and none missing, with their length."""
    over = Window.partitionBy(*_keys(series))
    return (series.withColumn("n", F.count(F.lit(1)).over(over)).withColumn("__full", F.count("value").over(over))
            .filter((F.col("n") >= least) & (F.col("__full") == F.col("n"))).drop("__full"))


def one_step_forecasts(series: DataFrame, alpha: float = 0.3) -> DataFrame:
    """For every period what the three baselines would have said one step before."""
    names = _keys(series)
    short = _gated(series)
    history = short.groupBy(*names, "frequency", "n").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "period", "value"))), lambda s: s).alias("h"))  # one grid per series
    # states[i] is the smoothed level after period i.
    level = F.aggregate("h", F.array().cast("array<double>"), lambda acc, s: F.concat(acc, F.array(
        F.when(F.size(acc) == 0, s["value"]).otherwise(alpha * s["value"] + (1 - alpha) * F.element_at(acc, -1)))))
    rows = history.withColumn("__level", level).select(*names, "frequency", "n", "__level", F.explode("h").alias("s")).select(
        *names, "frequency", "n", "s.idx", "s.period", "s.value", F.get("__level", F.col("s.idx") - 1).alias("Exponential smoothing"))
    order = _order(names)
    return (rows.withColumn("Naive", F.lag("value").over(order))
            .withColumn("Moving average", F.avg("value").over(order.rowsBetween(-3, -1)))
            .withColumn("part", F.when(F.col("idx") < F.floor(F.col("n") * F.lit(0.6)), "train")
                        .when(F.col("idx") < F.floor(F.col("n") * F.lit(0.8)), "validation").otherwise("test")))


def evaluate_forecasts(series: DataFrame, alpha: float = 0.3) -> DataFrame:
    """MAE and RMSE per series, baseline and part; ``selected`` marks the best on validation."""
    names = _keys(series)
    made = one_step_forecasts(series, alpha)
    cells = F.array(*[F.struct(F.lit(i).alias("model_order"), F.lit(m).alias("model"), (F.col("value") - F.col(m)).alias("error"))
                      for i, m in enumerate(MODELS)])
    scores = (made.filter(F.col("part") != "train").select(*names, "part", F.inline(cells))
              .groupBy(*names, "model_order", "model", "part")
              .agg(F.count(F.lit(1)).alias("periods"), F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse")))
    best = Window.partitionBy(*names)
    choice = F.min(F.when(F.col("part") == "validation", F.struct("mae", "model_order"))).over(best)
    return scores.withColumn("selected", F.col("model_order") == choice["model_order"]).drop("model_order")


def forecast_summary(series: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Winner per series with its validation and test errors; test periods never choose."""
    names = _keys(series)
    won = evaluate_forecasts(series, alpha).filter("selected")
    def pick(part, c):
        return F.max(F.when(F.col("part") == part, F.col(c)))
    return won.groupBy(*names, F.col("model").alias("selected_model")).agg(
        pick("validation", "mae").alias("validation_mae"), pick("test", "mae").alias("test_mae"), pick("test", "rmse").alias("test_rmse"))


def forecast(series: DataFrame, horizon: int = 6, alpha: float = 0.3) -> DataFrame:
    """Iterative forecast with the winner of each series: forecasts feed the next step."""
    names = _keys(series)
    won = forecast_summary(series, alpha).select(*names, "selected_model")
    tail = one_step_forecasts(series, alpha).groupBy(*names, "frequency").agg(
        F.max("period").alias("last_period"),
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("h"),  # one grid per series
        F.max_by(F.struct(F.col("value"), F.col("`Exponential smoothing`").alias("level")), "idx").alias("__end"))
    level = alpha * F.col("__end.value") + (1 - alpha) * F.col("__end.level")

    def step(acc, _):
        last3 = F.slice(acc, F.greatest(F.size(acc) - 2, F.lit(1)), F.lit(3))
        mean = F.aggregate(last3, F.lit(0.0), lambda a, v: a + v) / F.size(last3)
        # A smoothed level fed its own forecast does not move.
        value = F.when(F.col("selected_model") == "Naive", F.element_at(acc, -1)).when(F.col("selected_model") == "Moving average", mean).otherwise(level)
        return F.concat(acc, F.array(value))

    full = ranking.join_groups(tail, won, names).withColumn("__all", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("h"), step))
    ahead = F.slice("__all", F.size("h") + 1, F.lit(horizon))
    return full.select(*names, "frequency", "selected_model", "last_period", F.posexplode(ahead).alias("__i", "value")).select(
        *names, "selected_model", (F.col("__i") + 1).alias("step"),
        dates.shift(F.col("last_period"), F.col("__i") + 1, F.col("frequency")).alias("period"), "value")


def suitability(df: DataFrame, ts: str, measure: str, keys=(), frequency: str | None = None) -> DataFrame:
    """Status per series: completed, or skipped with the reason."""
    names = list(keys) or ["series"]
    rows = usable_rows(df, ts, measure, keys)
    facts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("usable_rows"), F.count_distinct("ts").alias("distinct_dates"),
                                     F.max(F.abs("value")).alias("largest"))
    series = calendar_series(df, ts, measure, keys, frequency)
    filled = series.groupBy(*names).agg(F.count("value").alias("complete_periods"), F.count(F.lit(1)).alias("periods"))
    reason = (F.when(F.col("largest") > EXTREME, "extreme magnitude").when(F.col("distinct_dates") < 8, "fewer than eight distinct dates")
              .when(F.col("complete_periods") < 2, "too few periods"))
    return (ranking.join_groups(facts, filled, names).withColumn("reason", reason)
            .withColumn("status", F.when(reason.isNull(), "completed").otherwise("skipped")).drop("largest"))


def temporal_summary(df: DataFrame, ts: str, measure: str, keys=(), frequency: str | None = None) -> DataFrame:
    """One row per series: frequency, periods, gaps, duplicate dates, trend, growth, season."""
    names = list(keys) or ["series"]
    series = calendar_series(df, ts, measure, keys, frequency)
    rows = usable_rows(df, ts, measure, keys).groupBy(*names).agg(
        F.count(F.lit(1)).alias("usable_rows"), (F.count(F.lit(1)) - F.count_distinct("ts")).alias("duplicate_dates"))
    season = seasonality(series).select(*names, F.col("lag").alias("seasonality_lag"), "autocorrelation")
    return ranking.join_groups(ranking.join_groups(trend(series), rows, names), season, names)
