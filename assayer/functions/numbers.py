"""Numeric column expressions with missing-value semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """Double value of ``c``; NaN and infinities become null (NaN sorts above infinity)."""
    d = _col(c).cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def finite_sql(name: str) -> str:
    """The same as SQL text, for wide aggregates."""
    return f"if(abs(`{name}`) < double('Infinity'), double(`{name}`), NULL)"


def corr_sql(x: str, y: str) -> str:
    """Pearson r of two SQL expressions over pairwise complete rows, null where one is constant.

    The built-in correlation divides by zero there, which is an error in ANSI mode.
    """
    xs, ys = f"if({y} IS NULL, NULL, {x})", f"if({x} IS NULL, NULL, {y})"
    return f"try_divide(covar_pop({x}, {y}), sqrt(var_pop({xs})) * sqrt(var_pop({ys})))"


def is_infinite(c) -> Column:
    """True for plus or minus infinity, false for everything else, null included."""
    return F.coalesce(F.abs(_col(c).cast("double")) == F.lit(float("inf")), F.lit(False))


def to_number(c) -> Column:
    """Number behind a text cell, null where it does not parse or is not finite."""
    return finite(_col(c).try_cast("double"))


def ratio(x, y) -> Column:
    """x / y with the denominator kept at one or more."""
    return _col(x) / F.greatest(_col(y), F.lit(1))


def safe_divide(x, y) -> Column:
    """x / y, null where y is zero or null."""
    return F.try_divide(_col(x).cast("double"), _col(y).cast("double"))


def sample_skewness(g1, n) -> Column:
    """Bias-corrected skewness from the population form."""
    g1, n = _col(g1), _col(n).cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2, n) -> Column:
    """Bias-corrected excess kurtosis from the population form."""
    g2, n = _col(g2), _col(n).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def strength(effect, measure) -> Column:
    """Verbal size of an effect, cut by the kind of measure."""
    # Cut points small / moderate / large per measure family.
    mean_difference = (0.2, 0.5, 0.8)
    explained_share = (0.01, 0.06, 0.14)
    correlation_like = (0.1, 0.3, 0.5)

    e, m = F.abs(_col(effect)), _col(measure)

    def graded(cuts):
        low, mid, high = cuts
        return (F.when(e >= high, "large").when(e >= mid, "moderate")
                .when(e >= low, "small").otherwise("negligible"))

    return (F.when(m == "cohens_d", graded(mean_difference))
            .when(m.isin("eta_squared", "epsilon_squared"), graded(explained_share))
            .otherwise(graded(correlation_like)))
