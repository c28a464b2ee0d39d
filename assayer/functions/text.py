"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns.
IDENTIFIER_NAME = r"(?i)(^id$|_id$|^id_|identifier|uuid)"
DATE_NAME = r"(?i)(date|timestamp|(^|_)time($|_))"
DATE_VALUE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"
PREDICTION_TIME_NAME = r"(?i)(prediction_(time|date)|as_of|observation_date)"
OUTCOME_LIKE_NAME = (
    r"(?i)((^|_)(post|after|future|next|target|outcome)(_|$)"
    r"|cancell?ation|churn_date|termination|refund_after)"
)
# Name parts.
OUTCOME_TOKENS = ["target", "label", "outcome", "sales", "revenue", "profit", "price", "churn", "demand", "risk"]
ADDITIVE_TOKENS = ["sales", "revenue", "quantity", "profit", "volume"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """Text of a cell without outer spaces."""
    return F.trim(_col(c).cast("string"))


def squash(c) -> Column:
    """Lower case, every run of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " "))


def tokens(c) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.filter(F.split(squash(c), " "), lambda t: t != ""))


def title(c) -> Column:
    """Display name: underscores as spaces, words capitalised."""
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def file_name(c) -> Column:
    """Last path part without control characters, 255 characters at most."""
    last = F.element_at(F.split(F.replace(_col(c), F.lit("\\"), F.lit("/")), "/"), -1)
    name = F.substring(F.regexp_replace(last, r"[\x00-\x1f\x7f]", ""), 1, 255)
    return F.when(name == "", F.lit("dataset.csv")).otherwise(name)


def contains_ignoring_case(columns, term: str) -> Column:
    """True where the term occurs in any of the columns, letter case ignored."""
    return F.lower(F.concat_ws(" ", *[_col(c) for c in columns])).contains(term.lower())
