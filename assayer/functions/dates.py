"""Date and calendar column expressions, all in UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text layouts, tried in this order.
PATTERNS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
]
# Seasonal lag by calendar frequency.
SEASON_LAG = {"MS": 12, "D": 7, "W-MON": 52}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse(c, patterns=PATTERNS) -> Column:
    """Instant of a text in any of the layouts, null where none fits."""
    c = _col(c).cast("string")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for p in patterns], c.try_cast("timestamp"))


def instant(c, dtype: str) -> Column:
    """Timestamp of a column that is a timestamp, a date or text."""
    return parse(c) if dtype == "string" else _col(c).cast("timestamp")


def seconds(c) -> Column:
    """Seconds since 1970 with the microseconds kept."""
    return F.unix_micros(_col(c).cast("timestamp")) / F.lit(1e6)


def period(c, frequency) -> Column:
    """Label of the calendar bucket: YS, MS, W-MON (closing Monday), D or h."""
    ts = _col(c).cast("timestamp")
    labels = {
        "YS": F.date_trunc("year", ts),
        "MS": F.date_trunc("month", ts),
        "W-MON": F.date_trunc("week", F.date_add(ts.cast("date"), 6).cast("timestamp")),
        "D": F.date_trunc("day", ts),
        "h": F.date_trunc("hour", ts),
    }
    if isinstance(frequency, str):
        return labels[frequency]
    chosen = F.lit(None).cast("timestamp")
    for name, label in labels.items():
        chosen = F.when(frequency == name, label).otherwise(chosen)
    return chosen


def shift(start: Column, steps: Column, frequency) -> Column:
    """``start`` moved by a number of calendar steps."""
    moves = {
        "YS": F.make_interval(years=steps),
        "MS": F.make_interval(months=steps),
        "W-MON": F.make_interval(weeks=steps),
        "D": F.make_interval(days=steps),
        "h": F.make_interval(hours=steps),
    }
    if isinstance(frequency, str):
        return start + moves[frequency]
    chosen = F.lit(None).cast("timestamp")
    for name, move in moves.items():
        chosen = F.when(frequency == name, start + move).otherwise(chosen)
    return chosen


def calendar_parts(name: str, ts: Column) -> dict[str, Column]:
    """Year, month, weekday (Monday is 0) and the month on the circle."""
    month = F.month(ts).cast("double")
    angle = F.lit(2 * math.pi) * month / 12
    return {
        f"{name}__year": F.year(ts).cast("double"),
        f"{name}__month": month,
        f"{name}__weekday": F.weekday(ts).cast("double"),
        f"{name}__month_sin": F.sin(angle),
        f"{name}__month_cos": F.cos(angle),
    }
