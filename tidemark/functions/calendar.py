"""Date functions and calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi

# Calendar variants -> which calendar columns they keep.
CALENDAR_VARIANTS = {
    "time_all": ("day_num", "month", "week"),
    "day_num_only": ("day_num",),
    "month_only": ("month",),
    "week_only": ("week",),
    "no_day_num": ("month", "week"),
    "no_month": ("day_num", "week"),
    "no_week": ("day_num", "month"),
}


def parse_day(c: str, strict: bool = True) -> Column:
    """text/timestamp -> date; strict raises on a bad value (ANSI cast),
    lenient gives missing."""
    if strict:
        return F.col(c).cast("date")
    return F.expr(f"try_cast(`{c}` as date)")


def day_number(day: str, fit: DataFrame) -> Column:
    """Days since the first day of the fit (train) rows; test rows use
    the train origin."""
    return F.datediff(F.col(day), fit.select(F.min(day)).scalar())


def year_month(day: str) -> Column:
    """C14: ``yyyy-MM`` text."""
    return F.date_format(F.col(day), "yyyy-MM")


def weekday0(day: str) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(F.col(day))


def iso_week(day: str) -> Column:
    """ISO week number."""
    return F.weekofyear(F.col(day))


def cyclic(day: str) -> list[Column]:
    """C17: sin/cos of day-of-year (period 365.25) and week (period 52)."""
    doy = F.dayofyear(F.col(day)).cast("double")
    woy = F.weekofyear(F.col(day)).cast("double")
    return [
        F.sin(F.lit(TWO_PI) * doy / 365.25).alias("doy_sin"),
        F.cos(F.lit(TWO_PI) * doy / 365.25).alias("doy_cos"),
        F.sin(F.lit(TWO_PI) * woy / 52.0).alias("woy_sin"),
        F.cos(F.lit(TWO_PI) * woy / 52.0).alias("woy_cos"),
    ]


def ordinal(day: str) -> Column:
    """Day as an integer (days since 1970-01-01; ranks equal any origin)."""
    return F.unix_date(F.col(day))


def calendar_columns(day: str, fit: DataFrame, variant: str = "time_all") -> list[Column]:
    """The calendar columns one named variant keeps."""
    keep = CALENDAR_VARIANTS[variant]
    out = []
    if "day_num" in keep:
        out.append(day_number(day, fit).alias("day_num"))
    if "month" in keep:
        out.append(year_month(day).alias("month"))
    if "week" in keep:
        out.append(iso_week(day).alias("week"))
    return out
