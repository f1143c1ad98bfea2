"""Scalar column helpers: exact money sums, guarded ratios, buckets, calendars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 10000.0


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_sum(c: Column | str) -> Column:
    """Sum that does not depend on row order, so retries and re-partitioning give equal results.

    Amounts become whole ten-thousandths; the decimal total cannot overflow, and a
    long is far cheaper to turn into a decimal than a double is.
    """
    return F.sum(money_units(c)).cast("double") / UNITS


def money_units(c: Column | str) -> Column:
    """Amount in whole ten-thousandths, ready for an exact sum."""
    return F.rint(as_column(c) * UNITS).cast("long").cast("decimal(18,0)")


def round_to(c: Column | str, digits: int) -> Column:
    """Half-up rounding by scaling, the same arithmetic in every engine that has IEEE doubles."""
    scale = float(10**digits)
    return F.round(as_column(c) * F.lit(scale), 0) / F.lit(scale)


def safe_div(a: Column | str, b: Column | str, default: float | None = 0.0) -> Column:
    """``a / b`` where b > 0, else the default."""
    a, b = as_column(a), as_column(b)
    return F.when(b > 0, F.try_divide(a.cast("double"), b.cast("double"))).otherwise(
        F.lit(default).cast("double")
    )


def clamp(c: Column | str, low: float, high: float) -> Column:
    c = as_column(c)
    return F.when(c.isNull(), None).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c)))


def time_bucket(c: Column | str, granularity: str) -> Column:
    """daily, weekly (Monday) or monthly bucket start; anything else is daily."""
    c = as_column(c)
    unit = {"weekly": "week", "monthly": "month"}.get(granularity)
    return F.date_trunc(unit, c).cast("date") if unit else c.cast("date")


def metric_expr(name: str, choices: dict[str, Column], default: str) -> Column:
    """Aggregate picked by name; an unknown name gives the default."""
    return choices.get(name, choices[default])


def sunday_dow(c: Column | str) -> Column:
    """0 = Sunday."""
    return F.dayofweek(as_column(c)) - 1


def great_circle_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    h = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(half_lng), F.lit(2.0))
    return F.lit(2 * 6371.0) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def valid_phone(c: Column | str) -> Column:
    return as_column(c).rlike(r"^1[3-9]\d{9}$")


def valid_date_range(start: Column | str, end: Column | str) -> Column:
    return as_column(start) <= as_column(end)


def non_negative(c: Column | str) -> Column:
    return as_column(c) >= 0


def tidy_text(c: Column | str, limit: int = 200) -> Column:
    return F.substring(F.trim(as_column(c)), 1, limit)
