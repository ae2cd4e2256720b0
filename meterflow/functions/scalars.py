"""Small column helpers: safe arithmetic, plausibility guards, time buckets and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_ts(x: Column | str) -> Column:
    """A timestamp from a timestamp or an ISO-8601 string; NULL where it can't be read."""
    return F.try_to_timestamp(col(x).cast("string"))


def safe_div(a, b) -> Column:
    """a / b where b is positive, else NULL."""
    return F.when(col(b) > 0, col(a) / col(b))


def guard(x, low: float, high: float, where: Column | None = None) -> Column:
    """x where it lies within [low, high] (and where holds), else NULL."""
    ok = col(x).between(low, high)
    return F.when(ok if where is None else ok & where, col(x))


def non_negative(x) -> Column:
    return F.when(col(x) >= 0, col(x))


def running_flag(x) -> Column:
    """1 for positive values, 0 for all others and NULL."""
    return F.when(col(x) > 0, 1).otherwise(0)


def finite(x) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(col(x)) & (F.abs(col(x)) < float("inf")), col(x))


def hour_of(ts) -> Column:
    return F.date_trunc("hour", col(ts))


def hour_label(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:00:00")


def minute_label(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:00")


def day_of(ts) -> Column:
    return F.to_date(col(ts))


def week_start(ts) -> Column:
    """The Monday of the week, also for a Sunday."""
    return F.to_date(F.date_trunc("week", col(ts)))


def week_label(ts) -> Column:
    """ISO year and week, such as 2019-W01 for 2018-12-31: the year is that of the week's Thursday."""
    return F.concat(F.year(F.date_add(week_start(ts), 3)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(col(ts)).cast("string"), 2, "0"))


def month_label(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def hours_in_month(ts) -> Column:
    return F.dayofmonth(F.last_day(col(ts))) * 24


def hours_between(a, b) -> Column:
    return (F.unix_timestamp(col(a)) - F.unix_timestamp(col(b))) / 3600


def decimal_sum(x, scale: int = 2) -> Column:
    """An exact sum of values with so many decimals, as double: it doesn't depend on the order of rows."""
    return F.sum(col(x).cast(f"decimal(18,{scale})")).cast("double")


#: Prices of a kWh at peak, flat and valley hours, and the hours [from, to) of the first two.
TARIFF_PRICES = {"peak": 1.2, "flat": 0.8, "valley": 0.4}
TARIFF_HOURS = {"peak": [(8, 11), (18, 23)], "flat": [(7, 8), (11, 18)]}


def tariff(hour) -> Column:
    """Price of a kWh by hour of day."""
    out = F.lit(TARIFF_PRICES["valley"])
    for band, ranges in TARIFF_HOURS.items():
        for start, end in ranges:
            out = F.when(col(hour).between(start, end - 1), TARIFF_PRICES[band]).otherwise(out)
    return out
