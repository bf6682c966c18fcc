"""Date ranges as array columns, newest first; explode them to get rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the first day of the warehouse unless a caller says otherwise.
EARLIEST_DAY = "2013-12-01"


def _date(value: Column | str) -> Column:
    """A column, or an ISO text taken as a literal date."""
    return value.cast("date") if isinstance(value, Column) else F.lit(value).cast("date")


def _newest_first(start: Column, end: Column, step: str) -> Column:
    interval = F.expr(f"interval 1 {step}")
    return F.when(start <= end, F.reverse(F.sequence(start, end, interval))).otherwise(
        F.array().cast("array<date>")
    )


def _first_of_month(day: Column) -> Column:
    return F.trunc(day, "month")


def prev_day(day: Column, earliest: Column | str = EARLIEST_DAY) -> Column:
    """The day before; null at or before ``earliest``."""
    d = _date(day)
    return F.when(d > _date(earliest), F.date_sub(d, 1))


def prev_month(day: Column, earliest: Column | str = EARLIEST_DAY) -> Column:
    """First day of the month before; null when this month starts at or before ``earliest``."""
    first = _first_of_month(_date(day))
    return F.when(first > _date(earliest), F.add_months(first, -1))


def day_range(start: Column | str, end: Column | str, earliest: Column | str = EARLIEST_DAY) -> Column:
    """Every day from ``end`` down to ``start``, both included, none before ``earliest``."""
    return _newest_first(F.greatest(_date(start), _date(earliest)), _date(end), "day")


def month_range(start: Column | str, end: Column | str, earliest: Column | str = EARLIEST_DAY) -> Column:
    """First days of the months that the day range touches."""
    first = _first_of_month(F.greatest(_date(start), _date(earliest)))
    end_date = _date(end)
    reached = F.greatest(_date(start), _date(earliest)) <= end_date
    return F.when(reached, _newest_first(first, _first_of_month(end_date), "month")).otherwise(
        F.array().cast("array<date>")
    )


def this_and_prev_days(day: Column, earliest: Column | str = EARLIEST_DAY) -> Column:
    return day_range(earliest, day, earliest)


def this_and_prev_days_of_month(day: Column, earliest: Column | str = EARLIEST_DAY) -> Column:
    """From the last day of the month back to ``earliest``."""
    return day_range(earliest, F.last_day(_date(day)), earliest)


def this_and_prev_months(day: Column, earliest: Column | str = EARLIEST_DAY) -> Column:
    return month_range(earliest, F.last_day(_date(day)), earliest)


def all_days(latest: Column | str, earliest: Column | str = EARLIEST_DAY) -> Column:
    return day_range(earliest, latest, earliest)


def all_months(latest: Column | str, earliest: Column | str = EARLIEST_DAY) -> Column:
    return month_range(earliest, latest, earliest)


def all_days_of_month(day: Column) -> Column:
    """Every day of the month of ``day``, last day first."""
    d = _date(day)
    return _newest_first(_first_of_month(d), F.last_day(d), "day")


def last_days(day: Column, count: int, earliest: Column | str = EARLIEST_DAY) -> Column:
    """From ``day`` back ``-count`` days; ``count`` is zero or negative."""
    d = _date(day)
    return day_range(F.date_add(d, count), d, earliest)


def last_months(day: Column, count: int, earliest: Column | str = EARLIEST_DAY) -> Column:
    """From the month of ``day`` back ``-count`` months; ``count`` is zero or negative."""
    d = _date(day)
    return month_range(F.add_months(_first_of_month(d), count), d, earliest)


def month_id(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMM")


def date_id(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd")


def year_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy")


def month_text(moment: Column) -> Column:
    return F.date_format(moment, "MM")


def day_text(moment: Column) -> Column:
    return F.date_format(moment, "dd")
