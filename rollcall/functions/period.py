"""Dates, run periods and ages."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_last_day(period: Column) -> Column:
    """``YYYYMM`` text to the month's last day; null for anything else."""
    well_formed = period.rlike("^[0-9]{4}(0[1-9]|1[0-2])$")
    return F.when(well_formed, F.last_day(F.try_to_date(F.concat(period, F.lit("01")), "yyyyMMdd")))


def reference_date(period: str) -> dt.date:
    """The same for a job argument; a malformed one is an error."""
    if not re.fullmatch(r"[0-9]{4}(0[1-9]|1[0-2])", period or ""):
        raise ValueError(f"period must be YYYYMM, got {period!r}")
    year, month = int(period[:4]), int(period[4:])
    return dt.date(year, month, calendar.monthrange(year, month)[1])


def iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` text to a date; unreadable text becomes null."""
    return F.try_to_date(text, "yyyy-MM-dd")


def age_in_years(on: Column, born: Column) -> Column:
    """Whole years as days / 365.25, cut toward zero."""
    return (F.datediff(on, born) / F.lit(365.25)).cast("int")


def month_two_digits(month: Column) -> Column:
    text = month.cast("string")
    return F.when(F.length(text) == 1, F.concat(F.lit("0"), text)).otherwise(text)


def year_month(year: Column, month: Column) -> Column:
    """``2025/07``"""
    return F.concat(year.cast("string"), F.lit("/"), month_two_digits(month))
