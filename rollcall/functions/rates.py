"""Attendance ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attendance_ratio(classes: Column, absences: Column, justified: Column) -> Column:
    """1 - (absences - justified) / classes to 7 places; null when there were no classes.

    Kept a double: the percent text below is defined on doubles, where ceil(100 * 0.07)
    is 8 and not 7.
    """
    unjustified = (absences - justified).cast("double")
    return F.round(F.lit(1.0) - F.try_divide(unjustified, classes.cast("double")), 7)


def clip_unit(ratio: Column) -> Column:
    """Limited to 0..1; null stays null (``greatest`` alone would skip it)."""
    return F.when(ratio.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))


def percent_text(ratio: Column) -> Column:
    """Rounded up to whole percent, ``87%``; null stays null."""
    return F.concat(F.ceil(F.lit(100) * ratio).cast("string"), F.lit("%"))
