"""Calendar helpers. Dates are ``DateType``; month arithmetic clamps to the month's end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_months(day: Column, n: Column) -> Column:
    return F.add_months(day, n.cast("int"))


def today_in_riyadh(now: Column) -> Column:
    """Calendar day at UTC+3 of a UTC timestamp."""
    return F.to_date(now + F.expr("INTERVAL 3 HOURS"))


#: The longest term that is derived from two dates; a longer one is given as this.
MAX_TERM_MONTHS = 600


def term_months(stated: Column, start: Column, end: Column) -> Column:
    """The stated term, else the smallest N with ``start + N months > end`` (at most 600).

    Whole months between the dates give N up to one; the two neighbours settle it, so no
    600-element array is built per row.
    """
    gap = F.months_between(end, start).cast("int")
    n = F.greatest(gap, F.lit(1))
    derived = (
        F.when(F.add_months(start, n) > end, n)
        .when(F.add_months(start, n + 1) > end, n + 1)
        .otherwise(n + 2)
    )
    known = start.isNotNull() & end.isNotNull() & (end >= start)
    return F.coalesce(
        stated.cast("int"), F.when(known, F.least(derived, F.lit(MAX_TERM_MONTHS)))
    )
