"""Rounding and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _format(x: Column, pattern: str) -> Column:
    return F.call_function("format_number", x, F.lit(pattern))


def round_half_up(x: Column, places: int = 2) -> Column:
    """Halves go towards plus infinity, so -2.5 becomes -2 (``F.round`` gives -3)."""
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def thousands(x: Column) -> Column:
    """``12,345.5``: grouping, at most two decimals."""
    return _format(round_half_up(x, 2), "#,##0.##")


def short_number(x: Column) -> Column:
    """At most one decimal and no trailing zero: ``8``, ``7.5``."""
    return _format(round_half_up(x.cast("double"), 1), "0.#")


def one_decimal(x: Column) -> Column:
    """Whole numbers plain, others with exactly one decimal."""
    x = x.cast("double")
    return F.when(x == F.floor(x), _format(x, "0")).otherwise(_format(x, "0.0"))
