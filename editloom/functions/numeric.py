"""Number helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity, also below zero (Spark's ``round`` goes away from zero)."""
    if digits == 0:
        return F.floor(value + F.lit(0.5))
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def number_text(value: Column) -> Column:
    """A number as text without a trailing ``.0`` (42.0 -> '42', 42.5 -> '42.5')."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low,
                      F.least(F.lit(high) if not isinstance(high, Column) else high, value))


def truthy(value: Column) -> Column:
    """True for a text that is neither null nor empty."""
    return F.coalesce(value, F.lit("")) != F.lit("")


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))
