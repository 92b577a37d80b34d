"""Rounding, safe division and number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# How far below a tie (in units of the last digit) a value still counts as the tie. A sum of doubles depends on
# the order of the rows in its last bits; a mean that is a tie would otherwise round either way.
TIE_SLACK = 1e-6
_WHOLE = float(1 << 53)


def half_up(value: Column, digits: int) -> Column:
    """Round half away from zero, the same for every row order, and never to a negative zero.

    A double beyond 2^53 units of the last digit has nothing left to round and stays as it is.
    """
    scale = float(10**digits)
    rounded = F.signum(value) * F.floor(F.abs(value) * scale + (0.5 + TIE_SLACK)) / scale + F.lit(0.0)
    return F.when(F.abs(value) < _WHOLE / scale, rounded).otherwise(value.cast("double"))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """`part / whole`, 0 where that is undefined."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def to_number(value: Column) -> Column:
    """Text to double; anything unreadable, and NaN, becomes null instead of failing the job."""
    return nan_to_null(value.try_cast("double"))
