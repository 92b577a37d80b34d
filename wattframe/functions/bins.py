"""Binning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_bin(value: Column, width: int) -> Column:
    """Nearest multiple of `width`, half away from zero (-0.3 lands in 0, 5 in 10, -5 in -10)."""
    return F.round(value / float(width)) * float(width) + F.lit(0.0)


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based bin over [low, high]; the last bin includes `high`."""
    width = (high - low) / float(bins)
    return F.least(F.floor(F.try_divide(value - low, width)).cast("int") + F.lit(1), F.lit(bins))
