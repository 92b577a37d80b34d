"""Wall-clock times without a zone, and instants, independent of the session's time zone.

A plain cast between the two goes through the session's zone, where an hour a year does not exist and another
one occurs twice. Readings carry wall-clock times; where Spark needs an instant they are taken as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_instant(wall: Column) -> Column:
    """The instant (`timestamp`) of a `timestamp_ntz` read as UTC."""
    parts = [F.year(wall), F.month(wall), F.dayofmonth(wall), F.hour(wall), F.minute(wall)]
    return F.make_timestamp(*parts, F.extract(F.lit("SECOND"), wall), F.lit("UTC"))


def utc_wall_time(instant: Column) -> Column:
    """The `timestamp_ntz` that a clock in UTC shows at an instant."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def parse_wall_time(text: Column, pattern: str) -> Column:
    """Text in the given pattern as `timestamp_ntz`; null when it does not fit."""
    return utc_wall_time(F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit(f"{pattern} XXX")))
