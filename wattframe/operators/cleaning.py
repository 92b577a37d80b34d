"""Cleaning in a fixed order: drop duplicate rows, fill gaps, drop rows without a valid timestamp.

The order matters: a row that is dropped for its timestamp still counts in the medians, and filling can make
two rows equal that were not, which both stay.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.functions.numbers import nan_to_null, to_number
from wattframe.functions.times import parse_wall_time
from wattframe.operators.order_stats import long_form, most_frequent, quantiles
from wattframe.roles import METERED, Roles
from wattframe.session import materialize

COPIES = "_copies"


def numeric_columns(df: DataFrame, roles: Roles = METERED) -> list[str]:
    return [c for c in df.columns if c in roles.numeric and c not in roles.key]


def text_columns(df: DataFrame, roles: Roles = METERED) -> list[str]:
    skip = {roles.timestamp, *roles.key, *roles.numeric, COPIES}
    return [c for c in df.columns if c not in skip]


def null_nans(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[nan_to_null(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def count_copies(df: DataFrame, output: str = COPIES) -> DataFrame:
    """Distinct rows with the number of times each occurs; nulls equal each other."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(output))


def dedupe_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows."""
    return count_copies(df).agg(F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("duplicates"))


def coerce_numeric(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """All numeric columns as double, unreadable text as null."""
    wanted = {f.name for f in df.schema if f.name in numeric_columns(df, roles)
              and not isinstance(f.dataType, T.DoubleType)}
    return null_nans(df).select(*[to_number(F.col(c)).alias(c) if c in wanted else F.col(c) for c in df.columns])


def parsed_timestamp(value: Column, formats: Sequence[str] = ()) -> Column:
    """ISO text, or the given formats in turn; null when none fits."""
    tries = [value.try_cast("timestamp_ntz")]
    tries += [parse_wall_time(value, f) for f in formats]
    return F.coalesce(*tries)


def parse_timestamp(df: DataFrame, roles: Roles = METERED, formats: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(roles.timestamp, parsed_timestamp(F.col(roles.timestamp), formats))


def drop_bad_timestamps(df: DataFrame, roles: Roles = METERED, formats: Sequence[str] = ()) -> DataFrame:
    return parse_timestamp(df, roles, formats).where(F.col(roles.timestamp).isNotNull())


def median_values(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Median per column, one row per column on the driver. A column without any value is left out."""
    if not columns:
        return {}
    medians = quantiles(long_form(df, columns, "double"), "column", "value", 0.5, "median")
    return {row["column"]: row["median"] for row in medians.collect()}


def mode_values(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent text per column, the smallest on ties. A column without any value is left out."""
    if not columns:
        return {}
    modes = most_frequent(long_form(df, columns, "string"), "column", "value", "mode")
    return {row["column"]: row["mode"] for row in modes.collect()}


def fill_gaps(df: DataFrame, values: Mapping[str, float | str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(kinds[c])) for c, v in values.items()})


def impute_median(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    df = coerce_numeric(df, roles)
    return fill_gaps(df, median_values(df, numeric_columns(df, roles)))


def impute_mode(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    return fill_gaps(df, mode_values(df, text_columns(df, roles)))


@dataclass(frozen=True)
class Cleaned:
    """Cleaned rows, the log of what was done, the fill values used, and the distinct raw rows with their copies."""

    rows: DataFrame
    log: DataFrame
    fills: Mapping[str, float | str]
    distinct: DataFrame


def clean(raw: DataFrame, roles: Roles = METERED, formats: Sequence[str] = ()) -> Cleaned:
    """Columns stay as in `raw`, but numeric columns become double and the timestamp a timestamp.

    The distinct rows are written once. Counting gaps reads them once; fill values are then computed only for
    columns that have a gap, each pass reading just those columns. The result is a projection of that table.
    """
    stored = materialize(count_copies(null_nans(raw)), "distinct")
    distinct = coerce_numeric(stored, roles)
    numbers, texts = numeric_columns(distinct, roles), text_columns(distinct, roles)
    fillable = [c for c in raw.columns if c in numbers or c in texts]
    stamp = parsed_timestamp(F.col(roles.timestamp), formats)
    counts = distinct.agg(
        F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("_duplicates"),
        F.count_if(stamp.isNull()).alias("_bad_stamps"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in fillable],
    ).first().asDict()
    gaps = [c for c in fillable if counts[c]]
    fills: dict[str, float | str] = {
        **median_values(distinct, [c for c in gaps if c in numbers]),
        **mode_values(distinct, [c for c in gaps if c in texts]),
    }
    rows = fill_gaps(distinct, fills).withColumn(roles.timestamp, stamp)
    rows = rows.where(F.col(roles.timestamp).isNotNull()).select(*raw.columns)

    entries = [("duplicates_removed", None, counts["_duplicates"], "first copy kept")]
    entries += [("missing_filled", c, counts[c], "median" if c in numbers else "mode") for c in gaps]
    entries.append(("invalid_timestamps_dropped", roles.timestamp, counts["_bad_stamps"], "row dropped"))
    log = raw.sparkSession.createDataFrame(
        [(i, *entry) for i, entry in enumerate(entries)],
        "position int, step string, column string, count long, rule string",
    )
    return Cleaned(rows, log, fills, stored)
