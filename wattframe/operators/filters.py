"""Optional equality filters and the values they can take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.errors import ArgumentError
from wattframe.functions.labels import month_label
from wattframe.roles import METERED, Roles

# Texts that mean "no filter".
NO_FILTER = (None, "", "all")


def apply_filters(
    df: DataFrame,
    roles: Roles = METERED,
    building: str | None = None,
    building_type: str | None = None,
    month: int | str | None = None,
    category: str | None = None,
) -> DataFrame:
    """Rows that match every given filter."""
    wanted = {
        roles.entity: building, roles.entity_type: building_type, roles.month: month, roles.category: category,
    }
    wanted = {c: v for c, v in wanted.items() if v not in NO_FILTER}
    if roles.month in wanted:
        try:
            wanted[roles.month] = int(wanted[roles.month])
        except ValueError as error:
            raise ArgumentError(f"month must be a whole number, not {month!r}") from error
    tests = [F.col(c) == F.lit(v) for c, v in wanted.items()]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def filter_options(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """(kind, value, label): distinct buildings, types, months and categories. One pass, in which rows are first
    reduced to their distinct combinations; sort by (kind, value) to show. The fixed order of the categories is in
    `category_options`."""
    df = df.select(roles.entity, roles.entity_type, roles.month, roles.category).distinct()
    number = F.lpad(F.col(roles.month).cast("string"), 2, "0")
    kinds = F.array(
        F.struct(F.lit("building").alias("kind"), F.col(roles.entity).alias("value"),
                 F.col(roles.entity).alias("label")),
        F.struct(F.lit("building_type").alias("kind"), F.col(roles.entity_type).alias("value"),
                 F.col(roles.entity_type).alias("label")),
        F.struct(F.lit("month").alias("kind"), number.alias("value"), month_label(F.col(roles.month)).alias("label")),
        F.struct(F.lit("category").alias("kind"), F.col(roles.category).alias("value"),
                 F.col(roles.category).alias("label")),
    )
    return df.select(F.inline(kinds)).distinct()


def category_options(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """(position, category): the labels that occur, in their fixed order."""
    order = F.array(*[F.lit(c) for c in roles.category_order])
    return (
        df.select(roles.category).distinct()
        .select(F.array_position(order, F.col(roles.category)).cast("int").alias("position"),
                F.col(roles.category).alias("category"))
        .where(F.col("position") > 0)
    )
