"""One grouped aggregate at a time: the building blocks of the dashboards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.bins import nearest_bin
from wattframe.functions.labels import degree_label, hour_label, month_label, percent_label
from wattframe.functions.numbers import half_up
from wattframe.roles import METERED, Roles


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def series(
    df: DataFrame, key: Column, value: Column, name: str, label: Callable[[Column], Column] | None = None,
    digits: int = 2,
) -> DataFrame:
    """(name, [label,] value) per key; a group without values shows 0, a null key keeps its group."""
    grouped = df.groupBy(key.alias(name)).agg(half_up(_or_zero(value), digits).alias("value"))
    return grouped if label is None else grouped.select(name, label(F.col(name)).alias("label"), "value")


def usage_kpis(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """One row of totals and averages, 0 where there is nothing to sum."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        _or_zero(F.sum(roles.measure)).alias("total_energy"),
        _or_zero(F.avg(roles.measure)).alias("avg_energy"),
        _or_zero(F.sum(roles.cost)).alias("total_cost"),
        _or_zero(F.sum(roles.co2)).alias("total_co2"),
        _or_zero(F.avg(roles.occupancy)).alias("avg_occupancy"),
    )


def entity_totals(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """(entity, energy, cost, co2); sort by energy descending to show."""
    return df.groupBy(roles.entity).agg(
        _or_zero(F.sum(roles.measure)).alias("energy"),
        _or_zero(F.sum(roles.cost)).alias("cost"),
        _or_zero(F.sum(roles.co2)).alias("co2"),
    )


def entity_energy(df: DataFrame, roles: Roles = METERED, digits: int = 2) -> DataFrame:
    return series(df, F.col(roles.entity), F.sum(roles.measure), roles.entity, digits=digits)


def top_entity(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """One row: the entity with the largest total, the first by name on ties, '-' without rows."""
    best = F.min(F.struct(-F.col("energy"), F.col(roles.entity).alias("name")))
    return entity_totals(df, roles).agg(best.alias("best")).select(
        F.coalesce("best.name", F.lit("-")).alias("top_building"),
        F.coalesce(-F.col("best")["col1"], F.lit(0.0)).alias("total_energy"),
    )


def extreme_entities(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """One row: highest and lowest entity by total, with their totals."""
    return entity_totals(df, roles).agg(
        F.min(F.struct(-F.col("energy"), F.col(roles.entity).alias("name"))).alias("high"),
        F.max(F.struct(-F.col("energy"), F.col(roles.entity).alias("name"))).alias("low"),
    ).select(
        F.col("high.name").alias("highest_building"), (-F.col("high")["col1"]).alias("highest_value"),
        F.col("low.name").alias("lowest_building"), (-F.col("low")["col1"]).alias("lowest_value"),
    )


def monthly_energy(df: DataFrame, roles: Roles = METERED, digits: int = 2) -> DataFrame:
    return series(df, F.col(roles.month), F.sum(roles.measure), "month", month_label, digits)


def hourly_energy(df: DataFrame, roles: Roles = METERED, digits: int = 2) -> DataFrame:
    return series(df, F.col(roles.hour), F.avg(roles.measure), "hour", hour_label, digits)


def occupancy_bins(df: DataFrame, roles: Roles = METERED, digits: int = 2) -> DataFrame:
    return series(df, nearest_bin(F.col(roles.occupancy), 10), F.avg(roles.measure), "bin", percent_label, digits)


def temperature_bins(df: DataFrame, roles: Roles = METERED, digits: int = 2) -> DataFrame:
    return series(df, nearest_bin(F.col(roles.temperature), 2), F.avg(roles.measure), "bin", degree_label, digits)


def hvac_bins(df: DataFrame, roles: Roles = METERED, digits: int = 2) -> DataFrame:
    return series(df, nearest_bin(F.col(roles.hvac), 10), F.avg(roles.measure), "bin", percent_label, digits)


def peak_hour(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """One row: the hour with the largest total, the earliest on ties."""
    totals = df.groupBy(F.col(roles.hour).alias("hour")).agg(_or_zero(F.sum(roles.measure)).alias("energy"))
    return totals.agg(F.min(F.struct(-F.col("energy"), F.col("hour"))).alias("best")).select(
        F.col("best.hour").alias("hour"), hour_label(F.col("best.hour")).alias("peak_hour"),
        (-F.col("best")["col1"]).alias("energy"),
    )


def category_counts(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """(position, category, records) for labels of the fixed order that occur."""
    order = F.array(*[F.lit(c) for c in roles.category_order])
    return (
        df.groupBy(roles.category).agg(F.count(F.lit(1)).alias("records"))
        .select(F.array_position(order, F.col(roles.category)).cast("int").alias("position"),
                F.col(roles.category).alias("category"), "records")
        .where(F.col("position") > 0)
    )


def overall_stats(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """One row. Rows are grouped by entity first, so that the distinct count needs no second pass."""
    per_entity = df.groupBy(roles.entity).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(roles.temperature).alias("t"), F.count(roles.temperature).alias("tn"),
        F.sum(roles.occupancy).alias("o"), F.count(roles.occupancy).alias("o_n"),
        F.sum(roles.cost).alias("cost"), F.sum(roles.co2).alias("co2"),
    )
    return per_entity.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.count(roles.entity).alias("buildings"),
        F.try_divide(F.sum("t"), F.sum("tn")).alias("avg_temperature"),
        F.try_divide(F.sum("o"), F.sum("o_n")).alias("avg_occupancy"),
        F.sum("cost").alias("total_cost"),
        F.sum("co2").alias("total_co2"),
    )
