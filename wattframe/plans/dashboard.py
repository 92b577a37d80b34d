"""The filtered dashboard and the unfiltered analysis, each from one scan of the raw table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions.bins import nearest_bin
from wattframe.functions.labels import degree_label, hour_label, month_label, percent_label
from wattframe.operators.filters import apply_filters
from wattframe.operators.panels import Extreme, GroupCount, Kpi, Measure, Series, panel_bundle
from wattframe.roles import METERED, Roles


def _with_bins(df: DataFrame, roles: Roles, *names: str) -> DataFrame:
    bins = {"occupancy_bin": (roles.occupancy, 10), "temperature_bin": (roles.temperature, 2),
            "hvac_bin": (roles.hvac, 10)}
    return df.withColumns({n: nearest_bin(F.col(bins[n][0]), bins[n][1]) for n in names})


def _measures(roles: Roles) -> dict[str, Measure]:
    return {
        "n": Measure("count"), "energy": Measure("sum", roles.measure), "avg_energy": Measure("avg", roles.measure),
        "cost": Measure("sum", roles.cost), "co2": Measure("sum", roles.co2),
        "avg_occupancy": Measure("avg", roles.occupancy),
    }


def dashboard_panels(df: DataFrame, roles: Roles = METERED, **filters: str | int | None) -> DataFrame:
    """Seven KPIs and six series over the rows that match the filters."""
    rows = _with_bins(apply_filters(df, roles, **filters), roles, "occupancy_bin", "temperature_bin")
    bundles = [[roles.month, roles.hour], [roles.entity], [roles.category, "occupancy_bin", "temperature_bin"]]
    return panel_bundle(rows, bundles, _measures(roles), [
        Kpi("records", "n"), Kpi("total_energy", "energy"), Kpi("avg_energy", "avg_energy"),
        Kpi("total_cost", "cost"), Kpi("total_co2", "co2"), Kpi("avg_occupancy", "avg_occupancy"),
        Extreme("top_building", roles.entity, "energy"),
        Series("monthly", roles.month, "energy", month_label),
        Series("hourly", roles.hour, "avg_energy", hour_label),
        Series("building", roles.entity, "energy", falling=True),
        Series("category", roles.category, "n", order=roles.category_order),
        Series("occupancy", "occupancy_bin", "avg_energy", percent_label),
        Series("temperature", "temperature_bin", "avg_energy", degree_label),
    ])


def analysis_panels(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """Eleven statistics and eight series over all rows."""
    bundles = [[roles.month, roles.hour], [roles.entity], ["occupancy_bin", "hvac_bin"], ["temperature_bin"]]
    measures = {**_measures(roles), "avg_temperature": Measure("avg", roles.temperature)}
    rows = _with_bins(df, roles, "occupancy_bin", "temperature_bin", "hvac_bin")
    return panel_bundle(rows, bundles, measures, [
        Kpi("records", "n"), GroupCount("buildings", roles.entity),
        Kpi("avg_temperature", "avg_temperature"), Kpi("avg_occupancy", "avg_occupancy"),
        Kpi("total_cost", "cost"), Kpi("total_co2", "co2"),
        Extreme("peak_hour", roles.hour, "energy", hour_label),
        Extreme("highest_building", roles.entity, "energy"),
        Extreme("lowest_building", roles.entity, "energy", largest=False),
        Series("monthly", roles.month, "energy", month_label),
        Series("hourly", roles.hour, "avg_energy", hour_label),
        Series("building", roles.entity, "energy", falling=True),
        Series("cost", roles.entity, "cost", falling=True),
        Series("co2", roles.entity, "co2", falling=True),
        Series("occupancy", "occupancy_bin", "avg_energy", percent_label),
        Series("temperature", "temperature_bin", "avg_energy", degree_label),
        Series("hvac", "hvac_bin", "avg_energy", percent_label),
    ])
