"""Which column plays which part, so that operators are not tied to one table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from wattframe.errors import LeakageError

# Class labels in report order and what they stand for as numbers.
CATEGORY_ORDER = ("Low", "Medium", "High")

# The columns of the metered-usage table by kind.
NUMERIC_COLUMNS = (
    "floor_area_sqft", "floor_count", "hour", "day_of_week", "month", "is_weekend", "temperature_c",
    "humidity_pct", "occupancy_pct", "hvac_usage_pct", "lighting_usage_pct",
    "energy_consumption_kwh", "estimated_cost_inr", "co2_kg", "anomaly_flag",
)
CATEGORICAL_COLUMNS = (
    "building_id", "building_name", "building_type", "occupancy_level", "temperature_level", "energy_category",
)

# Columns that never become features, with the reason shown in the report.
EXCLUDED_COLUMNS = (
    ("energy_consumption_kwh", "Regression target / would leak the class label"),
    ("energy_category", "Classification target"),
    ("estimated_cost_inr", "Derived from energy (target leakage)"),
    ("co2_kg", "Derived from energy (target leakage)"),
    ("anomaly_flag", "Not used (no anomaly module in this project)"),
    ("building_id", "Identifiers - no predictive meaning"),
    ("building_name", "Identifiers - no predictive meaning"),
    ("timestamp", "Identifiers - no predictive meaning"),
)


@dataclass(frozen=True)
class Roles:
    key: tuple[str, ...] = ()
    entity: str = "building_name"
    entity_type: str = "building_type"
    timestamp: str = "timestamp"
    month: str = "month"
    hour: str = "hour"
    weekend_flag: str = "is_weekend"
    measure: str = "energy_consumption_kwh"
    cost: str = "estimated_cost_inr"
    co2: str = "co2_kg"
    occupancy: str = "occupancy_pct"
    temperature: str = "temperature_c"
    hvac: str = "hvac_usage_pct"
    floor_area: str = "floor_area_sqft"
    category: str = "energy_category"
    category_order: tuple[str, ...] = CATEGORY_ORDER
    numeric: tuple[str, ...] = NUMERIC_COLUMNS
    categorical: tuple[str, ...] = CATEGORICAL_COLUMNS
    item_columns: tuple[str, ...] = (
        "building_type", "occupancy_level", "temperature_level", "energy_category", "is_weekend",
    )
    class_numeric: tuple[str, ...] = (
        "temperature_c", "humidity_pct", "occupancy_pct", "hvac_usage_pct", "lighting_usage_pct", "hour",
    )
    class_categorical: tuple[str, ...] = ("building_type", "temperature_level", "occupancy_level")
    regression_numeric: tuple[str, ...] = (
        "temperature_c", "humidity_pct", "occupancy_pct", "hvac_usage_pct", "lighting_usage_pct", "hour",
        "floor_area_sqft",
    )
    regression_categorical: tuple[str, ...] = ("building_type",)
    cluster_numeric: tuple[str, ...] = (
        "temperature_c", "occupancy_pct", "hvac_usage_pct", "lighting_usage_pct", "energy_consumption_kwh",
    )
    # The feature lists above and the columns of percentages.
    percent_columns: tuple[str, ...] = ("humidity_pct", "occupancy_pct", "hvac_usage_pct", "lighting_usage_pct")
    level_sources: tuple[tuple[str, str], ...] = (
        ("temperature_level", "temperature_c"), ("occupancy_level", "occupancy_pct"),
    )
    excluded: tuple[tuple[str, str], ...] = EXCLUDED_COLUMNS

    @property
    def scaled_columns(self) -> tuple[str, ...]:
        """Ordered distinct union of the numeric feature lists."""
        return tuple(dict.fromkeys(self.class_numeric + self.regression_numeric + self.cluster_numeric))

    def check_features(self, features: Iterable[str]) -> None:
        """Refuse a feature list that holds the target, something derived from it, or an identifier."""
        reasons = dict(self.excluded)
        reasons.setdefault(self.timestamp, reasons.get("timestamp", "identifier"))
        for key in self.key:
            reasons.setdefault(key, "identifier")
        leaks = {name: reasons[name] for name in features if name in reasons}
        if leaks:
            raise LeakageError("; ".join(f"{name}: {why}" for name, why in leaks.items()))


METERED = Roles()
