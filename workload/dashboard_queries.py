"""Filters, series and the two dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.functions.bins import nearest_bin
from wattframe.functions.labels import degree_label, hour_label, month_label, percent_label
from wattframe.functions.numbers import half_up
from wattframe.operators import series as S
from wattframe.operators.filters import apply_filters, category_options, filter_options
from wattframe.plans.dashboard import analysis_panels, dashboard_panels
from workload.readings import READINGS, duckdb_cte, readings
from workload.registry import half_up_sql as hu
from workload.registry import query

R = duckdb_cte()
E = "energy_consumption_kwh"
MONTH = "strftime(make_date(2000, CAST(month AS INT), 1), '%b')"
HOUR = "lpad(CAST(hour AS VARCHAR), 2, '0') || ':00'"


def _bin(column: str, width: int) -> str:
    return f"(round({column} / {width}.0) * {width}.0 + 0.0)"


def _rounded(df, columns, digits=2):
    return df.withColumns({c: half_up(F.col(c), digits) for c in columns})


_KPIS = f"""SELECT count(*) AS records, {hu(f'coalesce(sum({E}), 0)', 2)} AS total_energy,
 {hu(f'coalesce(avg({E}), 0)', 4)} AS avg_energy, {hu('coalesce(sum(estimated_cost_inr), 0)', 2)} AS total_cost,
 {hu('coalesce(sum(co2_kg), 0)', 2)} AS total_co2, {hu('coalesce(avg(occupancy_pct), 0)', 4)} AS avg_occupancy
 FROM readings"""


def _kpis(df):
    rounded = _rounded(S.usage_kpis(df, READINGS), ["total_energy", "total_cost", "total_co2"])
    return _rounded(rounded, ["avg_energy", "avg_occupancy"], 4)


@query("dashboard_kpis", R + _KPIS)
def dashboard_kpis(spark, sf_dir):
    return _kpis(readings(spark, sf_dir))


@query("filtered_kpis", R + _KPIS + " WHERE building_type = 'ASIA' AND month = 3 AND energy_category = 'High'")
def filtered_kpis(spark, sf_dir):
    rows = apply_filters(readings(spark, sf_dir), READINGS, building="all", building_type="ASIA", month="3",
                         category="High")
    return _kpis(rows)


@query("filter_options", R + f"""SELECT DISTINCT 'building' AS kind, building_name AS value, building_name AS label
 FROM readings UNION ALL SELECT DISTINCT 'building_type', building_type, building_type FROM readings
 UNION ALL SELECT DISTINCT 'month', lpad(CAST(month AS VARCHAR), 2, '0'), {MONTH} FROM readings
 UNION ALL SELECT DISTINCT 'category', energy_category, energy_category FROM readings""")
def options(spark, sf_dir):
    return filter_options(readings(spark, sf_dir), READINGS)


_POSITION = "CASE energy_category WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END"


@query("category_options", R + f"""SELECT DISTINCT {_POSITION} AS position, energy_category AS category FROM readings
 WHERE {_POSITION} IS NOT NULL""")
def categories(spark, sf_dir):
    return category_options(readings(spark, sf_dir), READINGS)


@query("top_building", R + f"""SELECT building_name AS top_building, {hu(f'sum({E})', 2)} AS total_energy
 FROM readings GROUP BY building_name ORDER BY sum({E}) DESC, building_name LIMIT 1""")
def top_building(spark, sf_dir):
    return _rounded(S.top_entity(readings(spark, sf_dir), READINGS), ["total_energy"])


@query("monthly_energy", R + f"SELECT month, {MONTH} AS label, {hu(f'sum({E})', 2)} AS value FROM readings GROUP BY month")
def monthly_energy(spark, sf_dir):
    return S.monthly_energy(readings(spark, sf_dir), READINGS)


@query("hourly_energy", R + f"SELECT hour, {HOUR} AS label, {hu(f'avg({E})', 2)} AS value FROM readings GROUP BY hour")
def hourly_energy(spark, sf_dir):
    return S.hourly_energy(readings(spark, sf_dir), READINGS)


@query("building_energy", R + f"SELECT building_name, {hu(f'sum({E})', 2)} AS value FROM readings GROUP BY building_name")
def building_energy(spark, sf_dir):
    return S.entity_energy(readings(spark, sf_dir), READINGS)


@query("category_counts", R + f"""SELECT {_POSITION} AS position, energy_category AS category, count(*) AS records
 FROM readings WHERE {_POSITION} IS NOT NULL GROUP BY ALL""")
def category_counts(spark, sf_dir):
    return S.category_counts(readings(spark, sf_dir), READINGS)


def _bins(column: str, width: int, unit: str) -> str:
    b = _bin(column, width)
    return f"""SELECT {b} AS bin, CAST(CAST({b} AS INT) AS VARCHAR) || '{unit}' AS label, {hu(f'avg({E})', 2)} AS value
 FROM readings GROUP BY {b}"""


@query("occupancy_bins", R + _bins("occupancy_pct", 10, "%"))
def occupancy_bins(spark, sf_dir):
    return S.occupancy_bins(readings(spark, sf_dir), READINGS)


@query("temperature_bins", R + _bins("temperature_c", 2, "°C"))
def temperature_bins(spark, sf_dir):
    return S.temperature_bins(readings(spark, sf_dir), READINGS)


@query("hvac_bins", R + _bins("hvac_usage_pct", 10, "%"))
def hvac_bins(spark, sf_dir):
    return S.hvac_bins(readings(spark, sf_dir), READINGS)


@query("overall_stats", R + f"""SELECT count(*) AS records, count(DISTINCT building_name) AS buildings,
 {hu('avg(temperature_c)', 4)} AS avg_temperature, {hu('avg(occupancy_pct)', 4)} AS avg_occupancy,
 {hu('sum(estimated_cost_inr)', 2)} AS total_cost, {hu('sum(co2_kg)', 2)} AS total_co2 FROM readings""")
def overall_stats(spark, sf_dir):
    stats = S.overall_stats(readings(spark, sf_dir), READINGS)
    return _rounded(_rounded(stats, ["avg_temperature", "avg_occupancy"], 4), ["total_cost", "total_co2"])


@query("building_totals", R + f"""SELECT building_name, {hu(f'sum({E})', 2)} AS energy,
 {hu('sum(estimated_cost_inr)', 2)} AS cost, {hu('sum(co2_kg)', 2)} AS co2 FROM readings GROUP BY building_name""")
def building_totals(spark, sf_dir):
    return _rounded(S.entity_totals(readings(spark, sf_dir), READINGS), ["energy", "cost", "co2"])


@query("peak_hour", R + f"""SELECT hour, {HOUR} AS peak_hour, {hu(f'sum({E})', 2)} AS energy FROM readings
 GROUP BY hour ORDER BY sum({E}) DESC, hour LIMIT 1""")
def peak_hour(spark, sf_dir):
    return _rounded(S.peak_hour(readings(spark, sf_dir), READINGS), ["energy"])


@query("extreme_buildings", R + f""", t AS (SELECT building_name AS b, sum({E}) AS v FROM readings GROUP BY 1),
 h AS (SELECT * FROM t ORDER BY v DESC, b LIMIT 1), l AS (SELECT * FROM t ORDER BY v, b DESC LIMIT 1)
 SELECT h.b AS highest_building, {hu('h.v', 2)} AS highest_value, l.b AS lowest_building,
 {hu('l.v', 2)} AS lowest_value FROM h, l""")
def extreme_buildings(spark, sf_dir):
    return _rounded(S.extreme_entities(readings(spark, sf_dir), READINGS), ["highest_value", "lowest_value"])


@query("series_labels", R + f"""SELECT DISTINCT {MONTH} AS month_label, {HOUR} AS hour_label,
 CAST(CAST({_bin('occupancy_pct', 10)} AS INT) AS VARCHAR) || '%' AS occupancy_label,
 CAST(CAST({_bin('temperature_c', 2)} AS INT) AS VARCHAR) || '°C' AS temperature_label FROM readings""")
def series_labels(spark, sf_dir):
    return readings(spark, sf_dir).select(
        month_label(F.col("month")).alias("month_label"), hour_label(F.col("hour")).alias("hour_label"),
        percent_label(nearest_bin(F.col("occupancy_pct"), 10)).alias("occupancy_label"),
        degree_label(nearest_bin(F.col("temperature_c"), 2)).alias("temperature_label"),
    ).distinct()


def _panel(panel: str, key: str, label: str, value: str, sort: str | None = None) -> str:
    return f"""SELECT '{panel}' AS panel, CAST({hu(sort or key, 2)} AS DOUBLE) AS sort_key, {label} AS label,
 {hu(value, 2)} AS value FROM readings GROUP BY {key}"""


def _kpi(values: list[tuple[int, str, str]]) -> list[str]:
    return [f"""SELECT 'kpi' AS panel, CAST({i} AS DOUBLE) AS sort_key, '{n}' AS label, {hu(f'({v})::DOUBLE', 4)} AS value
 FROM readings""" for i, n, v in values]


def _extreme(panel: str, key: str, label: str, order: str) -> str:
    return f"""(SELECT '{panel}' AS panel, CAST(0 AS DOUBLE) AS sort_key, {label} AS label, {hu(f'sum({E})', 4)} AS value
 FROM readings GROUP BY {key} ORDER BY sum({E}) {order}, {key} LIMIT 1)"""


def _binned(panel: str, column: str, width: int, unit: str) -> str:
    b = _bin(column, width)
    return _panel(panel, b, f"CAST(CAST({b} AS INT) AS VARCHAR) || '{unit}'", f"avg({E})")


_SHARED = [
    _panel("monthly", "month", MONTH, f"sum({E})"),
    _panel("hourly", "hour", HOUR, f"avg({E})"),
    _panel("building", "building_name", "building_name", f"sum({E})", f"(-sum({E}))"),
    _binned("occupancy", "occupancy_pct", 10, "%"),
    _binned("temperature", "temperature_c", 2, "°C"),
]
_DASHBOARD = " UNION ALL ".join([
    *_kpi([(0, "records", "count(*)"), (1, "total_energy", f"sum({E})"), (2, "avg_energy", f"avg({E})"),
           (3, "total_cost", "sum(estimated_cost_inr)"), (4, "total_co2", "sum(co2_kg)"),
           (5, "avg_occupancy", "avg(occupancy_pct)")]),
    _extreme("top_building", "building_name", "building_name", "DESC"),
    _panel("category", "energy_category", "energy_category", "count(*)::DOUBLE", f"({_POSITION})"),
    *_SHARED,
])
_ANALYSIS = " UNION ALL ".join([
    *_kpi([(0, "records", "count(*)"), (1, "buildings", "count(DISTINCT building_name)"),
           (2, "avg_temperature", "avg(temperature_c)"), (3, "avg_occupancy", "avg(occupancy_pct)"),
           (4, "total_cost", "sum(estimated_cost_inr)"), (5, "total_co2", "sum(co2_kg)")]),
    _extreme("peak_hour", "hour", HOUR, "DESC"),
    _extreme("highest_building", "building_name", "building_name", "DESC"),
    _extreme("lowest_building", "building_name", "building_name", "ASC"),
    _panel("cost", "building_name", "building_name", "sum(estimated_cost_inr)", "(-sum(estimated_cost_inr))"),
    _panel("co2", "building_name", "building_name", "sum(co2_kg)", "(-sum(co2_kg))"),
    _binned("hvac", "hvac_usage_pct", 10, "%"),
    *_SHARED,
])


def _shown(panels):
    return panels.withColumns({
        "sort_key": half_up(F.col("sort_key"), 2),
        "value": half_up(F.col("value"), 4),
    })


@query("dashboard_panels", R + _DASHBOARD)
def dashboard(spark, sf_dir):
    return _shown(dashboard_panels(readings(spark, sf_dir), READINGS))


@query("dashboard_filtered", R.replace("readings AS (", "all_readings AS (") +
       ", readings AS (SELECT * FROM all_readings WHERE building_type = 'ASIA' AND month = 3) " + _DASHBOARD)
def dashboard_filtered(spark, sf_dir):
    return _shown(dashboard_panels(readings(spark, sf_dir), READINGS, building_type="ASIA", month=3))


@query("analysis_panels", R + _ANALYSIS)
def analysis(spark, sf_dir):
    return _shown(analysis_panels(readings(spark, sf_dir), READINGS))
