import pytest
from pyspark.sql import functions as F

from wattframe.errors import ArgumentError
from wattframe.functions.bins import nearest_bin
from wattframe.operators import series as S
from wattframe.operators.filters import apply_filters
from wattframe.plans.dashboard import analysis_panels, dashboard_panels
from workload.readings import READINGS


def panel(df, name):
    rows = df.where(F.col("panel") == name).orderBy("sort_key").collect()
    return [(r["label"], r["value"]) for r in rows]


def test_bin_edges(spark):
    df = spark.createDataFrame([(5.0,), (15.0,), (-1.0,), (-0.3,)], "v double")
    rows = df.select(nearest_bin(F.col("v"), 10).alias("a"), nearest_bin(F.col("v"), 2).alias("b")).collect()
    assert [r["a"] for r in rows] == [10.0, 20.0, 0.0, 0.0]
    assert [r["b"] for r in rows] == [6.0, 16.0, -2.0, 0.0]
    assert str(rows[3]["b"]) == "0.0"


def test_bundle_equals_separate_queries(readings):
    bundle = dashboard_panels(readings, READINGS)
    monthly = [(r["label"], r["value"]) for r in S.monthly_energy(readings, READINGS).orderBy("month").collect()]
    buildings = [
        (r["building_name"], r["value"])
        for r in S.entity_energy(readings, READINGS).orderBy(F.desc("value")).collect()
    ]
    assert panel(bundle, "monthly") == monthly
    assert panel(bundle, "building") == buildings
    assert panel(bundle, "top_building")[0][0] == buildings[0][0]
    analysis = analysis_panels(readings, READINGS)
    assert panel(analysis, "lowest_building")[0][0] == buildings[-1][0]
    assert dict(panel(analysis, "kpi"))["buildings"] == len(buildings)


def test_no_matching_row(readings):
    rows = dashboard_panels(readings, READINGS, building="nowhere")
    assert panel(rows, "top_building") == [("-", 0.0)]
    assert panel(rows, "kpi") == [(n, 0.0) for n in (
        "records", "total_energy", "avg_energy", "total_cost", "total_co2", "avg_occupancy")]
    assert rows.count() == 7
    assert S.top_entity(apply_filters(readings, READINGS, building="nowhere"), READINGS).first()["top_building"] == "-"


def test_null_measures_and_null_groups(readings):
    rows = readings.withColumns({
        "energy_consumption_kwh": F.when(F.col("month") != 3, F.col("energy_consumption_kwh")),
        "hour": F.when(F.col("hour") != 5, F.col("hour")),
    })
    bundle = dashboard_panels(rows, READINGS)
    assert dict(panel(bundle, "monthly"))["Mar"] == 0.0
    hours = panel(bundle, "hourly")
    assert hours[0][0] is None and len(hours) == 24


def test_unknown_category_is_not_listed(readings):
    rows = readings.withColumn("energy_category", F.when(F.col("energy_category") != "Low", F.col("energy_category"))
                               .otherwise("Odd"))
    assert [label for label, _ in panel(dashboard_panels(rows, READINGS), "category")] == ["Medium", "High"]


def test_filters(readings):
    assert apply_filters(readings, READINGS, building="", building_type=None, month="all").count() == readings.count()
    assert apply_filters(readings, READINGS, month="3").count() == readings.where("month = 3").count()
    with pytest.raises(ArgumentError):
        apply_filters(readings, READINGS, month="March")


def test_ties_go_to_the_first_name(spark):
    rows = [("b", 1, 1.0), ("a", 2, 1.0)]
    df = spark.createDataFrame(rows, "building_name string, hour int, energy_consumption_kwh double").selectExpr(
        "*", "0D AS estimated_cost_inr", "0D AS co2_kg")
    assert S.top_entity(df).first()["top_building"] == "a"
    assert S.peak_hour(df).first()["hour"] == 1


def test_one_scan_of_the_needed_columns(spark):
    """Planned on another table than the cached one, and not run."""
    from workload.readings import readings as build

    df = dashboard_panels(build(spark, "/root/testdata/sf0.01"), READINGS, month=3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    assert plan.count("Expand [[") == 1
    assert "l_returnflag" not in plan and "l_linenumber" not in plan
    assert "(month(cast(l_shipdate" in plan.split("FileScan parquet [l_orderkey")[1].split("PartitionFilters")[0]
