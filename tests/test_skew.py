"""A third of all rows shares one building, one value and one class, another third is one repeated row."""

import statistics
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wattframe.operators import cleaning as C
from wattframe.operators import series as S
from wattframe.operators.itemsets import frequent_itemsets
from wattframe.operators.levels import floor_area_defaults
from wattframe.operators.splitting import split_stratified
from wattframe.plans.dashboard import dashboard_panels
from workload.readings import READINGS

ROWS = 9000
ROLES = replace(READINGS, timestamp="timestamp", key=())


@pytest.fixture(scope="module")
def skewed(spark):
    n = F.col("id")
    hot, repeated = n % 3 == 0, n % 3 == 1
    pick = lambda a, b, c: F.when(hot, a).when(repeated, b).otherwise(c)
    df = spark.range(ROWS).repartition(7).select(
        F.when(~repeated, n).alias("reading"),
        pick(F.lit("Hot"), F.lit("Same"), F.concat(F.lit("B"), (n % 500).cast("string"))).alias("building_name"),
        pick(F.lit("Lab"), F.lit("Hall"), F.concat(F.lit("T"), (n % 4).cast("string"))).alias("building_type"),
        F.lit("2024-01-01 00:00:00").alias("timestamp"),
        pick(F.lit(5), F.lit(6), (n % 24).cast("int")).alias("hour"),
        pick(F.lit(3), F.lit(4), (n % 12 + 1).cast("int")).alias("month"),
        F.lit(0).alias("is_weekend"),
        pick(F.when(n % 9 != 0, 20.0), F.lit(21.0), (n % 400) / 10).alias("temperature_c"),
        pick(F.lit(50.0), F.lit(60.0), (n % 101).cast("double")).alias("occupancy_pct"),
        pick((n % 700).cast("double"), F.lit(9.0), (n % 31).cast("double")).alias("floor_area_sqft"),
        pick(F.when(n % 9 != 0, F.lit("Low")), F.lit("Low"), F.lit("High")).alias("occupancy_level"),
        F.lit("Low").alias("temperature_level"),
        pick(F.lit(10.25), F.lit(3.5), (n % 1000) / 8).alias("energy_consumption_kwh"),
        pick(F.lit("High"), F.lit("Low"), F.lit("Medium")).alias("energy_category"),
        F.lit(1.0).alias("estimated_cost_inr"), F.lit(1.0).alias("co2_kg"),
    )
    return df.cache()


@pytest.fixture(scope="module")
def rows(skewed):
    return skewed.collect()


def test_cleaning(skewed, rows):
    cleaned = C.clean(skewed, ROLES)
    distinct = set(rows)
    assert cleaned.rows.count() == len(distinct) == ROWS - ROWS // 3 + 1
    known = [r["temperature_c"] for r in distinct if r["temperature_c"] is not None]
    levels = Counter(r["occupancy_level"] for r in distinct if r["occupancy_level"] is not None)
    assert cleaned.fills["temperature_c"] == statistics.median(known)
    assert cleaned.fills["occupancy_level"] == min(levels, key=lambda x: (-levels[x], x))


def test_dashboard(skewed, rows):
    totals = Counter()
    for r in rows:
        totals[r["building_name"]] += r["energy_consumption_kwh"]
    got = {r["label"]: r["value"] for r in dashboard_panels(skewed, ROLES).where("panel = 'building'").collect()}
    assert got == {name: round(total, 2) for name, total in totals.items()}
    assert S.top_entity(skewed, ROLES).first()["top_building"] == max(totals, key=totals.get)


def test_group_medians(skewed, rows):
    areas = {}
    for r in rows:
        areas.setdefault(r["building_type"], []).append(r["floor_area_sqft"])
    got = {r["building_type"]: r["floor_area_sqft"] for r in floor_area_defaults(skewed, ROLES).collect()}
    assert got == {k: statistics.median(v) for k, v in areas.items()}


def test_item_sets(skewed, rows):
    found = frequent_itemsets(skewed, 0.3, ROLES)
    counts = {tuple(r["items"]): r["n"] for r in found.sets.collect()}
    both = ("building_type=Lab", "energy_category=High")
    assert counts[both] == sum(r["building_type"] == "Lab" and r["energy_category"] == "High" for r in rows)
    assert found.transactions == ROWS


def test_stratified_split_of_distinct_keys(skewed):
    keyed = skewed.withColumn("reading", F.coalesce("reading", F.monotonically_increasing_id() + ROWS))
    sides = split_stratified(keyed, ["reading"], "energy_category")
    for row in sides.groupBy("energy_category").agg(F.count_if(F.col("side") == "test").alias("t")).collect():
        assert row["t"] == ROWS // 3 // 5
