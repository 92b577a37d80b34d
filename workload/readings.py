"""The metered-usage table derived from the benchmark tables, as text that Spark and DuckDB both run.

`readings` has one row per line item; `readings_raw` is a dirty variant with duplicate rows, gaps and bad
timestamps.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from wattframe.operators.lookups import is_small
from wattframe.roles import METERED

# The three small-to-medium tables are joined first: a filter on a building or its type then shrinks them before
# the line items are met. The key stays inside 64 bits at any table size: the modulo only bites beyond ten billion orders.
BASE_CTE = """
base AS (
 SELECT {hint}(((l_orderkey % 10000000000) * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS reading_id,
  concat('B', CAST(n_nationkey AS STRING)) AS building_id, n_name AS building_name, r_name AS building_type,
  1000 * (1 + n_nationkey % 7) AS floor_area_sqft, 1 + n_nationkey % 5 AS floor_count,
  l_shipdate + INTERVAL '1' HOUR * CAST(l_partkey % 24 AS INT) AS ts,
  CAST(l_partkey % 24 AS INT) AS hour, {dow} AS day_of_week, CAST(month(l_shipdate) AS INT) AS month,
  CASE WHEN {dow} >= 5 THEN 1 ELSE 0 END AS is_weekend,
  floor((10 + l_tax * 250 + (l_orderkey % 30) / 10) * 10 + 0.5) / 10 AS temperature_c,
  30 + (l_partkey % 600) / 10 AS humidity_pct,
  l_quantity * 2 AS occupancy_pct,
  floor((l_discount * 900 + (l_suppkey % 100) / 10) * 10 + 0.5) / 10 AS hvac_usage_pct,
  (l_partkey * 37 % 1000) / 10 AS lighting_usage_pct,
  l_extendedprice / 5000 AS base_load,
  CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END AS anomaly_flag
 FROM {lineitem} JOIN (
   SELECT s_suppkey, n_nationkey, n_name, r_name FROM {supplier}
   JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
  ) places ON l_suppkey = s_suppkey)"""

LEVELED_CTE = """
leveled AS (
 SELECT base.*,
  CASE WHEN occupancy_pct < 34 THEN 'Low' WHEN occupancy_pct < 67 THEN 'Medium' ELSE 'High' END AS occupancy_level,
  CASE WHEN temperature_c < 18 THEN 'Low' WHEN temperature_c < 26 THEN 'Medium' ELSE 'High' END AS temperature_level,
  floor((0.35 * occupancy_pct + 0.25 * hvac_usage_pct + 0.15 * lighting_usage_pct + 0.9 * abs(temperature_c - 22)
   + floor_area_sqft / 500 + base_load) * 100 + 0.5) / 100 AS energy_consumption_kwh,
  floor((18 + 0.35 * occupancy_pct + 0.25 * hvac_usage_pct + 0.15 * lighting_usage_pct) * 100 + 0.5) / 100 AS pred_kwh
 FROM base)"""

READINGS_CTE = """
readings AS (
 SELECT leveled.*,
  CASE WHEN energy_consumption_kwh < 45 THEN 'Low' WHEN energy_consumption_kwh < 65 THEN 'Medium' ELSE 'High' END AS energy_category,
  CASE WHEN pred_kwh < 45 THEN 'Low' WHEN pred_kwh < 65 THEN 'Medium' ELSE 'High' END AS pred_category,
  floor(energy_consumption_kwh * 8.5 * 100 + 0.5) / 100 AS estimated_cost_inr,
  floor(energy_consumption_kwh * 0.71 * 100 + 0.5) / 100 AS co2_kg
 FROM leveled)"""

RAW_CTE = """
dirty AS (
 SELECT reading_id, building_name, building_type,
  CASE WHEN reading_id % 211 = 0 THEN 'n/a' WHEN reading_id % 223 = 0 THEN NULL ELSE CAST(ts AS STRING) END AS timestamp_raw,
  hour, month,
  CASE WHEN reading_id % 53 = 0 THEN NULL ELSE temperature_c END AS temperature_c,
  CASE WHEN reading_id % 59 = 0 THEN NULL ELSE occupancy_pct END AS occupancy_pct,
  CASE WHEN reading_id % 61 = 0 THEN NULL ELSE occupancy_level END AS occupancy_level,
  energy_consumption_kwh, energy_category
 FROM readings),
readings_raw AS (
 SELECT * FROM dirty UNION ALL SELECT * FROM dirty WHERE reading_id % 101 = 0)"""

SPARK_DOW = "weekday(l_shipdate)"
# Line items need no shuffle to meet places that fit every task.
SPARK_HINT = "/*+ BROADCAST(places) */ "
DUCKDB_DOW = "CAST(isodow(l_shipdate) - 1 AS INT)"
TABLES = ("lineitem", "supplier", "nation", "region")

READINGS = replace(METERED, timestamp="ts", key=("reading_id",))
RAW = replace(METERED, timestamp="timestamp_raw", key=("reading_id",))


def duckdb_cte(raw: bool = False) -> str:
    chain = [BASE_CTE, LEVELED_CTE, READINGS_CTE] + ([RAW_CTE] if raw else [])
    return "WITH " + ",".join(chain).format(dow=DUCKDB_DOW, hint="", **{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """`lineitem` may be a stream; the other tables are always read as they are."""
    frames = {t: table(spark, sf_dir, t) for t in TABLES if t != "lineitem" or lineitem is None}
    if lineitem is not None:
        frames["lineitem"] = lineitem
    hint = SPARK_HINT if is_small(frames["supplier"]) else ""
    chain = ",".join([BASE_CTE, LEVELED_CTE, READINGS_CTE]).replace("{dow}", SPARK_DOW).replace("{hint}", hint)
    return spark.sql(f"WITH {chain} SELECT * FROM readings", **frames)


def readings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated rows come out of one scan: each row is emitted once or twice."""
    chain = RAW_CTE.split("readings_raw AS (")[0].rstrip().rstrip(",").replace("FROM readings", "FROM {readings}")
    return spark.sql(
        f"WITH {chain} SELECT dirty.* FROM dirty "
        "LATERAL VIEW explode(sequence(0, CASE WHEN reading_id % 101 = 0 THEN 1 ELSE 0 END)) copies AS copy_no",
        readings=readings(spark, sf_dir),
    )
