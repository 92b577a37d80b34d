from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wattframe.errors import LeakageError
from wattframe.functions.times import utc_instant, utc_wall_time
from wattframe.operators import cleaning as C
from wattframe.operators import profiling as P
from wattframe.operators.encoding import fit_scaler
from wattframe.roles import METERED
from wattframe.streaming.rollup import hourly_rollup

ROLES = replace(METERED, key=())
SCHEMA = "building_name string, timestamp string, temperature_c double, occupancy_level string"
GOOD = "2024-01-01 05:00:00"


def raw(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_filling_can_create_duplicates_that_stay(spark):
    df = raw(spark, [("A", GOOD, 1.0, "Low"), ("A", GOOD, None, "Low")])
    cleaned = C.clean(df, ROLES)
    assert cleaned.rows.count() == 2
    after = {r["stage"]: r for r in P.before_after(cleaned).collect()}["after"]
    assert (after["duplicates"], after["missing_total"]) == (1, 0)


def test_rows_dropped_later_still_shape_the_median(spark):
    df = raw(spark, [("A", GOOD, 1.0, "Low"), ("B", "n/a", 99.0, "Low"), ("C", GOOD, None, "Low")])
    cleaned = C.clean(df, ROLES)
    assert {r["building_name"]: r["temperature_c"] for r in cleaned.rows.collect()} == {"A": 1.0, "C": 50.0}
    log = {r["step"]: r for r in cleaned.log.collect()}
    assert log["invalid_timestamps_dropped"]["count"] == 1
    assert (log["missing_filled"]["column"], log["missing_filled"]["rule"]) == ("temperature_c", "median")


def test_tied_modes_and_even_median(spark):
    df = raw(spark, [
        ("A", GOOD, 1.0, "Medium"), ("B", GOOD, 2.0, "Medium"), ("C", GOOD, 3.0, "High"),
        ("D", GOOD, 10.0, "High"), ("E", GOOD, None, None),
    ])
    filled = {r["building_name"]: r for r in C.clean(df, ROLES).rows.collect()}["E"]
    assert (filled["temperature_c"], filled["occupancy_level"]) == (2.5, "High")


def test_nan_counts_as_missing_and_equals_null(spark):
    df = raw(spark, [("A", GOOD, float("nan"), "Low"), ("A", GOOD, None, "Low"), ("B", GOOD, 4.0, "Low")])
    cleaned = C.clean(df, ROLES)
    assert sorted(r["temperature_c"] for r in cleaned.rows.collect()) == [4.0, 4.0]
    assert cleaned.log.where("step = 'duplicates_removed'").first()["count"] == 1


def test_all_null_column_stays_null(spark):
    df = raw(spark, [("A", GOOD, None, None), ("B", GOOD, None, None)])
    assert [tuple(r)[2:] for r in C.clean(df, ROLES).rows.collect()] == [(None, None)] * 2


def test_clean_twice_changes_nothing(spark):
    df = raw(spark, [("A", GOOD, 1.0, "Low"), ("B", GOOD, None, None), ("B", GOOD, None, None)])
    once = C.clean(df, ROLES).rows
    twice = C.clean(once, ROLES)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.rows.collect()))
    assert twice.fills == {}


def test_explicit_timestamp_formats(spark):
    df = raw(spark, [("A", "10/03/2024 02:30", 1.0, "Low"), ("B", GOOD, 1.0, "Low"), ("C", "soon", 1.0, "Low")])
    rows = C.clean(df, ROLES, formats=("dd/MM/yyyy HH:mm",)).rows.collect()
    assert {r["building_name"]: str(r["timestamp"]) for r in rows} == {
        "A": "2024-03-10 02:30:00", "B": "2024-01-01 05:00:00"}


def test_constant_column(spark):
    df = raw(spark, [(x, GOOD, 5.0, "Low") for x in "ABC"]).withColumnRenamed("occupancy_level", "energy_category")
    z = fit_scaler(df, ["temperature_c"]).transform(df)
    assert [r["z_temperature_c"] for r in z.collect()] == [0.0] * 3
    report = P.scaling_report(df, ["temperature_c"]).first()
    assert (report["std_before"], report["std_after"]) == (0.0, 0.0)
    df = df.selectExpr("*", "ascii(building_name) * 1.0 AS target")
    assert P.corr_with_target(df, ["temperature_c"], "target").first()["corr_with_energy"] is None


def test_empty_table(spark):
    df = raw(spark, [])
    cleaned = C.clean(df, ROLES)
    assert cleaned.rows.count() == 0
    assert P.missing_profile(df).count() == 0
    assert [r["row_count"] for r in P.before_after(cleaned).collect()] == [0, 0]


def test_leaky_features_are_refused():
    METERED.check_features(METERED.class_numeric + METERED.class_categorical)
    with pytest.raises(LeakageError, match="co2_kg"):
        METERED.check_features(["temperature_c", "co2_kg"])
    with pytest.raises(LeakageError):
        replace(METERED, key=("reading_id",)).check_features(["reading_id"])


WALL_TIMES = ["2024-03-10 02:30:15.25", "2024-11-03 01:30:00", "1969-12-31 23:59:59.999999", "2262-01-01 00:00:00"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    """New York skips 02:30 on the first date and repeats 01:30 on the second."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in WALL_TIMES], "t string").withColumn(
            "t", F.col("t").cast("timestamp_ntz"))
        back = df.select(utc_wall_time(utc_instant(F.col("t"))).cast("string")).collect()
        assert [r[0] for r in back] == WALL_TIMES
        rolled = hourly_rollup(df.selectExpr("t AS timestamp", "1D AS energy_consumption_kwh"), ROLES).collect()
        assert sorted(str(r["hour_start"]) for r in rolled) == sorted(t[:13] + ":00:00" for t in WALL_TIMES)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
