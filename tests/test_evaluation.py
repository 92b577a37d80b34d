import random
from dataclasses import replace
from functools import partial

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from wattframe.operators import evaluation as E
from wattframe.operators import levels as L
from wattframe.operators.encoding import slot_table, stored_domains
from wattframe.operators.splitting import split_random, split_stratified
from wattframe.operators.validation import class_input_check, energy_input_check, validate
from wattframe.roles import METERED
from wattframe.session import materialize
from workload.readings import READINGS

CLASSES = METERED.category_order


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "a string, p string")


def test_class_never_predicted(spark):
    df = labels(spark, [("Low", "High"), ("High", "High"), ("High", "High"), ("Medium", "High")])
    scores = {r["class"]: r for r in E.per_class_scores(df, "a", "p", CLASSES).collect()}
    assert tuple(scores["Low"])[1:] == (0.0, 0.0, 0.0, 1)
    assert scores["High"]["precision"] == 0.5
    matrix = {(r["actual"], r["predicted"]): r["n"] for r in E.confusion_matrix(df, "a", "p", CLASSES).collect()}
    assert len(matrix) == 9 and matrix[("Low", "Low")] == 0 and matrix[("High", "High")] == 2


def test_scores_match_the_library_evaluators(readings):
    code = {c: F.array_position(F.array(*[F.lit(x) for x in CLASSES]), F.col(c)).cast("double")
            for c in ("energy_category", "pred_category")}
    coded = readings.select(code["energy_category"].alias("label"), code["pred_category"].alias("prediction"))
    weighted = E.weighted_scores(E.per_class_scores(readings, "energy_category", "pred_category", CLASSES)).first()
    for ours, theirs in (("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        assert weighted[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(coded))
    metrics = E.regression_metrics(readings, "energy_consumption_kwh", "pred_kwh").first()
    for name in ("mae", "rmse", "r2"):
        evaluator = RegressionEvaluator(predictionCol="pred_kwh", labelCol="energy_consumption_kwh", metricName=name)
        assert metrics[name] == pytest.approx(evaluator.evaluate(readings))


def histogram(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "residual double")
    return {r["bin"]: r for r in E.residual_histogram(df).collect()}


def test_histogram_edges(spark):
    bins = histogram(spark, [0, 20, 20, 3.5])
    assert sorted(bins) == list(range(1, 21))
    assert (bins[20]["n"], bins[1]["n"], bins[4]["n"]) == (2, 1, 1)
    assert bins[1]["label"] == "0.5"
    flat = histogram(spark, [2, 2, 2])
    assert flat[11]["n"] == 3 and flat[1]["midpoint"] == pytest.approx(1.525)
    values = np.random.default_rng(1).normal(size=500)
    assert [r["n"] for _, r in sorted(histogram(spark, values).items())] == np.histogram(values, 20)[0].tolist()


def test_constant_target(spark):
    df = spark.createDataFrame([(2.0, 2.0, 3.0)] * 3, "a double, p double, q double")
    assert E.regression_metrics(df, "a", "p").first()["r2"] == 1.0
    assert E.regression_metrics(df, "a", "q").first()["r2"] == 0.0


@pytest.mark.parametrize("partitions", [1, 4, 8])
def test_splits_and_samples_do_not_depend_on_partitions(readings, partitions):
    key = ("reading_id", "energy_consumption_kwh")
    moved = readings.repartition(partitions, "hour")
    chosen = lambda df: sorted(r["reading_id"] for r in df.collect())
    assert chosen(split_random(moved, key).where("side = 'test'")) == chosen(
        split_random(readings, key).where("side = 'test'"))
    assert chosen(E.sample_rows(moved, key, 50)) == chosen(E.sample_rows(readings, key, 50))
    assert chosen(split_stratified(moved, key, "energy_category").where("side = 'test'")) == chosen(
        split_stratified(readings, key, "energy_category").where("side = 'test'"))


def test_stratified_split_keeps_the_shares(readings):
    sides = split_stratified(readings, ("reading_id", "energy_consumption_kwh"), "energy_category")
    for row in sides.groupBy("energy_category").agg(
            F.count_if(F.col("side") == "test").alias("t"), F.count("*").alias("n")).collect():
        assert row["t"] == round(row["n"] * 0.2)


def test_nearest_level_ties_go_to_the_first_name(spark):
    levels = spark.createDataFrame([("Low", 0.0, 10.0), ("High", 20.0, 30.0), ("None", None, None)], "level string, low double, high double")
    df = spark.createDataFrame([(v,) for v in (5.0, 14.9, 15.0, 15.1, 99.0, -4.0, None, float("nan"))], "v double").coalesce(1)
    for few in (True, False):
        of = (lambda v, x: L.with_nearest_level(df, v, levels, x)) if few else partial(L.nearest_level_table(levels).of, df)
        assert [r["x"] for r in of(F.col("v"), "x").collect()] == ["Low", "Low", "High", "High", "High", "Low", None, None]
    assert L.with_nearest_level(df, F.col("v"), levels.limit(0), "x").where("x IS NOT NULL").isEmpty()
    assert L.nearest_level_table(levels.limit(0)).of(df, F.col("v"), "x").where("x IS NOT NULL").isEmpty()


def brute_nearest(value, levels):
    return min((max(low - value, value - high, 0.0), name) for name, low, high in levels)[1]


@pytest.mark.parametrize("small", [True, False])
def test_nearest_of_many_overlapping_levels(spark, monkeypatch, small):
    monkeypatch.setattr(L, "BUCKET", 5)
    rng = random.Random(8)
    levels = []
    for i in range(300):
        low = rng.randrange(0, 400) / 2
        levels.append((f"l{rng.randrange(10**6)}-{i}", low, low + rng.choice([0, 0, 0.5, 1, 3, 60 if i % 40 == 0 else 0])))
    values = [rng.randrange(-40, 1000) / 4 for _ in range(800)] + [levels[0][1]] * 200
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "level long, value double")
    table = replace(L.nearest_level_table(spark.createDataFrame(levels, "level string, low double, high double")), small=small)
    got = {r["level"]: r["nearest"] for r in table.of(df, F.col("value"), "nearest").collect()}
    assert got == {i: brute_nearest(v, levels) for i, v in enumerate(values)}


def test_a_hundred_thousand_levels(spark):
    """Points two apart, each a level of its own; values between meet the nearer one."""
    levels = spark.range(100_000).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("level"),
                                         (2.0 * F.col("id")).alias("low"), (2.0 * F.col("id")).alias("high"))
    values = spark.range(50_000).select("id", (4.0 * F.col("id") + F.when(F.col("id") % 2 == 0, 0.9).otherwise(1.1)).alias("v"))
    wanted = 2 * F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(1)
    found = L.nearest_level_table(levels).of(values, F.col("v"), "level")
    assert found.where(F.substring("level", 2, 6).cast("long") == wanted).count() == 50_000


@pytest.mark.parametrize("small", [True, False])
def test_domains_of_any_size(spark, small):
    domains = spark.range(50_000).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value")) for c in DOMAINS])))
    known = replace(stored_domains(domains, list(DOMAINS)), small=small)
    numbers = {c: F.lit(v) for c, v in RECORD.items() if c not in DOMAINS}
    rows = spark.range(3000).select("id", *[v.alias(c) for c, v in numbers.items()], *[
        F.concat(F.lit("v"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * (40 if c == "building_type" else 16)).cast("string")).alias(c)
        for c in DOMAINS])
    errors = validate(rows, class_input_check(known)).select("id", "error").collect()
    assert len(errors) == 3000
    for r in errors:
        if r["id"] % 3 == 0 or r["id"] * 40 < 50_000:
            assert r["error"] is None
        else:
            assert r["error"].startswith("'building_type' must be one of: v0, v1, v10, ") and r["error"].endswith(" and 49000 more.")


def test_a_million_categories_in_slots(spark):
    many = spark.range(1_000_000).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("c"))
    table = slot_table(many, "c")
    assert table.size == 1_000_000
    rows = spark.createDataFrame([("c000000",), ("c123456",), ("c999999",), ("unknown",), (None,), ("c123456",)], "c string")
    assert not table.small
    size = 1_000_000
    got = sorted((r["c"] or "", r["c_slots"].size, list(r["c_slots"].indices)) for r in table.encode(rows).collect())
    assert got == [("", size, []), ("c000000", size, [0]), ("c123456", size, [123456]), ("c123456", size, [123456]),
                   ("c999999", size, [999999]), ("unknown", size, [])]


RECORD = {
    "temperature_c": "20", "humidity_pct": "40.5", "occupancy_pct": "0", "hvac_usage_pct": "100",
    "lighting_usage_pct": "1e1", "hour": "23", "floor_area_sqft": "900", "building_type": "Lab",
    "temperature_level": "Low", "occupancy_level": "High",
}
DOMAINS = {"building_type": ["Hall", "Lab"], "temperature_level": ["High", "Low"], "occupancy_level": ["High"]}
BROKEN = [
    ({}, None, None),
    ({"hour": "24"}, "Hour must be between 0 and 23.", "Hour must be between 0 and 23."),
    ({"occupancy_pct": "101"}, "'occupancy_pct' must be between 0 and 100.", "'occupancy_pct' must be between 0 and 100."),
    ({"temperature_c": "NaN"}, "'temperature_c' must be a finite number.", "'temperature_c' must be a finite number."),
    ({"hour": "-Infinity"}, "'hour' must be a finite number.", "'hour' must be a finite number."),
    ({"humidity_pct": None, "hour": "24"}, "'humidity_pct' must be a number.", "'humidity_pct' must be a number."),
    ({"building_type": "Castle"}, "'building_type' must be one of: Hall, Lab.", "Unknown building type."),
    ({"building_type": None}, "'building_type' must be one of: Hall, Lab.", "Unknown building type."),
    ({"occupancy_level": "Low"}, "'occupancy_level' must be one of: High.", None),
    ({"floor_area_sqft": "0", "hour": "99"}, "Hour must be between 0 and 23.", "Floor area must be greater than 0."),
]


def test_first_broken_rule_is_named(spark):
    rows = [tuple({**RECORD, **change}.values()) for change, _, _ in BROKEN]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RECORD)).coalesce(1)
    pairs = [(c, v) for c, values in DOMAINS.items() for v in values]
    known = stored_domains(spark.createDataFrame(pairs, "column string, value string"), list(DOMAINS))
    assert [r["error"] for r in validate(df, class_input_check(known)).collect()] == [c for _, c, _ in BROKEN]
    assert [r["error"] for r in validate(df, energy_input_check(known)).collect()] == [e for _, _, e in BROKEN]


def test_missing_floor_area_is_filled_by_type(spark):
    rows = [("Lab", 100.0), ("Lab", 200.0), ("Hall", 50.0), ("Lab", None), ("Barn", None)]
    df = spark.createDataFrame(rows, "building_type string, floor_area_sqft double")
    filled = L.with_floor_area(df, L.floor_area_defaults(df, READINGS), READINGS)
    assert sorted((r["building_type"], r["floor_area_sqft"] or -1) for r in filled.collect()) == [
        ("Barn", -1), ("Hall", 50.0), ("Lab", 100.0), ("Lab", 150.0), ("Lab", 200.0)]


def test_the_table_of_many_levels_is_never_broadcast(spark, monkeypatch):
    """Files of a few MB can hold millions of ends, so no side that grows with the levels may go through the driver."""
    plans = {}

    def recorded(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, label)

    monkeypatch.setattr(L, "materialize", recorded)
    intervals = spark.range(200).selectExpr("lpad(id, 3, '0') AS level", "id * 2D AS low", "id * 2D + 1 AS high")
    table = L.nearest_level_table(intervals)
    assert "SortMergeJoin" in plans["nearest"] and "BroadcastHashJoin" not in plans["nearest"]
    found = table.of(spark.createDataFrame([(4.5,), (5.4,), (5.6,)], "v double"), F.col("v"), "level").orderBy("v").collect()
    assert [r["level"] for r in found] == ["002", "002", "003"]
