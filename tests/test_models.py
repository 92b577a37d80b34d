import os
import shutil

import pytest
from pyspark.sql import functions as F

from wattframe.operators import trees as T
from wattframe.plans.classification import classification_report
from wattframe.plans.quality import quality_report
from wattframe.plans.scoring import classify_records, predict_records
from wattframe.plans.regression import regression_report
from wattframe.session import scratch_dir
from wattframe.sources.model_store import StoredModel, fit_or_load
from workload import model_queries
from workload.readings import RAW, READINGS, readings_raw


@pytest.fixture(scope="module")
def tree(readings):
    return classification_report(readings, READINGS)


def test_tree_beats_the_majority(tree, readings):
    shares = [r["count"] for r in readings.groupBy("energy_category").count().collect()]
    sides = {r["side"]: r for r in tree.reports["accuracy"].collect()}
    assert sides["test"]["accuracy"] > max(shares) / sum(shares) + 0.15
    assert sides["test"]["records"] + sides["train"]["records"] == sum(shares)
    assert tree.size["depth"] <= 6
    weighted = tree.reports["weighted"].first()
    assert 0 < weighted["f1"] <= 1
    assert weighted["recall"] == pytest.approx(sides["test"]["accuracy"])


def test_importance_sums_to_one_over_source_columns(tree):
    rows = tree.reports["importance"].collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1, abs=1e-3)
    assert {r["feature"] for r in rows} == {*READINGS.class_numeric, *READINGS.class_categorical}


def test_tree_view(tree):
    rows = {r["node_id"]: r for r in tree.reports["tree"].collect()}
    root = rows[0]
    assert root["depth"] == 0 and root["parent_id"] is None and root["split"]
    assert root["samples"] == tree.reports["sizes"].where("side = 'train'").first()["records"]
    assert max(r["depth"] for r in rows.values()) <= 3
    for r in rows.values():
        children = [c for c in rows.values() if c["parent_id"] == r["node_id"]]
        assert len(children) in (0, 2)
        assert r["samples"] >= 10
        if children:
            assert sum(c["samples"] for c in children) == r["samples"]
            assert {c["branch"] for c in children} == {"yes", "no"}
            first = min(children, key=lambda c: c["node_id"])
            assert first["branch"] == ("yes" if r["split_value"] is None else "no")
            assert not r["truncated"]
        if r["truncated"]:
            assert r["depth"] == 3 and r["split"] is None


def test_scores_have_shares_that_sum_to_one(tree, readings):
    scored = T.score_category(readings.limit(200), tree.model, READINGS)
    for r in scored.collect():
        shares = {c: r[f"p_{c.lower()}"] for c in READINGS.category_order}
        assert sum(shares.values()) == pytest.approx(1)
        assert r["confidence"] == shares[r["predicted"]] == max(shares.values())


def test_unknown_category_is_scored_without_failing(tree, readings):
    odd = readings.limit(5).withColumn("building_type", F.lit("never seen"))
    assert T.score_category(odd, tree.model, READINGS).where("predicted IS NOT NULL").count() == 5


def test_forest_beats_the_mean(readings):
    report = regression_report(readings, READINGS, trees=5, max_depth=6)
    metrics = report.reports["metrics"].first()
    assert metrics["r2"] > 0.5 and metrics["mae"] < metrics["rmse"]
    importance = report.reports["importance"].collect()
    assert sum(r["importance"] for r in importance) == pytest.approx(1, abs=1e-3)
    assert "building_type" in {r["feature"] for r in importance}
    assert report.reports["residuals"].agg(F.sum("n")).first()[0] == metrics["records"]
    assert report.reports["scatter"].count() == 500
    scored = T.score_energy(readings.limit(20), report.model)
    for r in scored.collect():
        assert r["cost_inr"] == pytest.approx(r["energy_kwh"] * 8.5, abs=0.05)


def test_negative_prediction_is_clamped(spark):
    df = spark.createDataFrame([(-3.0,), (2.345,), (0.0,)], "p double")
    rows = df.select(*[x.alias(c) for c, x in T.energy_outputs(F.col("p")).items()]).collect()
    assert tuple(rows[0]) == (0.0, 0.0, 0.0)
    assert rows[1]["cost_inr"] == 19.93 and rows[1]["co2_kg"] == 1.66


def test_model_is_reused_until_data_or_parameters_change(spark, readings):
    path = scratch_dir(spark, "model")
    train = readings.select("reading_id", *READINGS.class_numeric, *READINGS.class_categorical, "energy_category")
    fits = []

    def fit(data):
        fits.append(1)
        return T.fit_tree(data, READINGS, max_depth=2)

    first = fit_or_load(spark, path, train, {"max_depth": 2}, fit)
    again = fit_or_load(spark, path, train.repartition(3), {"max_depth": 2}, fit)
    assert (first.reused, again.reused, len(fits)) == (False, True, 1)
    one, two = (sorted(map(tuple, T.predict_category(train, m.model).select("reading_id", "predicted").collect()))
                for m in (first, again))
    assert one == two
    assert not fit_or_load(spark, path, train.limit(500), {"max_depth": 2}, fit).reused
    assert not fit_or_load(spark, path, train.limit(500), {"max_depth": 3}, fit).reused
    shutil.rmtree(os.path.join(path, "model", "stages"))
    assert not fit_or_load(spark, path, train.limit(500), {"max_depth": 3}, fit).reused


def test_quality_report_has_all_tables(spark, sf_dir):
    report = quality_report(readings_raw(spark, sf_dir).selectExpr(
        "*", "50D AS humidity_pct", "hour * 2D AS hvac_usage_pct", "hour * 3D AS lighting_usage_pct",
        "1000D AS floor_area_sqft", "'Low' AS temperature_level"), RAW)
    assert len(report) == 11
    assert {name: df.count() for name, df in report.items()} == {
        "before": 1, "after": 1, "steps": 7, "missing_by_col": 4, "timestamp": 1, "encoding": 4, "scaling": 8,
        "selection": 10, "excluded": 3, "preview": 5, "scaled_preview": 5}


def test_records_in_records_out(tree, spark, readings):
    rows = readings.select("reading_id", *READINGS.class_numeric, *READINGS.class_categorical).limit(100)
    broken = rows.withColumn("hour", F.when(F.col("reading_id") % 3 == 0, "late").otherwise(F.col("hour").cast("string")))
    scored = classify_records(broken, tree.model, tree.domains, ["reading_id"], READINGS).collect()
    assert len(scored) == 100
    plain = {r["reading_id"]: r["predicted"] for r in T.score_category(rows, tree.model, READINGS).collect()}
    for r in scored:
        if r["reading_id"] % 3 == 0:
            assert tuple(r)[1:] == ("'hour' must be a number.", None, None, None, None, None)
        else:
            assert r["error"] is None and r["predicted"] == plain[r["reading_id"]]


def test_energy_of_records(spark, readings):
    report = regression_report(readings, READINGS, trees=2, max_depth=3)
    rows = readings.select("reading_id", *READINGS.regression_numeric, *READINGS.regression_categorical).limit(50)
    odd = rows.withColumn("building_type", F.lit("Castle"))
    scored = predict_records(rows.unionAll(odd), report.model, report.domains, ["reading_id"], READINGS)
    assert scored.where("error = 'Unknown building type.' AND energy_kwh IS NULL").count() == 50
    assert scored.where("error IS NULL AND energy_kwh > 0 AND co2_kg > 0").count() == 50


def test_rows_of_a_fit_partition_are_bounded(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS x")
    assert T.settled(rows, ["id", "x"]).rdd.getNumPartitions() == T.FIT_PARTITIONS == 16
    monkeypatch.setattr(T, "PARTITION_ROWS", 10)
    sizes = T.settled(rows, ["id", "x"]).rdd.glom().map(len).collect()
    assert len(sizes) == 100 and sum(sizes) == 1000 and max(sizes) < 40
    forest = T.fit_forest(spark.range(60).selectExpr("1 AS hour", "id * 1D AS energy_consumption_kwh", "'a' AS building_type", *[
        f"id * 1D AS {c}" for c in READINGS.regression_numeric if c != "hour"]), READINGS, trees=2, max_depth=2)
    assert not T.tree_of(forest).getCacheNodeIds()  # ids per row and tree took more room than the rows


def test_model_store_is_tried_on_another_order_without_a_fixed_number_of_tasks(spark, sf_dir, monkeypatch):
    frames = []

    def seen(spark, path, frame, depth, fit):
        frames.append(frame)
        return StoredModel(None, False)

    monkeypatch.setattr(model_queries, "fit_or_load", seen)
    monkeypatch.setattr(model_queries.T, "predict_category", lambda frame, model: frame)
    assert [r["records"] for r in model_queries.model_store(spark, sf_dir).collect()] == [frames[0].count()] * 3
    assert "REPARTITION_BY_COL" in frames[1]._jdf.queryExecution().executedPlan().toString()
