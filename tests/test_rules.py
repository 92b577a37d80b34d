import pytest
from pyspark.sql import functions as F

from wattframe.errors import ArgumentError
from wattframe.operators import itemsets as I
from wattframe.plans.rules import mine_rules
from workload.readings import READINGS


def as_sets(found):
    return {(tuple(r["items"]), r["n"]) for r in found.sets.collect()}


@pytest.mark.parametrize("support", [0.3, 0.1, 0.02])
def test_cube_equals_fp_growth(readings, support):
    cube = I.frequent_itemsets(readings, support, READINGS)
    growth = I.basket_itemsets(I.transactions(readings, READINGS).select("items"), support)
    assert as_sets(cube) == as_sets(growth)
    assert (cube.transactions, cube.items) == (growth.transactions, growth.items)


def test_a_count_on_the_threshold_counts_either_way(spark):
    rows = spark.createDataFrame([("x" if i < 7 else f"y{i % 4}", "k") for i in range(100)], "p string, q string")
    baskets = rows.select(F.array(F.concat(F.lit("p="), "p"), F.concat(F.lit("q="), "q")).alias("items"))
    assert (("p=x",), 7) in as_sets(I.basket_itemsets(baskets, 0.07))
    assert [I.minimum_count(100, s) for s in (0.07, 0.071, 0.001, 1.0)] == [7, 8, 1, 100]


def test_rules_have_item_sets_on_both_sides(readings):
    found = I.frequent_itemsets(readings, 0.05, READINGS)
    counts = {tuple(r["items"]): r["n"] for r in found.sets.collect()}
    rules = I.association_rules(found, 0.3).collect()
    assert any(len(r["consequent"]) > 1 for r in rules)
    expected = 0
    for items in counts:
        for mask in range(1, 2 ** len(items) - 1):
            left = tuple(x for i, x in enumerate(items) if mask >> i & 1)
            expected += counts[items] / counts[left] >= 0.3
    assert len(rules) == expected
    for r in rules:
        left, right = tuple(r["antecedent"]), tuple(r["consequent"])
        both = tuple(sorted(left + right))
        assert r["support"] == counts[both] / found.transactions
        assert r["confidence"] == counts[both] / counts[left]
        assert r["lift"] == pytest.approx(r["confidence"] / (counts[right] / found.transactions))


def test_shuffled_join_gives_the_same_rules(readings):
    found = I.frequent_itemsets(readings, 0.05, READINGS)
    unbounded = I.ItemSets(found.sets, found.transactions, found.items, small=False)
    key = lambda df: sorted((r["antecedent"], r["consequent"], r["lift"]) for r in df.collect())
    assert key(I.association_rules(found, 0.5)) == key(I.association_rules(unbounded, 0.5))


def test_nothing_reaches_the_support(spark, readings):
    split = readings.withColumn("building_type", F.col("reading_id").cast("string"))
    split = split.withColumns({c: F.col("reading_id").cast("string") for c in (
        "occupancy_level", "temperature_level", "energy_category")}).withColumn("is_weekend", F.lit(None).cast("int"))
    out = mine_rules(split, 0.9, 0.6, roles=READINGS)
    assert out["rules"].count() == 0 and out["chart"].count() == 0
    summary = out["summary"].first()
    assert (summary["frequent_itemsets"], summary["total_rules"]) == (0, 0)
    assert summary["transactions"] == readings.count()


def test_rare_values_are_folded_before_the_cube(spark):
    rows = spark.range(6000).select(
        F.concat(F.lit("t"), F.col("id")).alias("building_type"), F.when(F.col("id") % 3 > 0, "Low").alias("occupancy_level"),
        F.when(F.col("id") % 2 == 0, "High").otherwise(F.col("id").cast("string")).alias("temperature_level"),
        F.lit("Low").alias("energy_category"), (F.col("id") % 2).cast("int").alias("is_weekend"))
    found = I.frequent_itemsets(rows, 0.3)
    assert as_sets(found) == as_sets(I.basket_itemsets(I.transactions(rows).select("items"), 0.3))
    assert (found.transactions, found.items) == (6000, 6000 + 1 + 3001 + 1 + 2)
    # nothing reaches the support; a support of less than one row
    assert as_sets(I.frequent_itemsets(rows.select("*").withColumn("energy_category", F.lit(None).cast("string")), 0.9)) == set()
    few = rows.limit(3)
    assert as_sets(I.frequent_itemsets(few, 0.01)) == as_sets(I.basket_itemsets(I.transactions(few).select("items"), 0.01))
    empty = I.frequent_itemsets(rows.limit(0), 0.1)
    assert (as_sets(empty), empty.transactions, empty.items) == (set(), 0, 0)


def test_missing_values_are_no_items(spark):
    rows = [("Lab", None, "Low", "High", 0)] * 3 + [("Lab", "Low", "Low", "High", 1)]
    df = spark.createDataFrame(
        rows, "building_type string, occupancy_level string, temperature_level string, energy_category string, "
              "is_weekend int")
    items = {i for r in I.frequent_itemsets(df, 0.2).sets.collect() for i in r["items"]}
    assert items == {"building_type=Lab", "occupancy_level=Low", "temperature_level=Low", "energy_category=High",
                     "day_type=Weekday", "day_type=Weekend"}


def test_limit_and_order(readings):
    top = mine_rules(readings, 0.02, 0.1, limit=7, roles=READINGS)["rules"].orderBy("position").collect()
    assert [r["position"] for r in top] == list(range(1, 8))
    assert [r["lift"] for r in top] == sorted((r["lift"] for r in top), reverse=True)


@pytest.mark.parametrize("support, confidence", [(0, 0.5), (1.1, 0.5), (0.1, 0), (0.1, 1.01), (float("nan"), 0.5)])
def test_thresholds(support, confidence):
    with pytest.raises(ArgumentError):
        I.check_thresholds(support, confidence)


def test_baskets_of_a_task_are_bounded(spark, monkeypatch):
    seen = []

    class Watched(I.FPGrowth):
        def fit(self, baskets):
            seen.append(baskets.rdd.getNumPartitions())
            return super().fit(baskets)

    monkeypatch.setattr(I, "FPGrowth", Watched)
    monkeypatch.setattr(I, "PARTITION_BASKETS", 10)
    baskets = spark.range(0, 95, 1, 2).selectExpr("array('a', concat('b', id % 2)) AS items")
    sets = {tuple(r["items"]): r["n"] for r in I.basket_itemsets(baskets, 0.1).sets.collect()}
    assert seen == [10]
    assert sets == {("a",): 95, ("b0",): 48, ("b1",): 47, ("a", "b0"): 48, ("a", "b1"): 47}
