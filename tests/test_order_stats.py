import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.functions.numbers import half_up
from wattframe.operators import order_stats as O
from wattframe.operators.splitting import split_stratified
from wattframe.sources.store import fingerprint


def frame(spark, groups):
    rows = [(g, v) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double")


def medians(df):
    return {r["g"]: r["quantile"] for r in O.quantiles(df, "g", "v").collect()}


CASES = {
    "even count": [1.0, 2.0, 3.0, 10.0],
    "odd count": [5.0, 1.0, 3.0],
    "one value": [7.5],
    "constant": [2.0] * 9,
    "hot value": [1.0] * 400 + [float(i) for i in range(800)],
    "outlier": [1e300, *[float(i) / 7 for i in range(501)]],
    "both ends": [-1.7e308, 1.7e308, 1.0, 2.0],
    "two far middles": [0.0, 0.0, 1e9, 1e9],
    "neighbouring doubles": [1.0, float(np.nextafter(1.0, 2.0)), float(np.nextafter(1.0, 2.0)), 1.0],
    "tiny": [5e-324, 1e-323, 0.0, 0.0, 1e-323],
    "negative": [-3.0, -2.0, -1.0, -0.0],
}


def test_medians_are_exact(spark):
    rng = random.Random(7)
    cases = dict(CASES, random=[rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(3001)])
    got = medians(frame(spark, cases))
    for name, values in cases.items():
        ordered = sorted(values)
        low, high = ordered[(len(values) - 1) // 2], ordered[len(values) // 2]
        assert got[name] == low + (high - low) * (0.0 if len(values) % 2 else 0.5), name


def test_many_groups(spark):
    got = medians(spark.range(20_000).select((F.col("id") % 5000).cast("string").alias("g"), F.col("id").cast("double").alias("v")))
    assert got == {str(i): i + 7500.0 for i in range(5000)}


def test_groups_larger_than_a_range(spark):
    df = spark.range(30_001).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    assert medians(df.unionAll(df.limit(1).select(F.lit("b"), F.col("v")))) == {"a": 15_000.0, "b": 0.0}


def test_infinity_nan_and_null_groups(spark):
    inf, nan = float("inf"), float("nan")
    got = medians(frame(spark, {"up": [1.0, 2.0, inf], "ends": [-inf, inf], "edge": [1.0, inf], "nan": [nan, 3.0, nan, 5.0],
                                None: [4.0, None, 6.0], "only": [nan], "same": [inf, inf]}))
    assert got == {"up": 2.0, "ends": None, "edge": inf, "nan": 4.0, None: 5.0, "same": inf}


def test_log_spaced_values(spark):
    assert medians(frame(spark, {"a": [10.0 ** (i - 150) for i in range(301)]}))["a"] == 1.0


def test_split_with_a_null_label(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("label"))
    rows = split_stratified(df, ["id"], "label").groupBy("label", "side").count().collect()
    assert {(r["label"], r["side"]): r["count"] for r in rows} == {
        (None, "test"): 67, (None, "train"): 267, (1, "test"): 67, (1, "train"): 266, (2, "test"): 67, (2, "train"): 266}


@pytest.mark.parametrize("partitions", [1, 4, 8])
def test_same_result_for_any_partitioning(spark, partitions):
    df = spark.range(5000).select(
        F.lit("a").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 3).alias("v")).repartition(partitions)
    values = [r["v"] for r in df.collect()]
    assert medians(df)["a"] == pytest.approx(statistics.median(values), abs=0)


def test_quartile_matches_numpy(spark):
    values = [float(v) for v in np.random.default_rng(3).normal(size=997)]
    row = O.quantiles(frame(spark, {"a": values}), "g", "v", 0.25).first()
    assert row["quantile"] == pytest.approx(np.quantile(values, 0.25), rel=1e-12)


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("c", x) for x in ["b", "a", "b", "a", None, None, None]], "g string, v string")
    assert O.most_frequent(df, "g", "v").first()["mode"] == "a"


def test_no_rows(spark):
    assert medians(frame(spark, {"a": [None]})) == {}


def test_rounding_of_large_values(spark):
    rows = spark.createDataFrame([(1e18, 2), (2e14, 6), (-1e18, 2), (2.345, 2), (-2.5, 0)], "x double, d int")
    got = rows.select(*[half_up(F.col("x"), d).alias(f"d{d}") for d in (0, 2, 6)]).collect()
    assert [got[0]["d2"], got[1]["d6"], got[2]["d2"], got[3]["d2"], got[4]["d0"]] == [1e18, 2e14, -1e18, 2.35, -3.0]


def test_fingerprint_sum_is_wider_than_64_bits(spark):
    kind = fingerprint(spark.range(3)).schema["sum_hash"].dataType.simpleString()
    assert kind == "decimal(38,0)"
