"""Train and test sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.operators.order_stats import order_statistics, small_side

_STEPS = 1 << 30


def row_hash(key: Sequence[str], seed: int = 42) -> Column:
    """A number that depends on the key and the seed only: same side on every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(_STEPS))


def split_random(df: DataFrame, key: Sequence[str], fraction: float = 0.2, seed: int = 42,
                 is_test: Column | None = None) -> DataFrame:
    """Adds `side` ('test' or 'train'). Decided row by row, without a shuffle."""
    chosen = row_hash(key, seed) < F.lit(int(fraction * _STEPS)) if is_test is None else is_test
    return df.withColumn("side", F.when(chosen, "test").otherwise("train"))


def split_stratified(df: DataFrame, key: Sequence[str], label: str, fraction: float = 0.2, seed: int = 42,
                     order: Column | None = None) -> DataFrame:
    """Adds `side`: in each class the rows with the smallest hash, `fraction` of the class, are the test side.

    The cut of each class is an exact order statistic; rows are then compared with it. A null label is a class.
    """
    position = row_hash(key, seed) if order is None else order
    hashed = df.select(F.col(label).alias("label"), position.cast("double").alias("position"))
    cuts = order_statistics(hashed, "label", "position", lambda n: [F.greatest(F.lit(1), F.bround(n * fraction))])
    cuts = small_side(cuts.select(F.col("g").alias("_label"), F.col("v")[0].alias("_cut")), "split-cuts")
    side = F.when(position.cast("double") <= F.col("_cut"), "test").otherwise("train")
    joined = df.join(cuts, F.col(label).eqNullSafe(F.col("_label")), "left")
    return joined.withColumn("side", side).drop("_label", "_cut")


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("side").agg(F.count(F.lit(1)).alias("records"))
