"""Comparing predictions with what happened."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.bins import equal_width_bin
from wattframe.functions.labels import hour_label
from wattframe.functions.numbers import half_up, ratio_or_zero
from wattframe.operators.splitting import row_hash
from wattframe.roles import METERED, Roles


def accuracy(df: DataFrame, actual: str, predicted: str, side: str = "side") -> DataFrame:
    """(side, records, accuracy) for the train and the test side at once."""
    hit = F.when(F.col(actual) == F.col(predicted), 1.0).otherwise(0.0)
    return df.groupBy(F.col(side).alias("side")).agg(F.count(F.lit(1)).alias("records"), F.avg(hit).alias("accuracy"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """(actual, predicted, n) for every pair of classes, pairs that never occur with 0."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    labels = F.array(*[F.lit(c) for c in classes])
    zeros = (
        df.sparkSession.range(1)
        .select(F.explode(labels).alias("actual"))
        .select("actual", F.explode(labels).alias("predicted"), F.lit(0).cast("bigint").alias("n"))
    )
    known = counts.where(F.col("actual").isin(*classes) & F.col("predicted").isin(*classes))
    return known.unionAll(zeros).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def per_class_scores(df: DataFrame, actual: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """(class, precision, recall, f1, support); a class never predicted has precision 0."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    both = counts.select(F.inline(F.array(
        F.struct(F.col("actual").alias("class"), hit.alias("hits"), F.col("n").alias("support"), zero.alias("said")),
        F.struct(F.col("predicted").alias("class"), zero.alias("hits"), zero.alias("support"),
                 F.col("n").alias("said")),
    )))
    every = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"),
        zero.alias("hits"), zero.alias("support"), zero.alias("said"))
    sums = both.unionAll(every).where(F.col("class").isin(*classes)).groupBy("class").agg(
        F.sum("hits").alias("hits"), F.sum("support").alias("support"), F.sum("said").alias("said"))
    return sums.select(
        "class",
        ratio_or_zero(F.col("hits"), F.col("said")).alias("precision"),
        ratio_or_zero(F.col("hits"), F.col("support")).alias("recall"),
        ratio_or_zero(2 * F.col("hits"), F.col("said") + F.col("support")).alias("f1"),
        "support",
    )


def weighted_scores(per_class: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 averaged over the classes, weighted by support."""
    return per_class.agg(*[
        ratio_or_zero(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m)
        for m in ("precision", "recall", "f1")
    ])


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: records, MAE, RMSE, R2. R2 of a constant target is 1 if met exactly, else 0."""
    error = F.col(actual) - F.col(predicted)
    mse, variance = F.avg(error * error), F.var_pop(actual)
    r2 = F.when(variance == 0, F.when(mse == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(mse, variance))
    return df.agg(
        F.count(F.lit(1)).alias("records"), F.avg(F.abs(error)).alias("mae"),
        F.sqrt(mse).alias("rmse"), r2.alias("r2"),
    )


def residual_histogram(df: DataFrame, residual: str = "residual", bins: int = 20) -> DataFrame:
    """(bin, midpoint, label, n): equal bins over the range, the last one closed, empty bins with 0."""
    ends = df.agg(F.min(residual).alias("low"), F.max(residual).alias("high")).first()
    low, high = ends["low"], ends["high"]
    if low is None:
        low, high = 0.0, 1.0
    elif low == high:
        low, high = low - 0.5, high + 0.5
    number = equal_width_bin(F.col(residual), F.lit(low), F.lit(high), bins)
    counts = df.where(F.col(residual).isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    empty = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("bigint"))
    midpoint = F.lit(low) + (F.col("bin") - 0.5) * F.lit((high - low) / bins)
    return counts.unionAll(empty).groupBy("bin").agg(F.sum("n").alias("n")).select(
        "bin", midpoint.alias("midpoint"), F.format_string("%.1f", midpoint).alias("label"), "n")


def hourly_actual_predicted(df: DataFrame, actual: str, predicted: str, roles: Roles = METERED) -> DataFrame:
    return df.groupBy(F.col(roles.hour).alias("hour")).agg(
        half_up(F.avg(actual), 2).alias("actual"), half_up(F.avg(predicted), 2).alias("predicted"),
    ).select("hour", hour_label(F.col("hour")).alias("label"), "actual", "predicted")


def sample_rows(df: DataFrame, key: Sequence[str], rows: int, seed: int = 42, order: Column | None = None) -> DataFrame:
    """`rows` rows without replacement: those with the smallest hash. Repeatable; each task keeps at most `rows`."""
    position = row_hash(key, seed) if order is None else order
    return df.orderBy(position, *key).limit(rows)


def scatter_sample(df: DataFrame, actual: str, predicted: str, key: Sequence[str], rows: int = 500, seed: int = 42,
                   order: Column | None = None) -> DataFrame:
    chosen = sample_rows(df, key, rows, seed, order)
    return chosen.select(*key, half_up(F.col(actual), 2).alias("actual"), half_up(F.col(predicted), 2).alias("predicted"))


def identity_bounds(points: DataFrame) -> DataFrame:
    """One row: both ends of the line on which prediction and actual value agree."""
    return points.agg(
        F.least(F.min("actual"), F.min("predicted")).alias("low"),
        F.greatest(F.max("actual"), F.max("predicted")).alias("high"),
    )
