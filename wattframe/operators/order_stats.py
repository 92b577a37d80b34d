"""Exact order statistics (median, quantiles, k-th smallest), the same way for any number of groups and rows.

Equal values are counted first. The counts are sorted by group and value into ranges of about equal size, so that a
large group spans many ranges. Sums per group and range tell which range holds a wanted rank, and only inside that
range are counts run up. So no group has to fit a task, the number of passes does not depend on the values, and
nothing but the result's own rows is ever needed on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions.numbers import nan_to_null
from wattframe.session import materialize, stored_bytes

MAX_BROADCAST_GROUPS = 100_000
#: Counts of at most this many stored bytes are sorted by group in one step instead of in ranges.
MAX_SORTED_BYTES = 8 << 20


def order_statistics(rows: DataFrame, group: str, value: str, ranks: Callable[[Column], Sequence[Column] | Column]) -> DataFrame:
    """(g, n, v): per group the number of values and, as an array, the values at the 1-based `ranks(n)`, which are
    columns or one array column.

    Nulls and NaN are no values; a group without any value is left out. Infinities are the ends of the order. Null
    is a group of its own.
    """
    kept = rows.select(F.col(group).alias("g"), nan_to_null(F.col(value).cast("double")).alias("v")).where("v is not null")
    counts = materialize(kept.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    if stored_bytes(counts) <= MAX_SORTED_BYTES:
        return _from_few_counts(counts, ranks)
    placed = counts.repartitionByRange("g", "v").withColumn("range", F.spark_partition_id())
    placed = materialize(placed, "value-ranges")  # written, so that the range of a row is settled
    sums = placed.groupBy("g", "range").agg(F.sum("n").alias("here"))
    ranges = Window.partitionBy("g").orderBy("range")
    sums = sums.select(
        F.col("g").alias("_g"), F.col("range").alias("_range"), "here",
        (F.sum("here").over(ranges) - F.col("here")).alias("below"),
        F.sum("here").over(Window.partitionBy("g")).alias("total"))
    wanted = sums.select("*", F.posexplode(_rank_array(ranks(F.col("total")))).alias("place", "rank"))
    wanted = wanted.where((F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("here")))
    running = F.sum("n").over(Window.partitionBy("g", "range").orderBy("v"))
    # only ranges that hold a wanted rank are run up
    held = wanted.select("_g", "_range").distinct()
    chosen = placed.join(F.broadcast(held) if _few(held) else held, _same_range(), "left_semi")
    ends = chosen.select("g", "range", "v", "n", running.alias("end"))
    found = ends.join(wanted, _same_range()).where(
        (F.col("rank") <= F.col("below") + F.col("end")) & (F.col("rank") > F.col("below") + F.col("end") - F.col("n")))
    return found.groupBy("g").agg(
        F.first("total").alias("n"), F.array_sort(F.collect_list(F.struct("place", "v"))).alias("at")
    ).select("g", "n", F.col("at.v").alias("v"))


def _rank_array(ranks: Sequence[Column] | Column) -> Column:
    return (ranks if isinstance(ranks, Column) else F.array(*ranks)).cast("array<bigint>")


def _from_few_counts(counts: DataFrame, ranks: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """The same where even the counts of all groups together fit a task: they are run up in one window."""
    group = Window.partitionBy("g")
    ends = counts.select("g", "v", "n", F.sum("n").over(group.orderBy("v")).alias("end"), F.sum("n").over(group).alias("total"))
    wanted = _rank_array(ranks(F.col("total")))
    numbered = F.transform(wanted, lambda rank, place: F.struct(place.alias("place"), rank.alias("rank")))
    held = F.filter(numbered, lambda x: (x["rank"] <= F.col("end")) & (x["rank"] > F.col("end") - F.col("n")))
    found = ends.select("g", "total", "v", F.explode(F.transform(held, lambda x: x["place"])).alias("place"))
    return found.groupBy("g").agg(
        F.first("total").alias("n"), F.array_sort(F.collect_list(F.struct("place", "v"))).alias("at")
    ).select("g", "n", F.col("at.v").alias("v"))


def _same_range() -> Column:
    return F.col("g").eqNullSafe(F.col("_g")) & (F.col("range") == F.col("_range"))


def _few(side: DataFrame) -> bool:
    return side.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS


def small_side(side: DataFrame, label: str) -> DataFrame:
    """The frame, written, with a broadcast hint if it has few rows; a join gives the same without it."""
    side = materialize(side, label)
    return F.broadcast(side) if _few(side) else side


def quantiles(rows: DataFrame, group: str, value: str, fraction: float = 0.5, output: str = "quantile") -> DataFrame:
    """Quantile per group, interpolated between the two neighbouring ranks; nulls and NaN do not count.

    Between a finite value and an infinite one it is infinite, between the two infinities it is null.
    """
    at = lambda n: (n - 1) * F.lit(float(fraction))
    found = order_statistics(rows, group, value, lambda n: (F.floor(at(n)) + 1, F.ceil(at(n)) + 1))
    low, high = F.col("v")[0], F.col("v")[1]
    weight = at(F.col("n")) - F.floor(at(F.col("n")))
    between = F.when((low == high) | (weight == 0), low).otherwise(nan_to_null(low + (high - low) * weight))
    return small_side(found.select(F.col("g").alias(group), between.alias(output)), "quantiles")


def most_frequent(rows: DataFrame, group: str, value: str, output: str = "mode") -> DataFrame:
    """Most frequent non-null value per group, the smallest one on ties.

    Counted by value first, so that a frequent value is one partial count per task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(group).agg(F.min(F.struct(-F.col("_n"), F.col(value).alias("_v")))["_v"].alias(output))


def long_form(df: DataFrame, columns: Sequence[str], kind: str, name: str = "column", value: str = "value",
              ) -> DataFrame:
    """One row per (column, value); nulls left out."""
    pairs: list[Column] = [F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in columns]
    return df.select(F.inline(F.array(*pairs))).where(F.col(value).isNotNull())
