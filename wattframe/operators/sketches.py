"""Approximate order statistics and distinct counts from sketches that are kept per part of a table and merged.

A sketch has a bounded size whatever the rows it stands for. A table that grows part by part (a month, an import)
gets its sketches once per part; quantiles and distinct counts of any set of parts then come from merging a few
rows, without reading the table. The exact operators are in `order_stats` and `series`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.numbers import nan_to_null
from wattframe.roles import METERED, Roles

#: Size of a quantile sketch: the rank of a returned value is off by less than 1 % of the rows (99 % of the time).
QUANTILE_SIZE = 400
#: Logarithm of the cells of a distinct-count sketch: a standard error of about 1.6 %; counts below some thousands are exact or nearly so.
DISTINCT_BITS = 12


def part_sketches(df: DataFrame, part: str, numbers: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    """(part, column, n, quantiles, distinct): one row per part and column, from one aggregation.

    Sketches are built task by task before anything is shuffled, so a large part is no hot group. Nulls and NaN are
    not counted; a column without a value has n = 0 and no quantiles.
    """
    aggregates = []
    for c in (*numbers, *texts):
        value = nan_to_null(F.col(c).cast("double")) if c in numbers else F.col(c).cast("string")
        aggregates += [F.count(value).alias(f"{c}.n"), F.hll_sketch_agg(value.cast("string"), DISTINCT_BITS).alias(f"{c}.d")]
        if c in numbers:
            aggregates.append(F.kll_sketch_agg_double(value, QUANTILE_SIZE).alias(f"{c}.q"))
    wide = df.groupBy(F.col(part).cast("string").alias("part")).agg(*aggregates)
    rows = [F.struct(
        F.lit(c).alias("column"), F.col(f"`{c}.n`").alias("n"),
        (F.when(F.col(f"`{c}.n`") > 0, F.col(f"`{c}.q`")) if c in numbers else F.lit(None).cast("binary")).alias("quantiles"),
        F.col(f"`{c}.d`").alias("distinct")) for c in (*numbers, *texts)]
    return wide.select("part", F.inline(F.array(*rows)))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """(column, n, quantiles, distinct) of all the given parts together."""
    return sketches.groupBy("column").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def approximate_quantile(quantiles: Column, fraction: float) -> Column:
    """A value whose rank is near `fraction`; null without values."""
    return F.when(F.kll_sketch_get_n_double(quantiles) > 0, F.kll_sketch_get_quantile_double(quantiles, F.lit(float(fraction))))


def approximate_stats(sketches: DataFrame, fractions: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, n, distinct_values, q25, q50, ..) from the merged sketches."""
    merged = merged_sketches(sketches)
    columns = {f"q{round(100 * f)}": F.when(F.col("quantiles").isNotNull(), approximate_quantile(F.col("quantiles"), f)) for f in fractions}
    return merged.select("column", "n", F.hll_sketch_estimate("distinct").alias("distinct_values"), *[v.alias(k) for k, v in columns.items()])


def approximate_medians(sketches: DataFrame) -> dict[str, float]:
    """Fill values for `cleaning.fill_gaps`, one number per column that has any."""
    rows = approximate_stats(sketches, (0.5,)).where("q50 IS NOT NULL").collect()
    return {row["column"]: row["q50"] for row in rows}


def default_sketches(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """Sketches per month of the measured columns and the entity."""
    numbers = [c for c in roles.cluster_numeric if c in df.columns]
    return part_sketches(df, roles.month, numbers, (roles.entity,))
