"""Value ranges: per feature, per level, and the level nearest to a value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.numbers import half_up
from wattframe.operators.lookups import is_small, look_up, numbered
from wattframe.operators.order_stats import quantiles
from wattframe.roles import METERED, Roles
from wattframe.session import materialize

#: Ends of intervals that one value is compared with.
BUCKET = 64


def level_intervals(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """(attribute, level, low, high): range of the source value of each level, all attributes in one pass."""
    pairs = [
        F.struct(F.lit(level).alias("attribute"), F.col(level).alias("level"), F.col(source).cast("double").alias("v"))
        for level, source in roles.level_sources
    ]
    return (
        df.select(F.inline(F.array(*pairs))).where(F.col("level").isNotNull())
        .groupBy("attribute", "level").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    )


@dataclass(frozen=True)
class NearestLevel:
    """Which level is nearest to a value, as a stored table of the stretches between interval ends.

    `rows` has (bucket, point, next_point, at, between, left, right): the level at an end, the level that covers the
    stretch up to the next end, or else the levels that end on its left and begin on its right. Stretches are dealt
    into buckets of about `BUCKET` ends; where ends crowd, buckets are narrow. `splits` are the borders.
    """

    rows: DataFrame
    splits: list[float]
    small: bool

    def of(self, df: DataFrame, value: Column, output: str) -> DataFrame:
        """Adds the name of the nearest level (distance 0 inside its interval), the first by name on ties.

        Null and NaN have none. An infinite value belongs to the outermost interval on its side.
        """
        names = [F.col(f"`{c}`") for c in df.columns]
        bucketed = df.withColumns({"_value": value.cast("double"), "_bucket": F.lit(0.0)})
        if len(self.splits) > 2:
            bucketizer = Bucketizer(splits=self.splits, inputCol="_value", outputCol="_bucket", handleInvalid="keep")
            bucketed = bucketizer.transform(bucketed.drop("_bucket"))
        key = F.when(~F.isnan("_value"), F.col("_bucket").cast("int"))
        found = look_up(bucketed, self.rows, key, "bucket", F.xxhash64("_value", *names), self.small)
        v = F.col("_value")
        # ends of a bucket are in order, so the last one not above the value is the largest such
        at = F.array_max(F.filter("ends", lambda e: e["point"] <= v))
        gap = F.array_min(F.array(
            F.when(at["left"].isNotNull(), F.struct((v - at["point"]).alias("d"), at["left"].alias("level"))),
            F.when(at["right"].isNotNull(), F.struct((at["next_point"] - v).alias("d"), at["right"].alias("level")))))["level"]
        level = F.when((at["point"] == v) & at["at"].isNotNull(), at["at"]).otherwise(F.coalesce(at["between"], gap))
        return found.withColumn("_level", F.when(v.isNotNull(), level)).select(*names, F.col("_level").alias(output))


def nearest_level_table(intervals: DataFrame) -> NearestLevel:
    """The table for (level, low, high), any number of levels; those without an interval are never nearest.

    The ends are numbered in order; a level covers a range of places on the line of ends and gaps. Each range is cut
    into at most two dyadic pieces per size, the first name per piece is kept, and a place looks up the pieces that
    hold it: n log n rows however the intervals overlap, where joining levels to places could give n squared.

    All sides of the joins grow with the levels. They are merged: files of a few MB hold millions of ends, whose
    broadcast would have to fit the driver.
    """
    levels = materialize(intervals.where(F.col("low").isNotNull() & F.col("high").isNotNull()).select(
        "level", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")), "levels")
    ends = levels.select(F.explode(F.array("low", "high")).alias("point"))
    number = numbered(ends, "point")
    count = number.count()
    sizes = range(max(2 * count, 1).bit_length() + 1)
    # the end of number i is place 2i, the gap behind it 2i + 1
    low, high = (number.select(F.col("point").alias(c), (2 * F.col("number")).alias(f"{c}_place")) for c in ("low", "high"))
    ranges = levels.join(low.hint("merge"), "low").join(high.hint("merge"), "high")

    cuts = []
    for k in sizes:
        first = F.shiftright(F.col("low_place") + ((1 << k) - 1), k)
        behind = F.shiftright(F.col("high_place") + 1, k)
        cuts.append(F.when((first % 2 == 1) & (first < behind), F.struct(F.lit(k).alias("size"), first.alias("piece"))))
        cuts.append(F.when((behind % 2 == 1) & (first < behind), F.struct(F.lit(k).alias("size"), (behind - 1).alias("piece"))))
    covers = ranges.select("level", F.inline(F.array_compact(F.array(*cuts)))).groupBy("size", "piece").agg(F.min("level").alias("level"))
    places = number.select(F.explode(F.array(2 * F.col("number"), 2 * F.col("number") + 1)).alias("place"))
    holding = places.select("place", F.inline(F.array(*[
        F.struct(F.lit(k).alias("size"), F.shiftright("place", k).alias("piece")) for k in sizes])))
    covered = holding.join(covers.hint("merge"), ["size", "piece"]).groupBy("place").agg(F.min("level").alias("level"))
    at = covered.where(F.col("place") % 2 == 0).select((F.col("place") / 2).cast("bigint").alias("number"), F.col("level").alias("at"))
    between = covered.where(F.col("place") % 2 == 1).select(
        F.shiftright("place", 1).alias("number"), F.col("level").alias("between"))
    ending = levels.groupBy(F.col("high").alias("point")).agg(F.min("level").alias("left"))
    beginning = levels.groupBy(F.col("low").alias("point")).agg(F.min("level").alias("right"))
    begun = number.join(beginning.hint("merge"), "point", "left")
    # one more stretch comes before the first end
    before = begun.sparkSession.range(1).select(F.lit(float("-inf")).alias("point"), F.lit(-1).cast("bigint").alias("number"))
    following = begun.select((F.col("number") - 1).alias("number"), F.col("point").alias("next_point"), "right")
    stretches = (
        number.select("point", "number").unionByName(before).join(following.hint("merge"), "number", "left")
        .join(ending.hint("merge"), "point", "left").join(at.hint("merge"), "number", "left")
        .join(between.hint("merge"), "number", "left"))
    bucket = F.floor((F.col("number") + 1) / BUCKET).cast("int")
    end = F.struct("point", "next_point", "at", "between", "left", "right")
    rows = stretches.groupBy(bucket.alias("bucket")).agg(F.array_sort(F.collect_list(end)).alias("ends"))
    rows = materialize(rows, "nearest")
    # one border per bucket of ends
    borders = sorted(r["b"] for r in rows.where("bucket > 0").select(F.col("ends")[0]["point"].alias("b")).collect())
    return NearestLevel(rows, [float("-inf"), *borders, float("inf")], is_small(rows))


def with_nearest_level(df: DataFrame, value: Column, intervals: DataFrame, output: str) -> DataFrame:
    """Adds the nearest level of (level, low, high). Up to `BUCKET` levels are compared one by one, more are looked
    up in their table; the result is the same."""
    intervals = intervals.where(F.col("low").isNotNull() & F.col("high").isNotNull()).select("level", "low", "high")
    few = sorted(intervals.limit(BUCKET + 1).collect())
    if len(few) > BUCKET:
        return nearest_level_table(intervals).of(df, value, output)
    value = F.when(~F.isnan(value), value).cast("double")
    ranked = [F.struct(F.greatest(F.lit(float(low)) - value, value - F.lit(float(high)), F.lit(0.0)).alias("distance"),
                       F.lit(name).alias("level")) for name, low, high in few]
    nearest = F.array_min(F.array(*ranked))["level"] if ranked else F.lit(None).cast("string")
    return df.withColumn(output, F.when(value.isNotNull(), nearest))


def feature_ranges(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, low, high, mean, slider_low, slider_high) from one aggregation."""
    row = df.agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in features
                   for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))])
    return row.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.col(f"{c}_lo").alias("low"), F.col(f"{c}_hi").alias("high"),
            half_up(F.col(f"{c}_mean"), 1).alias("mean"),
            F.floor(f"{c}_lo").cast("bigint").alias("slider_low"), F.ceil(f"{c}_hi").cast("bigint").alias("slider_high"),
        ) for c in features
    ])))


def floor_area_defaults(df: DataFrame, roles: Roles = METERED) -> DataFrame:
    """(entity type, floor area): the median per type, used where a new record has none."""
    return quantiles(df, roles.entity_type, roles.floor_area, 0.5, roles.floor_area)


def with_floor_area(df: DataFrame, defaults: DataFrame, roles: Roles = METERED) -> DataFrame:
    """Fills a missing floor area by type. The defaults say themselves whether they may be broadcast."""
    filled = defaults.withColumnRenamed(roles.floor_area, "_default_area")
    return (
        df.join(filled, roles.entity_type, "left")
        .withColumn(roles.floor_area, F.coalesce(roles.floor_area, "_default_area"))
        .drop("_default_area")
    )
