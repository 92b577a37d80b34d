"""Hourly rollup of arriving readings with late and repeated data bounded by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from wattframe.functions.times import utc_instant, utc_wall_time
from wattframe.roles import METERED, Roles


def hourly_rollup(arriving: DataFrame, roles: Roles = METERED, lateness: str = "1 hour",
                  group: Sequence[str] = ()) -> DataFrame:
    """(hour_start, group…, records, total_energy, avg_energy) per event hour, as the readings' clocks show it.

    A reading that arrives again within `lateness` counts once; one that arrives later is dropped. State is
    bounded by the watermark, and a busy group is combined before the shuffle. The same function runs on a
    batch, where it gives all hours.
    """
    stamp = F.col(roles.timestamp)
    has_zone = dict(arriving.dtypes)[roles.timestamp] == "timestamp"
    # watermarks need an instant
    stamped = arriving.withColumn("event_time", stamp if has_zone else utc_instant(stamp.cast("timestamp_ntz")))
    if arriving.isStreaming:
        stamped = stamped.withWatermark("event_time", lateness)
        if roles.key:
            stamped = stamped.dropDuplicatesWithinWatermark(list(roles.key))
    elif roles.key:
        stamped = stamped.dropDuplicates(list(roles.key))
    rolled = stamped.groupBy(F.window("event_time", "1 hour"), *group).agg(
        F.count(F.lit(1)).alias("records"), F.sum(roles.measure).alias("total_energy"),
        F.avg(roles.measure).alias("avg_energy"))
    start = F.col("window.start")
    hour = start if has_zone else utc_wall_time(start)
    return rolled.select(hour.alias("hour_start"), *group, "records", "total_energy", "avg_energy")


def upsert_rollup(rolled: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """All hours, open ones too: each micro-batch writes the hours it has changed, as they stand, under its number.

    A batch that is run again after a failure replaces its own files. `read_rollup` keeps the newest state of each
    hour, so the last hours show without waiting for a watermark to pass them.
    """

    def write_batch(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = rolled.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_rollup(spark: SparkSession, path: str, schema: StructType, group: Sequence[str] = ()) -> DataFrame:
    """The newest state of every hour (and group) that `upsert_rollup` has written."""
    written = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    values = [name for name in schema.names if name not in ("hour_start", *group)]
    newest = written.groupBy("hour_start", *group).agg(F.max_by(F.struct(*values), "batch").alias("_newest"))
    return newest.select(*[F.col(f"_newest.{c}").alias(c) if c in values else F.col(c) for c in schema.names])


def compact_rollup(spark: SparkSession, path: str, target: str, schema: StructType, group: Sequence[str] = ()) -> None:
    """The newest states as one table of batch -1 in another folder, for a stream that has written many batches.
    Batches that come later are written there and win."""
    read_rollup(spark, path, schema, group).write.mode("overwrite").parquet(f"{target}/batch=-1")


def write_rollup(rolled: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Closed hours as parquet, each exactly once (the file sink commits by batch)."""
    writer = rolled.writeStream.outputMode("append").format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
