"""Lookup tables of any size: stored, numbered, and joined without a hot key or an unchecked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.session import materialize, stored_bytes

#: A stored table of at most this many bytes is sent to all tasks.
MAX_BROADCAST_BYTES = 8 << 20
#: Above that, a row of the table is copied this often, so that a hot key is met in as many tasks.
SALTS = 16


def is_small(table: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    return stored_bytes(table) <= max_bytes


def look_up(rows: DataFrame, table: DataFrame, key: Column, table_key: str, salt: Column, small: bool) -> DataFrame:
    """The rows with the other columns of `table`, null where `key` is null or unknown.

    `table_key` must be unique, its name and those of the other columns new to the rows. A small table is broadcast;
    with any other, rows of one key are dealt to `SALTS` tasks by `salt`, a number that varies among them.
    """
    if small:
        return rows.join(F.broadcast(table), key == F.col(table_key), "left").drop(table_key)
    copies = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    return dealt.join(copies.hint("merge"), (key == F.col(table_key)) & (F.col("_salt") == F.col("_copy")), "left").drop(table_key, "_copy", "_salt")


def numbered(values: DataFrame, column: str, number: str = "number") -> DataFrame:
    """Distinct values with their places 0, 1, 2 .. in sorted order, stored.

    Values are dealt into ranges and sorted; a place is the number of values in earlier ranges plus the place within
    its own. Only the counts per range meet in one task.
    """
    ranged = values.select(column).distinct().repartitionByRange(F.col(column)).sortWithinPartitions(column)
    # the id holds the number of the partition above 33 bits and the place within it below
    placed = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # the window sees one row per range
    before = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_size")
    starts = sizes.select("_part", before.alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)
    return materialize(placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(column, place.alias(number)), "numbers")
