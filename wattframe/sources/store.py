"""Stored tables: replace, scan, and an import that is skipped when nothing changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wattframe.session import materialize


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes when any value, row, column or type changes, and not with row order or partitioning.

    A null leaves a hash as it is, so each value comes with a flag. `xor_hash` alone would cancel out a row that
    occurs twice; `sum_hash` and `row_count` notice that.
    """
    header = F.lit(",".join(f"{name}:{kind}" for name, kind in df.dtypes))
    values = [x for c in df.columns for x in (F.col(c), F.col(c).isNull())]
    return df.select(F.xxhash64(header, *values).alias("h")).agg(
        F.count(F.lit(1)).alias("row_count"),
        # a 64-bit sum would overflow at some billions of rows
        F.coalesce(F.sum(F.pmod("h", F.lit(2147483648)).cast("decimal(28,0)")), F.lit(0)).alias("sum_hash"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor_hash"),
    )


def signature(df: DataFrame) -> str:
    row = fingerprint(df).first()
    return f"{row['row_count']}-{row['sum_hash']}-{row['xor_hash']}"


def write_table(df: DataFrame, path: str, sort_by: Sequence[str] = (), partition_by: Sequence[str] = ()) -> None:
    """Replace the table.

    A filter on a `partition_by` column (few values, such as the month) reads only its folders; rows sorted
    within each file let a filter on a `sort_by` column skip row groups by their min/max.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)  # else every task writes a file into every folder
    if sort_by or partition_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


@dataclass(frozen=True)
class ImportStatus:
    imported: bool
    rows: int


def _stamp_path(path: str) -> str:
    return f"{path.rstrip('/')}.stamp"


def _stored_stamp(spark: SparkSession, path: str) -> str | None:
    if not (table_exists(spark, path) and table_exists(spark, _stamp_path(path))):
        return None
    row = spark.read.parquet(_stamp_path(path)).first()
    return row["signature"] if row else None


def _write_stamp(spark: SparkSession, path: str, text: str) -> None:
    write_table(spark.createDataFrame([(text,)], "signature string"), _stamp_path(path))


def ingest(
    spark: SparkSession,
    source: Callable[[], DataFrame],
    path: str,
    sort_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> ImportStatus:
    """Write the source once; a later call writes again only when the source's fingerprint has changed.

    A comparison of row counts would keep a stale table when values change but the count does not. The
    fingerprint is kept in a stamp beside the table, so that the table itself is not read. The stamp is cleared
    first and written last: an import that dies half way is done again.
    """
    rows = source()
    wanted = fingerprint(rows).first()
    text = "-".join(str(v) for v in wanted)
    if _stored_stamp(spark, path) == text:
        return ImportStatus(False, wanted["row_count"])
    _write_stamp(spark, path, "")
    write_table(rows, path, sort_by, partition_by)
    _write_stamp(spark, path, text)
    return ImportStatus(True, wanted["row_count"])


@dataclass(frozen=True)
class PartStatus:
    written: int
    removed: int
    kept: int
    rows: int


MANIFEST = "version long, part string, data_version long, row_count long, sum_hash decimal(38,0), xor_hash long"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """(part, data_version, its fingerprint) of the newest import that was published."""
    if not table_exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST).drop("version")
    published = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    newest = published.agg(F.max("version").alias("version"))
    # one row on the right
    return published.join(F.broadcast(newest), "version").drop("version").where("data_version > 0")


def ingest_parts(
    spark: SparkSession, source: Callable[[], DataFrame], path: str, part: str, sort_by: Sequence[str] = (),
) -> PartStatus:
    """Import a table part by part (one part per value of `part`, null is one): only parts that differ are written.

    The source is read once, into the shared scratch folder. Fingerprints of its parts are compared with those in
    the manifest of the last import; changed and new parts are written below a new version, and a new manifest names
    for each part the version that holds it. The manifest is one file and comes last: until then, and after an import
    that died, readers see the old table whole. Files of replaced parts stay until the folder is cleared.
    """
    staged = materialize(source(), "staged")
    header = F.lit(",".join(f"{name}:{kind}" for name, kind in staged.dtypes))
    values = [x for c in staged.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    key = F.col(part).cast("string")
    found = materialize(staged.select(key.alias("part"), F.xxhash64(header, *values).alias("h")).groupBy("part").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.pmod("h", F.lit(2147483648)).cast("decimal(28,0)")).alias("sum_hash"),
        F.bit_xor("h").alias("xor_hash")), "parts")
    old = _manifest(spark, path).select(*[F.col(c).alias(f"old_{c}") for c in ("part", "data_version", "row_count", "sum_hash", "xor_hash")])
    met = found.join(old, F.col("part").eqNullSafe(F.col("old_part")) & (F.col("row_count") == F.col("old_row_count"))
                     & (F.col("sum_hash") == F.col("old_sum_hash")) & (F.col("xor_hash") == F.col("old_xor_hash")), "left")
    met = materialize(met, "compared")
    counts = met.agg(F.count("old_data_version").alias("kept"), F.count_if(F.col("old_data_version").isNull()).alias("written"),
                     F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows")).first()
    gone = old.join(found, F.col("part").eqNullSafe(F.col("old_part")), "left_anti").count()
    has_manifest = table_exists(spark, f"{path}/manifest")
    if not counts["written"] and not gone and has_manifest:
        return PartStatus(0, 0, counts["kept"], counts["rows"])
    version = 1
    if table_exists(spark, f"{path}/data"):
        # above all versions that were published, and all that hold files
        folders = StructType([StructField("_version", LongType())])
        written = spark.read.schema(folders).option("basePath", f"{path}/data").parquet(f"{path}/data").agg(F.max("_version")).first()[0]
        published = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").agg(F.max("version")).first()[0] if has_manifest else None
        version = max(written or 0, published or 0) + 1
    changed = met.where(F.col("old_data_version").isNull()).select(F.col("part").alias("_part"))
    rows = staged.join(changed, key.eqNullSafe(F.col("_part")), "left_semi").withColumn("_part", key)
    write_table(staged.limit(0).coalesce(1), f"{path}/shape")
    # a folder of a version holds only its parts, so an import that died before its manifest is never seen
    write_table(rows, f"{path}/data/_version={version}", sort_by, ("_part",))
    manifest = met.select(
        F.lit(version).cast("bigint").alias("version"), "part", F.coalesce("old_data_version", F.lit(version)).cast("bigint").alias("data_version"),
        "row_count", F.col("sum_hash").cast("decimal(38,0)").alias("sum_hash"), "xor_hash")
    if not counts["rows"]:
        # an empty table is a manifest of one row that names no folder
        none = {"version": version, "part": None, "data_version": -1, "row_count": 0, "sum_hash": 0, "xor_hash": 0}
        kinds = StructType.fromDDL(MANIFEST)
        manifest = spark.range(1).select(*[F.lit(none[f.name]).cast(f.dataType).alias(f.name) for f in kinds])
    manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return PartStatus(counts["written"], gone, counts["kept"], counts["rows"])


def load_parts(spark: SparkSession, path: str) -> DataFrame:
    """The table as of the last published import; folders of replaced parts are not read."""
    shape = spark.read.parquet(f"{path}/shape").schema
    if not table_exists(spark, f"{path}/data"):
        return spark.createDataFrame([], shape)
    folders = StructType([*shape.fields, StructField("_version", LongType()), StructField("_part", StringType())])
    data = spark.read.schema(folders).option("basePath", f"{path}/data").parquet(f"{path}/data")
    parts = _manifest(spark, path).select(F.col("part").alias("_wanted"), F.col("data_version").alias("_version"))
    # a part's folder is named by its text, null by the default folder
    current = data.join(F.broadcast(parts), (data["_version"] == parts["_version"])
                        & data["_part"].eqNullSafe(F.col("_wanted")), "left_semi")
    return current.drop("_version", "_part")
