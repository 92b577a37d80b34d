"""Session helpers: local test sessions and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the local benchmark. On a cluster, use the session the cluster gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wattframe")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one named by `spark.checkpoint.dir`.

    Every executor must be able to read what another one wrote, so a machine-local folder is taken only
    when the whole application is one local process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = os.path.join(tempfile.gettempdir(), "wattframe")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    For a frame that several jobs read: the lineage is cut, later passes read only the columns they need, and
    a lost executor costs a re-read instead of a recomputation.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly to as many partitions as shuffles have, for rows that are read many times over."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python tasks of jobs started inside get so many rows at once, for rows that are large themselves."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files of a stored table, which Spark takes from the file listing."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
