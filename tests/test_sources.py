import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.errors import ArgumentError
from wattframe.session import materialize, scratch_dir
from wattframe.sources.csv_files import METERED_SCHEMA, NULL_TOKENS, read_csv
from wattframe.operators.sketches import approximate_medians, approximate_stats, part_sketches
from wattframe.sources.store import (
    PartStatus, fingerprint, ingest, ingest_parts, load_parts, load_table, signature, write_table,
)

SCHEMA = T.StructType().add("name", "string").add("reading", "double").add("hour", "integer")


def test_csv_null_tokens_and_bad_numbers(spark, tmp_path):
    lines = ["name,reading,hour"] + [f'"{t}",{t},{t}' for t in NULL_TOKENS if t]
    lines += ['"a, ""b""",1.5,7', "c,bad,7.5", "d,,"]
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    rows = [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv"), SCHEMA).collect()]
    assert rows[: len(NULL_TOKENS) - 1] == [(None, None, None)] * (len(NULL_TOKENS) - 1)
    assert rows[-3] == ('a, "b"', 1.5, 7)
    assert rows[-2][:2] == ("c", None)
    assert rows[-1] == ("d", None, None)


def test_metered_schema_has_all_columns():
    assert len(METERED_SCHEMA) == 22


def test_fingerprint_ignores_order_and_partitioning(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    base = fingerprint(df).first()
    for other in (df.repartition(5, "x"), df.orderBy(F.desc("id")), df.coalesce(1)):
        assert fingerprint(other).first() == base
    for other in (
        df.where("id > 0"), df.unionAll(df), df.unionAll(df.limit(1)),
        df.withColumn("x", F.when(F.col("id") == 3, 0).otherwise(F.col("x"))),
        df.withColumn("x", F.col("x").cast("string")),
        df.withColumnRenamed("x", "y"), df.select(F.col("x").alias("id"), F.col("id").alias("x")),
    ):
        assert fingerprint(other).first() != base


def test_import_is_skipped_only_when_nothing_changed(spark):
    path = scratch_dir(spark, "test-import")
    df = spark.range(10).withColumn("v", F.lit("a"))
    assert (ingest(spark, lambda: df, path).imported, ingest(spark, lambda: df, path).imported) == (True, False)
    changed = df.withColumn("v", F.when(F.col("id") == 4, "b").otherwise("a"))
    status = ingest(spark, lambda: changed, path)
    assert (status.imported, status.rows) == (True, 10)
    assert signature(load_table(spark, path)) == signature(changed)


def test_tables_are_replaced_and_sorted(spark):
    path = scratch_dir(spark, "test-table")
    write_table(spark.range(10), path)
    write_table(spark.range(5).coalesce(1), path, sort_by=("id",))
    assert [r["id"] for r in load_table(spark, path).collect()] == list(range(5))


def test_scratch_is_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(shared)
    assert materialize(spark.range(3), "x").inputFiles()[0].removeprefix("file://").startswith(shared)


def test_no_local_scratch_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Session(), "x")


def test_fingerprint_tells_nulls_apart(spark):
    rows = spark.createDataFrame([("a", None), ("b", "")], "x string, y string")
    moved = spark.createDataFrame([(None, "a"), ("b", "")], "x string, y string")
    empty = spark.createDataFrame([("a", ""), ("b", "")], "x string, y string")
    assert len({signature(df) for df in (rows, moved, empty)}) == 3


def test_filters_skip_files_and_columns(spark):
    path = scratch_dir(spark, "test-layout")
    df = spark.range(2400).select("id", (F.col("id") % 12 + 1).cast("int").alias("month"), F.lit("x").alias("other"))
    write_table(df, path, sort_by=("id",), partition_by=("month",))
    chosen = load_table(spark, path).where("month = 3 AND id < 100").select("id")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "LessThan(id,100)" in plan
    assert "ReadSchema: struct<id:bigint>" in plan
    assert chosen.count() == len([i for i in range(100) if i % 12 + 1 == 3])


def test_csv_columns_by_name(spark, tmp_path):
    kind = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.DoubleType())])
    for name, text in {"turned": 'b,a\n1.5,"x, y"\n', "plain": "a,b\nz,2\n", "other": "a,c\nz,2\n", "breaks": 'a,b\n"x\ny",3\n'}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "turned.csv"), kind).collect()] == [("x, y", 1.5)]
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "plain.csv"), kind).collect()] == [("z", 2.0)]
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "breaks.csv"), kind, line_breaks=True).collect()] == [("x\ny", 3.0)]
    with pytest.raises(ArgumentError):
        read_csv(spark, str(tmp_path / "other.csv"), kind)


def test_parts_that_changed_are_written(spark, tmp_path):
    path = f"{tmp_path}/parts"
    rows = [(i, f"{i % 3:02d}" if i % 4 else None, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, part string, x double")

    def seen():
        return sorted(map(tuple, load_parts(spark, path).select("id", "part", "x").collect()), key=repr)

    assert ingest_parts(spark, lambda: df.limit(0), path, "part") == PartStatus(0, 0, 0, 0) and seen() == []
    assert ingest_parts(spark, lambda: df, path, "part") == PartStatus(4, 0, 0, 40)
    assert seen() == sorted(rows, key=repr)
    assert ingest_parts(spark, lambda: df.repartition(3), path, "part") == PartStatus(0, 0, 4, 40)
    changed = df.withColumn("x", F.when(F.col("id") == 0, -1.0).otherwise(F.col("x")))
    assert ingest_parts(spark, lambda: changed, path, "part", ["id"]) == PartStatus(1, 0, 3, 40)
    assert seen() == sorted([(i, p, -1.0 if i == 0 else x) for i, p, x in rows], key=repr)
    assert ingest_parts(spark, lambda: df.where("part IS NOT NULL"), path, "part") == PartStatus(0, 1, 3, 30)
    assert all(p is not None for _, p, _ in seen())
    assert ingest_parts(spark, lambda: df.limit(0), path, "part") == PartStatus(0, 3, 0, 0) and seen() == []


def test_an_import_that_died_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/parts"
    df = spark.range(10).select("id", (F.col("id") % 2).alias("part"))
    ingest_parts(spark, lambda: df, path, "part")
    # files of a version whose manifest was never written
    df.select(F.col("id") + 100, "part", F.lit("0").alias("_part")).write.partitionBy("_part").parquet(f"{path}/data/_version=2")
    assert sorted(r["id"] for r in load_parts(spark, path).collect()) == list(range(10))
    more = df.unionAll(spark.createDataFrame([(50, 1)], "id long, part long"))
    assert ingest_parts(spark, lambda: more, path, "part") == PartStatus(1, 0, 1, 11)
    assert sorted(r["id"] for r in load_parts(spark, path).collect()) == [*range(10), 50]


def test_sketches_of_parts_are_merged(spark):
    df = spark.range(20_000).select(
        (F.col("id") % 5).alias("part"), F.when(F.col("id") % 10 > 0, (F.col("id") * 7919 % 20_011).cast("double")).alias("x"),
        F.lit(float("nan")).alias("none"), (F.col("id") % 300).cast("string").alias("t"))
    sketches = part_sketches(df, "part", ["x", "none"], ["t"])
    assert sketches.count() == 15
    stats = {r["column"]: r for r in approximate_stats(sketches).collect()}
    assert stats["x"]["n"] == 18_000 and stats["none"]["n"] == 0 and stats["none"]["q50"] is None and stats["t"]["q50"] is None
    for q, column in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        rank = df.where(F.col("x") <= stats["x"][column]).count() / 18_000
        assert abs(rank - q) < 0.02
    assert abs(stats["x"]["distinct_values"] - 18_000) < 1500 and abs(stats["t"]["distinct_values"] - 300) < 20
    assert approximate_stats(sketches.where("part = '3'")).where("column = 'x'").first()["n"] == df.where("part = 3 AND x IS NOT NULL").count()
    assert set(approximate_medians(sketches)) == {"x"}
