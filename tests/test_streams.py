from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wattframe.operators.encoding import stored_domains
from wattframe.operators.validation import class_input_check
from wattframe.roles import METERED
from wattframe.session import scratch_dir
from wattframe.streaming.rollup import compact_rollup, hourly_rollup, read_rollup, upsert_rollup, write_rollup
from wattframe.streaming.scoring import score_stream

ROLES = replace(METERED, timestamp="ts", key=("reading_id",))
SCHEMA = "reading_id long, ts timestamp_ntz, energy_consumption_kwh double"


def arrive(spark, folder, rows):
    df = spark.createDataFrame(rows, "reading_id long, ts string, energy_consumption_kwh double")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, checkpoint):
    source = spark.readStream.schema(SCHEMA).parquet(folder)
    rolled = hourly_rollup(source, ROLES)
    write_rollup(rolled, out, checkpoint).awaitTermination()
    return {str(r["hour_start"])[11:16]: (r["records"], r["total_energy"])
            for r in spark.read.schema(rolled.schema).parquet(out).collect()}


def test_rollup_bounds_late_and_repeated_readings(spark):
    folder, out, checkpoint = (scratch_dir(spark, n) for n in ("arriving", "rolled", "ck"))
    arrive(spark, folder, [(1, "2024-01-01 05:10", 1.0), (2, "2024-01-01 05:50", 2.0), (1, "2024-01-01 05:10", 1.0),
                           (3, "2024-01-01 06:10", 4.0)])
    assert run(spark, folder, out, checkpoint) == {}
    # 30 minutes late is still counted; a repetition is not
    arrive(spark, folder, [(4, "2024-01-01 05:40", 8.0), (3, "2024-01-01 06:10", 4.0), (5, "2024-01-01 09:00", 1.0)])
    assert run(spark, folder, out, checkpoint) == {"05:00": (3, 11.0), "06:00": (1, 4.0)}
    # hours late: the hour is closed
    arrive(spark, folder, [(6, "2024-01-01 05:59", 100.0), (7, "2024-01-01 23:00", 1.0)])
    assert run(spark, folder, out, checkpoint) == {"05:00": (3, 11.0), "06:00": (1, 4.0), "09:00": (1, 1.0)}


def test_open_hours_are_shown_as_they_stand(spark):
    folder, out, checkpoint, compact = (scratch_dir(spark, n) for n in ("arriving", "upserted", "ck", "compact"))

    def advance(rows):
        arrive(spark, folder, rows)
        rolled = hourly_rollup(spark.readStream.schema(SCHEMA).parquet(folder), ROLES)
        upsert_rollup(rolled, out, checkpoint).awaitTermination()
        return {str(r["hour_start"])[11:16]: (r["records"], r["total_energy"]) for r in read_rollup(spark, out, rolled.schema).collect()}

    assert advance([(1, "2024-01-01 05:10", 1.0), (1, "2024-01-01 05:10", 1.0), (3, "2024-01-01 06:10", 4.0)]) == {
        "05:00": (1, 1.0), "06:00": (1, 4.0)}
    state = {"05:00": (2, 9.0), "06:00": (1, 4.0), "09:00": (1, 1.0)}
    assert advance([(4, "2024-01-01 05:40", 8.0), (3, "2024-01-01 06:10", 4.0), (5, "2024-01-01 09:00", 1.0)]) == state
    # hours late: the hour is closed and stays
    assert advance([(6, "2024-01-01 05:59", 100.0)]) == state
    schema = hourly_rollup(spark.createDataFrame([], SCHEMA), ROLES).schema
    compact_rollup(spark, out, compact, schema)
    rows = read_rollup(spark, compact, schema).collect()
    assert {str(r["hour_start"])[11:16]: (r["records"], r["total_energy"]) for r in rows} == state


DOMAINS = {"building_type": ["Lab"], "temperature_level": ["Low"], "occupancy_level": ["High"]}
FIELDS = [*METERED.class_numeric, *METERED.class_categorical]


@pytest.mark.parametrize("fail_first", [False, True])
def test_scoring_quarantines_and_survives_a_restart(spark, fail_first):
    folder, good, bad, checkpoint = (scratch_dir(spark, n) for n in ("records", "good", "bad", "ck"))
    rows = [(i, *["7"] * 5, str(i), "Lab", "Low", "High") for i in range(30)]
    schema = "id int, " + ", ".join(f"{c} string" for c in FIELDS)
    spark.createDataFrame(rows, schema).write.parquet(folder)
    attempts = []

    def score(batch):
        attempts.append(1)
        if fail_first and len(attempts) == 1:
            batch.write.mode("overwrite").parquet(f"{good}/batch=0")
            raise RuntimeError("lost")
        return batch.withColumn("predicted", F.col("hour") * 2)

    pairs = [(c, v) for c, values in DOMAINS.items() for v in values]
    known = stored_domains(spark.createDataFrame(pairs, "column string, value string"), list(DOMAINS))

    def start():
        source = spark.readStream.schema(schema).parquet(folder)
        score_stream(source, class_input_check(known), score, good, bad,
                     checkpoint).awaitTermination()

    if fail_first:
        with pytest.raises(Exception, match="lost"):
            start()
    start()
    start()
    scored = spark.read.parquet(good).collect()
    assert sorted(r["id"] for r in scored) == list(range(24))
    assert all(r["predicted"] == r["hour"] * 2 for r in scored)
    quarantined = spark.read.parquet(bad).collect()
    assert sorted(r["id"] for r in quarantined) == list(range(24, 30))
    assert {r["error"] for r in quarantined} == {"Hour must be between 0 and 23."}


def test_no_batch_is_kept_in_memory(spark):
    folder, good, bad, checkpoint = (scratch_dir(spark, n) for n in ("records", "good", "bad", "ck"))
    rows = [(i, *["7"] * 5, str(i), "Lab", "Low", "High") for i in range(30)]
    schema = "id int, " + ", ".join(f"{c} string" for c in FIELDS)
    spark.createDataFrame(rows, schema).write.parquet(folder)
    pairs = [(c, v) for c, values in DOMAINS.items() for v in values]
    known = stored_domains(spark.createDataFrame(pairs, "column string, value string"), list(DOMAINS))
    plans = []

    def score(batch):
        plans.append(batch._jdf.queryExecution().executedPlan().toString())
        return batch

    score_stream(spark.readStream.schema(schema).parquet(folder), class_input_check(known), score, good, bad,
                 checkpoint).awaitTermination()
    assert plans and not [p for p in plans if "InMemoryTableScan" in p]
    assert spark.read.parquet(good).count() == 24 and spark.read.parquet(bad).count() == 6
