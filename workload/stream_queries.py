"""Streaming jobs, driven to completion over the files of the line-item table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from wattframe.functions.numbers import half_up
from wattframe.operators import trees as T
from wattframe.operators.splitting import split_random
from wattframe.operators.validation import class_input_check, energy_input_check
from wattframe.session import materialize, scratch_dir
from wattframe.streaming.rollup import hourly_rollup, read_rollup, upsert_rollup, write_rollup
from wattframe.streaming.scoring import score_stream
from workload.model_queries import _DOMAINS, _ENERGY_ERROR, _RECORDS, _SCORES, _tree, domains, records
from workload.readings import READINGS, duckdb_cte, readings, table
from workload.registry import half_up_sql as hu
from workload.registry import query

R = duckdb_cte()
# one reading id occurs twice in the smallest tables
ARRIVING = replace(READINGS, key=("reading_id", READINGS.measure))


def arriving(spark, sf_dir):
    """Line items as a stream; the pattern matches one file as well as a folder of files."""
    schema = table(spark, sf_dir, "lineitem").schema
    lineitem = spark.readStream.schema(schema).parquet(f"{sf_dir}/lineitem.parque[t]")
    return readings(spark, sf_dir, lineitem)


def _shown(rolled):
    return rolled.select(
        F.col("hour_start").cast("string").alias("hour_start"),
        "records", half_up(F.col("total_energy"), 2).alias("total_energy"),
        half_up(F.col("avg_energy"), 4).alias("avg_energy"))


_HOURS = f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS hour_start, count(*) AS records,
 {hu('sum(energy_consumption_kwh)', 2)} AS total_energy, {hu('avg(energy_consumption_kwh)', 4)} AS avg_energy
 FROM readings GROUP BY ts"""


@query("stream_rollup", R + _HOURS)
def stream_rollup(spark, sf_dir):
    """Every hour as it stands after the last batch, those that are still open too."""
    path, checkpoint = scratch_dir(spark, "rollup"), scratch_dir(spark, "rollup-checkpoint")
    rolled = hourly_rollup(arriving(spark, sf_dir), ARRIVING)
    upsert_rollup(rolled, path, checkpoint).awaitTermination()
    return _shown(read_rollup(spark, path, rolled.schema))


@query("stream_rollup_closed", R + _HOURS +
       " HAVING ts + INTERVAL '1' HOUR <= (SELECT max(ts) FROM readings) - INTERVAL '1' HOUR")
def stream_rollup_closed(spark, sf_dir):
    """Hours closed by the watermark, each written once."""
    path, checkpoint = scratch_dir(spark, "rollup"), scratch_dir(spark, "rollup-checkpoint")
    rolled = hourly_rollup(arriving(spark, sf_dir), ARRIVING)
    write_rollup(rolled, path, checkpoint).awaitTermination()
    return _shown(spark.read.schema(rolled.schema).parquet(path))


@query("batch_rollup", R + _HOURS)
def batch_rollup(spark, sf_dir):
    return _shown(hourly_rollup(readings(spark, sf_dir), ARRIVING))


def _outcomes(spark, sf_dir, check, score, predicted):
    """Streams all records through `score_stream`; (reading_id, error, predicted) of what both tables then hold."""
    good, bad = scratch_dir(spark, "scored"), scratch_dir(spark, "quarantine")
    checkpoint = scratch_dir(spark, "scoring-checkpoint")
    score_stream(records(arriving(spark, sf_dir)), check, score, good, bad, checkpoint).awaitTermination()
    scored = spark.read.parquet(good).select("reading_id", F.lit(None).cast("string").alias("error"), predicted.alias("predicted"))
    return scored.unionAll(spark.read.parquet(bad).select("reading_id", "error", F.lit(None)))


@query("stream_scoring", _SCORES + "SELECT DISTINCT c.reading_id, error, CASE WHEN error IS NULL THEN label END AS predicted"
       " FROM checked c JOIN scored s USING (reading_id)")
def stream_scoring(spark, sf_dir):
    """Every record is either classified by the tree or quarantined with its error."""
    history, tree = _tree(spark, sf_dir)
    check = class_input_check(domains(history), READINGS)
    return _outcomes(spark, sf_dir, check, lambda batch: tree.score(batch, READINGS), F.col("predicted")).distinct()


@query("stream_energy", R + _RECORDS + _DOMAINS +
       f"SELECT reading_id, {_ENERGY_ERROR} AS error, CASE WHEN error IS NULL THEN true END AS predicted FROM records, domains")
def stream_energy(spark, sf_dir):
    """The same with energy, cost and emissions from a forest."""
    needed = [*READINGS.key, *READINGS.regression_numeric, *READINGS.class_categorical, READINGS.measure]
    rows = readings(spark, sf_dir).select(*dict.fromkeys(needed))
    history = materialize(split_random(rows, READINGS.key), "history")
    model = T.fit_forest(history.where("side = 'train'"), READINGS, trees=5, max_depth=6)
    check = energy_input_check(domains(history), READINGS)
    return _outcomes(spark, sf_dir, check, lambda batch: T.score_energy(batch, model), F.col("energy_kwh") > 0)
