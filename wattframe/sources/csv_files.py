"""CSV scan with an explicit schema and one list of texts that mean "missing"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.errors import ArgumentError
from wattframe.functions.numbers import to_number

# Texts that a data-frame CSV reader treats as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The metered-usage table as stored, timestamp still text.
METERED_SCHEMA = T.StructType(
    [
        T.StructField("building_id", T.StringType()),
        T.StructField("building_name", T.StringType()),
        T.StructField("building_type", T.StringType()),
        T.StructField("floor_area_sqft", T.DoubleType()),
        T.StructField("floor_count", T.IntegerType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("is_weekend", T.IntegerType()),
        T.StructField("temperature_c", T.DoubleType()),
        T.StructField("humidity_pct", T.DoubleType()),
        T.StructField("occupancy_pct", T.DoubleType()),
        T.StructField("occupancy_level", T.StringType()),
        T.StructField("hvac_usage_pct", T.DoubleType()),
        T.StructField("lighting_usage_pct", T.DoubleType()),
        T.StructField("temperature_level", T.StringType()),
        T.StructField("energy_consumption_kwh", T.DoubleType()),
        T.StructField("energy_category", T.StringType()),
        T.StructField("estimated_cost_inr", T.DoubleType()),
        T.StructField("co2_kg", T.DoubleType()),
        T.StructField("anomaly_flag", T.IntegerType()),
    ]
)


def _typed(text: Column, wanted: T.DataType) -> Column:
    known = F.when(~text.isin(*NULL_TOKENS), text)
    if isinstance(wanted, T.StringType):
        return known
    if isinstance(wanted, T.DoubleType):
        return to_number(known)
    return known.try_cast(wanted)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = METERED_SCHEMA, line_breaks: bool = False) -> DataFrame:
    """Read every field as text first, so that a bad field becomes null and never drops its row.

    Columns are found by their names in the header, in any order; a missing or unknown name is an error, and so is
    a file whose header differs from that of the first one. `line_breaks`: fields may hold quoted line breaks,
    which costs one task per file instead of one per block.
    """
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": line_breaks}
    names = spark.read.options(**options).csv(path).columns
    if sorted(names) != sorted(schema.names):
        raise ArgumentError(
            f"header of {path}: missing {sorted(set(schema.names) - set(names))}, unknown {sorted(set(names) - set(schema.names))}")
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    lines = spark.read.options(**options, enforceSchema=False).schema(as_text).csv(path)
    return lines.select(*[_typed(F.col(f.name), f.dataType).alias(f.name) for f in schema])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
