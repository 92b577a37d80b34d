"""Sources, cleaning and profiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions.numbers import half_up
from wattframe.operators import cleaning as C
from wattframe.operators import clusters as K
from wattframe.operators import profiling as P
from wattframe.operators.encoding import domain_rows, fit_scaler, one_hot, ordinal_code
from wattframe.operators.sketches import approximate_stats, part_sketches
from wattframe.session import materialize, scratch_dir
from wattframe.sources.csv_files import read_csv, write_csv
from wattframe.sources.store import fingerprint, ingest, ingest_parts, load_parts, load_table, signature, write_table
from workload.readings import RAW, READINGS, duckdb_cte, readings, readings_raw
from workload.registry import half_up_sql as hu
from workload.registry import query

R = duckdb_cte()
RR = duckdb_cte(raw=True)

STAMP = "%Y-%m-%d %H:%M:%S"
CLEAN = RR + f"""
, distinct_rows AS (SELECT DISTINCT * FROM readings_raw),
medians AS (SELECT median(temperature_c) AS mt, median(occupancy_pct) AS mo FROM distinct_rows),
modes AS (SELECT occupancy_level AS ml FROM distinct_rows WHERE occupancy_level IS NOT NULL
 GROUP BY occupancy_level ORDER BY count(*) DESC, occupancy_level LIMIT 1),
filled AS (SELECT reading_id, building_name, building_type, try_cast(timestamp_raw AS TIMESTAMP) AS stamp,
 CAST(hour AS DOUBLE) AS hour, CAST(month AS DOUBLE) AS month, coalesce(temperature_c, mt) AS temperature_c,
 coalesce(occupancy_pct, mo) AS occupancy_pct, coalesce(occupancy_level, ml) AS occupancy_level,
 energy_consumption_kwh, energy_category FROM distinct_rows CROSS JOIN medians CROSS JOIN modes),
cleaned AS (SELECT * EXCLUDE (stamp), strftime(stamp, '{STAMP}') AS timestamp_raw FROM filled WHERE stamp IS NOT NULL),
log AS (SELECT 0 AS position, 'duplicates_removed' AS step, NULL AS "column",
  (SELECT count(*) FROM readings_raw) - (SELECT count(*) FROM distinct_rows) AS count, 'first copy kept' AS rule
 UNION ALL SELECT 1, 'missing_filled', 'temperature_c',
  (SELECT count(*) FROM distinct_rows WHERE temperature_c IS NULL), 'median'
 UNION ALL SELECT 2, 'missing_filled', 'occupancy_pct',
  (SELECT count(*) FROM distinct_rows WHERE occupancy_pct IS NULL), 'median'
 UNION ALL SELECT 3, 'missing_filled', 'occupancy_level',
  (SELECT count(*) FROM distinct_rows WHERE occupancy_level IS NULL), 'mode'
 UNION ALL SELECT 4, 'invalid_timestamps_dropped', 'timestamp_raw',
  (SELECT count(*) FROM distinct_rows WHERE try_cast(timestamp_raw AS TIMESTAMP) IS NULL), 'row dropped'),
summary AS (
 SELECT 'before' AS stage, count(*) AS row_count, CAST(11 AS BIGINT) AS column_count,
  CAST(sum((timestamp_raw IS NULL)::INT + (temperature_c IS NULL)::INT + (occupancy_pct IS NULL)::INT
   + (occupancy_level IS NULL)::INT) AS BIGINT) AS missing_total,
  count(*) - (SELECT count(*) FROM distinct_rows) AS duplicates FROM readings_raw
 UNION ALL
 SELECT 'after', count(*), 11, 0, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned)) FROM cleaned)
"""


def _text_stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp_raw", F.col("timestamp_raw").cast("string"))


@query("ingest_csv", RR + """SELECT * REPLACE (CASE WHEN timestamp_raw = 'n/a' THEN NULL ELSE timestamp_raw END
 AS timestamp_raw) FROM readings_raw""")
def ingest_csv(spark, sf_dir):
    raw = readings_raw(spark, sf_dir)
    path = scratch_dir(spark, "csv")
    write_csv(raw, path)
    return read_csv(spark, path, raw.schema)


@query("ingest_roundtrip", RR + "SELECT * FROM readings_raw")
def ingest_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "table")
    write_table(readings_raw(spark, sf_dir), path, sort_by=("month", "building_name"))
    return load_table(spark, path)


@query("ingest_status", RR + """
SELECT a.attempt, a.imported, (SELECT count(*) FROM readings_raw) AS "rows"
FROM (VALUES (1, true), (2, false), (3, true)) AS a(attempt, imported)""")
def ingest_status(spark, sf_dir):
    """A first import, an import of the same data, and one in which a value has changed."""
    raw = readings_raw(spark, sf_dir)
    changed = raw.withColumn("temperature_c", F.col("temperature_c") + F.when(F.col("hour") == 0, 1.0).otherwise(0.0))
    path = scratch_dir(spark, "import")
    done = [ingest(spark, lambda df=df: df, path) for df in (raw, raw, changed)]
    rows = [(i, s.imported, s.rows) for i, s in enumerate(done, start=1)]
    return spark.createDataFrame(rows, "attempt int, imported boolean, rows long")


@query("scan_raw", RR + "SELECT * FROM readings_raw")
def scan_raw(spark, sf_dir):
    return readings_raw(spark, sf_dir)


@query("dataset_fingerprint")
def dataset_fingerprint(spark, sf_dir):
    return fingerprint(readings_raw(spark, sf_dir))


@query("duplicate_count", RR + """SELECT (SELECT count(*) FROM readings_raw)
 - (SELECT count(*) FROM (SELECT DISTINCT * FROM readings_raw)) AS duplicates""")
def duplicate_count(spark, sf_dir):
    return C.duplicate_count(readings_raw(spark, sf_dir))


@query("dedupe_rows", RR + "SELECT DISTINCT * FROM readings_raw")
def dedupe_rows(spark, sf_dir):
    return C.dedupe_rows(readings_raw(spark, sf_dir))


_MISSING = ("timestamp_raw", "temperature_c", "occupancy_pct", "occupancy_level")


@query("missing_profile", RR + ", total AS (SELECT count(*) AS n FROM readings_raw), gaps AS (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", (SELECT count(*) FROM readings_raw WHERE {c} IS NULL) AS missing"
    for i, c in zip((3, 6, 7, 8), _MISSING, strict=True)) + f""")
 SELECT position, "column", missing, {hu('(missing * 100 / n)', 2)} AS pct FROM gaps, total WHERE missing > 0""")
def missing_profile(spark, sf_dir):
    return P.missing_profile(readings_raw(spark, sf_dir))


@query("coerce_numeric", RR + """, as_text AS (SELECT reading_id, CASE WHEN reading_id % 97 = 0 THEN 'bad'
 ELSE CAST(temperature_c AS STRING) END AS temperature_c, CAST(hour AS STRING) AS hour FROM readings_raw)
 SELECT reading_id, try_cast(temperature_c AS DOUBLE) AS temperature_c, try_cast(hour AS DOUBLE) AS hour FROM as_text""")
def coerce_numeric(spark, sf_dir):
    text = readings_raw(spark, sf_dir).select(
        "reading_id",
        F.when(F.col("reading_id") % 97 == 0, "bad").otherwise(F.col("temperature_c").cast("string"))
        .alias("temperature_c"),
        F.col("hour").cast("string").alias("hour"),
    )
    return C.coerce_numeric(text, RAW)


@query("impute_median", RR + """, d AS (SELECT DISTINCT * FROM readings_raw),
 m AS (SELECT median(temperature_c) AS t, median(occupancy_pct) AS o FROM d)
 SELECT reading_id, coalesce(temperature_c, t) AS temperature_c, coalesce(occupancy_pct, o) AS occupancy_pct FROM d, m""")
def impute_median(spark, sf_dir):
    rows = C.dedupe_rows(readings_raw(spark, sf_dir))
    return C.impute_median(rows, RAW).select("reading_id", "temperature_c", "occupancy_pct")


@query("impute_mode", RR + """, d AS (SELECT DISTINCT * FROM readings_raw),
 m AS (SELECT occupancy_level AS l FROM d WHERE occupancy_level IS NOT NULL GROUP BY 1
  ORDER BY count(*) DESC, occupancy_level LIMIT 1)
 SELECT reading_id, coalesce(occupancy_level, l) AS occupancy_level FROM d, m""")
def impute_mode(spark, sf_dir):
    rows = C.dedupe_rows(readings_raw(spark, sf_dir))
    return C.impute_mode(rows, RAW).select("reading_id", "occupancy_level")


@query("parse_timestamp", RR + f"""SELECT reading_id, strftime(try_cast(timestamp_raw AS TIMESTAMP), '{STAMP}')
 AS timestamp_raw FROM readings_raw""")
def parse_timestamp(spark, sf_dir):
    return _text_stamp(C.parse_timestamp(readings_raw(spark, sf_dir), RAW)).select("reading_id", "timestamp_raw")


@query("drop_bad_ts", RR + f"""SELECT reading_id, strftime(try_cast(timestamp_raw AS TIMESTAMP), '{STAMP}')
 AS timestamp_raw FROM readings_raw WHERE try_cast(timestamp_raw AS TIMESTAMP) IS NOT NULL""")
def drop_bad_ts(spark, sf_dir):
    return _text_stamp(C.drop_bad_timestamps(readings_raw(spark, sf_dir), RAW)).select("reading_id", "timestamp_raw")


@query("clean_readings", CLEAN + "SELECT * FROM cleaned")
def clean_readings(spark, sf_dir):
    return _text_stamp(C.clean(readings_raw(spark, sf_dir), RAW).rows)


@query("clean_log", CLEAN + "SELECT * FROM log")
def clean_log(spark, sf_dir):
    return C.clean(readings_raw(spark, sf_dir), RAW).log


@query("before_after", CLEAN + "SELECT * FROM summary")
def before_after(spark, sf_dir):
    return P.before_after(C.clean(readings_raw(spark, sf_dir), RAW))


@query("timestamp_range", CLEAN + """SELECT 'string' AS type_before, 'timestamp_ntz' AS type_after,
 min(timestamp_raw) AS first_timestamp, max(timestamp_raw) AS last_timestamp FROM cleaned""")
def timestamp_range(spark, sf_dir):
    raw = readings_raw(spark, sf_dir)
    return P.timestamp_range(raw, C.clean(raw, RAW).rows, RAW)


@query("step_log", CLEAN + f"""
SELECT 0 AS position, 'Load into table' AS step,
 format('{{:,}}', row_count) || ' rows imported into table ''readings''' AS result FROM summary WHERE stage = 'before'
UNION ALL SELECT 1, 'Duplicate removal', count || ' duplicate rows removed' FROM log WHERE step = 'duplicates_removed'
UNION ALL SELECT 2, 'Missing value handling',
 string_agg("column" || ': ' || count || ' -> ' || rule, '; ' ORDER BY position) FROM log WHERE step = 'missing_filled'
UNION ALL SELECT 3, 'Timestamp conversion', 'string -> timestamp_ntz'
UNION ALL SELECT 4, 'Categorical encoding', 'One-hot for 3 features, ordinal for target'
UNION ALL SELECT 5, 'Numerical scaling', 'Z-score on {len(READINGS.scaled_columns)} numeric columns'
UNION ALL SELECT 6, 'Feature selection', 'Target-derived columns and identifiers excluded'""")
def step_log(spark, sf_dir):
    raw = readings_raw(spark, sf_dir)
    cleaned = C.clean(raw, RAW)
    return P.step_log(P.before_after(cleaned), cleaned.log, P.timestamp_range(raw, cleaned.rows, RAW), RAW)


@query("category_domains", R + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", {c} AS value FROM readings" for c in READINGS.class_categorical))
def category_domains(spark, sf_dir):
    return domain_rows(readings(spark, sf_dir), READINGS.class_categorical)


@query("encoding_report", R + ", d AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", {c} AS value FROM readings" for c in READINGS.class_categorical) + """),
 l AS (SELECT DISTINCT energy_category AS value,
  CASE energy_category WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END AS code FROM readings)
 SELECT "column", 'One-hot' AS method, string_agg(value, ', ' ORDER BY value) AS categories, count(*) AS new_columns
 FROM d GROUP BY "column"
 UNION ALL SELECT 'energy_category (target)', 'Label / ordinal',
  string_agg(value || ' = ' || code, ', ' ORDER BY code), 1 FROM l""")
def encoding_report(spark, sf_dir):
    return P.encoding_report(readings(spark, sf_dir), READINGS)


@query("ordinal_encode", R + """SELECT reading_id, energy_category,
 CASE energy_category WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS code FROM readings""")
def ordinal_encode(spark, sf_dir):
    code = ordinal_code(F.col("energy_category"), READINGS.category_order)
    return readings(spark, sf_dir).select("reading_id", "energy_category", code.alias("code"))


@query("onehot", R + ", domains AS (SELECT " + ", ".join(
    f"list(DISTINCT {c} ORDER BY {c}) AS d_{c}" for c in READINGS.class_categorical) + """ FROM readings)
 SELECT reading_id, """ + ", ".join(
    f"array_to_string(list_transform(d_{c}, lambda x: CASE WHEN x = {c} THEN 1 ELSE 0 END), ',') AS {c}"
    for c in READINGS.class_categorical) + " FROM readings, domains")
def onehot(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    columns = READINGS.class_categorical
    encoded = one_hot(readings(spark, sf_dir).select("reading_id", *columns), columns)
    return encoded.select("reading_id", *[
        F.array_join(F.transform(vector_to_array(f"{c}_slots"), lambda x: x.cast("int").cast("string")), ",").alias(c)
        for c in columns
    ])


def _stats(columns) -> str:
    return ", stats AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in columns) + " FROM readings)"


@query("zscore", R + _stats(READINGS.scaled_columns) + "SELECT reading_id, " + ", ".join(
    f"{hu(f'(({c} - m_{c}) / s_{c})', 4)} AS z_{c}" for c in READINGS.scaled_columns) + " FROM readings, stats")
def zscore(spark, sf_dir):
    rows = readings(spark, sf_dir).select("reading_id", *READINGS.scaled_columns)
    z = fit_scaler(rows, READINGS.scaled_columns).expressions()
    return rows.select("reading_id", *[half_up(z[c], 4).alias(f"z_{c}") for c in READINGS.scaled_columns])


@query("scaling_report", R + _stats(READINGS.scaled_columns) + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", {hu(f'avg({c})', 3)} AS mean_before,
 {hu(f'stddev_samp({c})', 3)} AS std_before, {hu(f'avg(({c} - m_{c}) / s_{c})', 3)} AS mean_after,
 {hu(f'stddev_pop(({c} - m_{c}) / s_{c})', 3)} AS std_after FROM readings, stats"""
    for i, c in enumerate(READINGS.scaled_columns)))
def scaling_report(spark, sf_dir):
    return P.scaling_report(readings(spark, sf_dir), READINGS.scaled_columns)


_CORR = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {hu(f'corr({c}, energy_consumption_kwh)', 3)} AS corr_with_energy FROM readings"
    for c in READINGS.regression_numeric)
_ANOVA = ", per_class AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, energy_category, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v
 FROM readings GROUP BY energy_category""" for c in READINGS.class_numeric) + f"""),
 grand AS (SELECT feature, sum(n * m) / sum(n) AS g FROM per_class GROUP BY feature),
 scores AS (SELECT feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f
  FROM per_class JOIN grand USING (feature) GROUP BY feature),
 anova AS (SELECT feature, {hu('f', 1)} AS f_score FROM scores)"""


@query("corr_with_target", R + _CORR)
def corr_with_target(spark, sf_dir):
    return P.corr_with_target(readings(spark, sf_dir), READINGS.regression_numeric, READINGS.measure)


@query("anova_f", R + _ANOVA + " SELECT feature, f_score FROM anova")
def anova_f(spark, sf_dir):
    return P.anova_f(readings(spark, sf_dir), READINGS.class_numeric, READINGS.category)


@query("feature_selection", R + _ANOVA + f""", correlations AS ({_CORR}),
 listed(position, feature, used_in) AS (VALUES (0, 'temperature_c', 'Classification, Regression'),
  (1, 'humidity_pct', 'Classification, Regression'), (2, 'occupancy_pct', 'Classification, Regression'),
  (3, 'hvac_usage_pct', 'Classification, Regression'), (4, 'lighting_usage_pct', 'Classification, Regression'),
  (5, 'hour', 'Classification, Regression'), (6, 'floor_area_sqft', 'Regression'),
  (7, 'building_type', 'Classification, Regression'), (8, 'temperature_level', 'Classification'),
  (9, 'occupancy_level', 'Classification'))
 SELECT position, feature, corr_with_energy, f_score AS f_score_vs_category, used_in
 FROM listed LEFT JOIN correlations USING (feature) LEFT JOIN anova USING (feature)""")
def feature_selection(spark, sf_dir):
    return P.feature_selection(readings(spark, sf_dir), READINGS)


@query("excluded_columns", R + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{why}' AS reason, count({c}) AS filled FROM readings"
    for c, why in READINGS.excluded if c != "timestamp"))
def excluded_columns(spark, sf_dir):
    return P.excluded_columns(readings(spark, sf_dir), READINGS)


@query("preview_clean", R + """SELECT building_name, CAST(hour AS INT) AS hour, temperature_c, occupancy_pct,
 hvac_usage_pct, energy_consumption_kwh FROM readings ORDER BY reading_id, energy_consumption_kwh LIMIT 5""")
def preview_clean(spark, sf_dir):
    return P.preview_clean(readings(spark, sf_dir), READINGS, order=("reading_id", "energy_consumption_kwh"))


_PREVIEW = ("temperature_c", "occupancy_pct", "hvac_usage_pct", "lighting_usage_pct")


@query("preview_scaled", R + _stats(_PREVIEW) + "SELECT " + ", ".join(
    f"{hu(f'(({c} - m_{c}) / s_{c})', 3)} AS {c}" for c in _PREVIEW)
    + " FROM readings, stats ORDER BY reading_id, energy_consumption_kwh LIMIT 5")
def preview_scaled(spark, sf_dir):
    return P.preview_scaled(readings(spark, sf_dir), READINGS, order=("reading_id", "energy_consumption_kwh"))


# Raw rows, cleaned, then measured: what a report on an imported table reads.
_CLEANED = ("temperature_c", "occupancy_pct", "energy_consumption_kwh")
_CLEANED_FEATURES = ("temperature_c", "occupancy_pct", "hour")
_CLEANED_STATS = ", stats AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _CLEANED) + " FROM cleaned)"
_CLEANED_CENTERS = [[-0.8, -0.9, -1.0], [0.9, 0.1, 0.2], [0.2, 1.0, 1.1]]


def _cleaned(spark, sf_dir):
    return C.clean(readings_raw(spark, sf_dir), RAW).rows


@query("scaling_from_raw", CLEAN + _CLEANED_STATS + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", {hu(f'avg({c})', 3)} AS mean_before,
 {hu(f'stddev_samp({c})', 3)} AS std_before, {hu(f'avg(({c} - m_{c}) / s_{c})', 3)} AS mean_after,
 {hu(f'stddev_pop(({c} - m_{c}) / s_{c})', 3)} AS std_after FROM cleaned, stats"""
    for i, c in enumerate(_CLEANED)))
def scaling_from_raw(spark, sf_dir):
    return P.scaling_report(_cleaned(spark, sf_dir), _CLEANED)


@query("correlation_from_raw", CLEAN + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {hu(f'corr({c}, energy_consumption_kwh)', 3)} AS corr_with_energy FROM cleaned"
    for c in _CLEANED_FEATURES))
def correlation_from_raw(spark, sf_dir):
    return P.corr_with_target(_cleaned(spark, sf_dir), _CLEANED_FEATURES, RAW.measure)


@query("anova_from_raw", CLEAN + ", per_class AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, energy_category, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v
 FROM cleaned GROUP BY energy_category""" for c in _CLEANED_FEATURES) + f"""),
 grand AS (SELECT feature, sum(n * m) / sum(n) AS g FROM per_class GROUP BY feature),
 scores AS (SELECT feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f
  FROM per_class JOIN grand USING (feature) GROUP BY feature)
SELECT feature, {hu('f', 1)} AS f_score FROM scores""")
def anova_from_raw(spark, sf_dir):
    return P.anova_f(_cleaned(spark, sf_dir), _CLEANED_FEATURES, RAW.category)


@query("clusters_from_raw", CLEAN + _CLEANED_STATS + ", d AS (SELECT " + ", ".join(
    " + ".join(f"(({c} - m_{c}) / s_{c} - {x}::DOUBLE) * (({c} - m_{c}) / s_{c} - {x}::DOUBLE)"
               for c, x in zip(_CLEANED, center, strict=True)) + f" AS d{i}"
    for i, center in enumerate(_CLEANED_CENTERS)) + f""" FROM cleaned, stats),
 near AS (SELECT least(d0, d1, d2) AS d, CASE least(d0, d1, d2) WHEN d0 THEN 0 WHEN d1 THEN 1 ELSE 2 END AS cluster FROM d)
SELECT cluster, count(*) AS records, {hu('sum(d)', 1)} AS inertia FROM near GROUP BY cluster""")
def clusters_from_raw(spark, sf_dir):
    """Cleaned rows on the z-scale, at fixed centers."""
    rows = _cleaned(spark, sf_dir).select(*_CLEANED)
    scaled = fit_scaler(rows, _CLEANED).transform(rows)
    assigned = K.assign_centers(scaled, [f"z_{c}" for c in _CLEANED], _CLEANED_CENTERS)
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("records"), half_up(F.sum("distance2"), 1).alias("inertia"))


@query("ingest_parts", R + """, attempts(attempt, written, kept, removed) AS (VALUES (1, 12, 0, 0), (2, 0, 12, 0), (3, 1, 11, 0), (4, 0, 11, 1))
SELECT attempt, written, kept, removed, count(*) AS records,
 CAST(sum(h + CASE WHEN attempt >= 3 AND m = 2 THEN 1 ELSE 0 END) AS BIGINT) AS hours
FROM attempts, (SELECT month AS m, hour AS h FROM readings) WHERE attempt < 4 OR m <> 7 GROUP BY ALL""")
def ingest_parts_by_month(spark, sf_dir):
    """A first import, the same again, one month changed, one month gone; each time the whole table is read back."""
    data = readings(spark, sf_dir).select("reading_id", "month", "hour", "building_name")
    changed = data.withColumn("hour", F.col("hour") + F.when(F.col("month") == 2, 1).otherwise(0))
    path, rows = scratch_dir(spark, "parts"), None
    for attempt, frame in enumerate((data, data, changed, changed.where("month <> 7")), start=1):
        done = ingest_parts(spark, lambda df=frame: df, path, "month", ["building_name"])
        seen = load_parts(spark, path).agg(
            F.lit(attempt).alias("attempt"), F.lit(done.written).alias("written"), F.lit(done.kept).alias("kept"),
            F.lit(done.removed).alias("removed"), F.count(F.lit(1)).alias("records"), F.sum("hour").alias("hours"))
        seen = materialize(seen, "imported")
        rows = seen if rows is None else rows.unionAll(seen)
    return rows


_SKETCHED = READINGS.cluster_numeric


@query("sketched_stats", R + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, true AS ranks_near, true AS distinct_near FROM readings" for c in (*_SKETCHED, "building_name")))
def sketched_stats(spark, sf_dir):
    """Sketches per month, stored and merged: quartiles must have ranks within 2 % of the rows, distinct counts lie
    within 8 % (both are compared with exact counts here)."""
    rows = readings(spark, sf_dir)
    sketches = materialize(part_sketches(rows, "month", _SKETCHED, ("building_name",)), "sketches")
    stats = {r["column"]: r for r in approximate_stats(sketches).collect()}
    parts = []
    for c, s in stats.items():
        near = F.lit(True)
        for fraction, q in ((0.25, s["q25"]), (0.5, s["q50"]), (0.75, s["q75"])):
            if q is not None:
                below, upto = F.avg((F.col(c) < q).cast("double")), F.avg((F.col(c) <= q).cast("double"))
                near = near & (below <= fraction + 0.02) & (upto >= fraction - 0.02)
        exact = F.count_distinct(c)
        parts.append(rows.agg(
            F.lit(c).alias("column"), F.lit(s["n"]).alias("n"), near.alias("ranks_near"),
            (F.abs(F.lit(s["distinct_values"]) - exact) <= 0.08 * exact).alias("distinct_near")))
    return reduce(lambda a, b: a.unionAll(b), parts)


@query("fingerprint_facts", "SELECT unnest(['permuted', 'changed', 'repeated', 'renamed']) AS variant, unnest([true, false, false, false]) AS same")
def fingerprint_facts(spark, sf_dir):
    """Whether the fingerprint of the table stays: in another order, with one value changed, a row twice, a column renamed."""
    data = materialize(readings(spark, sf_dir).select("reading_id", "hour", "building_name", "energy_consumption_kwh"), "printed")
    first = data.agg(F.min("reading_id")).first()[0]
    variants = {
        "permuted": data.repartition(7, "hour").sortWithinPartitions(F.col("reading_id").desc()),
        "changed": data.withColumn("hour", F.col("hour") + F.when(F.col("reading_id") == first, 1).otherwise(0)),
        "repeated": data.unionAll(data.where(F.col("reading_id") == first).limit(1)),
        "renamed": data.withColumnRenamed("hour", "hours"),
    }
    own = signature(data)
    return spark.createDataFrame([(name, signature(df) == own) for name, df in variants.items()], "variant string, same boolean")
