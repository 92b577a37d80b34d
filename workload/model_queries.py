"""Splits, evaluation, levels, validation, and the fitted tree and forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.functions.numbers import half_up
from wattframe.operators import evaluation as E
from wattframe.operators import levels as L
from wattframe.operators import trees as T
from wattframe.operators.count_tree import TREE_VIEW_DEPTH, fit_count_tree
from wattframe.operators.encoding import category_domains
from wattframe.operators.splitting import split_random, split_sizes, split_stratified
from wattframe.operators.validation import class_input_check, energy_input_check, validate
from wattframe.plans.scoring import classify_records, predict_records
from wattframe.session import dealt, materialize, scratch_dir
from wattframe.sources.model_store import fit_or_load
from workload.readings import READINGS, duckdb_cte, readings, table
from workload.registry import half_up_sql as hu
from workload.registry import query

CLASSES = READINGS.category_order
# A hash both engines can compute; it is taken modulo first so that it never leaves 64 bits.
HASH = "(((reading_id % 1000003) * 7919) % 1000003)"
SIDED = duckdb_cte() + f"""
, sided AS (SELECT *, CASE WHEN {HASH} % 100 < 20 THEN 'test' ELSE 'train' END AS side FROM readings),
test AS (SELECT * FROM sided WHERE side = 'test')"""
R = duckdb_cte()


def order_hash():
    return F.expr(HASH)


def sided(spark, sf_dir):
    return split_random(readings(spark, sf_dir), READINGS.key, is_test=F.expr(f"{HASH} % 100 < 20"))


def test_side(spark, sf_dir):
    return sided(spark, sf_dir).where("side = 'test'")


@query("split_random", SIDED + "SELECT reading_id, energy_category, side FROM sided")
def split_by_hash(spark, sf_dir):
    return sided(spark, sf_dir).select("reading_id", "energy_category", "side")


@query("split_stratified", R + f"""
, ranked AS (SELECT energy_category, {HASH} AS h, row_number() OVER (PARTITION BY energy_category ORDER BY {HASH}) AS i,
  count(*) OVER (PARTITION BY energy_category) AS n FROM readings),
cuts AS (SELECT energy_category, max(h) AS cut FROM ranked WHERE i <= round_even(n * 0.2, 0) GROUP BY energy_category)
SELECT reading_id, energy_category, CASE WHEN {HASH} <= cut THEN 'test' ELSE 'train' END AS side
FROM readings JOIN cuts USING (energy_category)""")
def stratified(spark, sf_dir):
    rows = split_stratified(readings(spark, sf_dir), READINGS.key, READINGS.category, order=order_hash())
    return rows.select("reading_id", "energy_category", "side")


@query("split_sizes", SIDED + "SELECT side, count(*) AS records FROM sided GROUP BY side")
def sizes(spark, sf_dir):
    return split_sizes(sided(spark, sf_dir))


_GRID = """, classes(c) AS (VALUES ('Low'), ('Medium'), ('High')),
cm AS (SELECT x.c AS actual, y.c AS predicted, (SELECT count(*) FROM test
 WHERE energy_category = x.c AND pred_category = y.c) AS n FROM classes x, classes y),
scores AS (SELECT c AS class,
 coalesce(sum(n) FILTER (actual = c AND predicted = c) / nullif(sum(n) FILTER (predicted = c), 0), 0) AS precision,
 coalesce(sum(n) FILTER (actual = c AND predicted = c) / nullif(sum(n) FILTER (actual = c), 0), 0) AS recall,
 coalesce(2 * sum(n) FILTER (actual = c AND predicted = c)
  / nullif(sum(n) FILTER (predicted = c) + sum(n) FILTER (actual = c), 0), 0) AS f1,
 CAST(sum(n) FILTER (actual = c) AS BIGINT) AS support FROM cm, classes GROUP BY c)"""


@query("confusion_matrix", SIDED + _GRID + "SELECT * FROM cm")
def confusion(spark, sf_dir):
    return E.confusion_matrix(test_side(spark, sf_dir), "energy_category", "pred_category", CLASSES)


@query("accuracy", SIDED + f"""SELECT side, count(*) AS records,
 {hu('avg(CAST(energy_category = pred_category AS DOUBLE))', 6)} AS accuracy FROM sided GROUP BY side""")
def accuracy(spark, sf_dir):
    scores = E.accuracy(sided(spark, sf_dir), "energy_category", "pred_category")
    return scores.withColumn("accuracy", half_up(F.col("accuracy"), 6))


def _digits(df, columns, digits=6):
    return df.withColumns({c: half_up(F.col(c), digits) for c in columns})


@query("per_class_prf", SIDED + _GRID + f"""SELECT class, {hu('precision', 6)} AS precision, {hu('recall', 6)} AS recall,
 {hu('f1', 6)} AS f1, support FROM scores""")
def per_class(spark, sf_dir):
    scores = E.per_class_scores(test_side(spark, sf_dir), "energy_category", "pred_category", CLASSES)
    return _digits(scores, ("precision", "recall", "f1"))


@query("weighted_prf", SIDED + _GRID + "SELECT " + ", ".join(
    hu(f"(sum({m} * support) / sum(support))", 6) + f" AS {m}" for m in ("precision", "recall", "f1")) + " FROM scores")
def weighted(spark, sf_dir):
    scores = E.per_class_scores(test_side(spark, sf_dir), "energy_category", "pred_category", CLASSES)
    return _digits(E.weighted_scores(scores), ("precision", "recall", "f1"))


@query("level_intervals", R + """SELECT 'temperature_level' AS attribute, temperature_level AS level,
 min(temperature_c) AS low, max(temperature_c) AS high FROM readings GROUP BY temperature_level
UNION ALL SELECT 'occupancy_level', occupancy_level, min(occupancy_pct), max(occupancy_pct) FROM readings
 GROUP BY occupancy_level""")
def level_intervals(spark, sf_dir):
    return L.level_intervals(readings(spark, sf_dir), READINGS)


@query("nearest_level", R + """
, levels AS (SELECT temperature_level AS level, min(temperature_c) AS low, max(temperature_c) AS high FROM readings
 GROUP BY temperature_level),
probes AS (SELECT reading_id, energy_consumption_kwh, humidity_pct / 3 + 0.05 AS value FROM readings),
near AS (SELECT reading_id, value, level, row_number() OVER (PARTITION BY reading_id, energy_consumption_kwh
 ORDER BY greatest(low - value, value - high, 0.0), level) AS i FROM probes, levels)
SELECT reading_id, value, level FROM near WHERE i = 1""")
def nearest_level(spark, sf_dir):
    rows = readings(spark, sf_dir)
    intervals = L.level_intervals(rows, READINGS).where("attribute = 'temperature_level'")
    probes = rows.select("reading_id", (F.col("humidity_pct") / 3 + 0.05).alias("value"))
    return L.with_nearest_level(probes, F.col("value"), intervals, "level")


@query("nearest_order", R + """
, ends AS (SELECT l_orderkey, min(l_extendedprice) / 500 AS low, max(l_extendedprice) / 500 AS high FROM lineitem GROUP BY l_orderkey),
named AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS level, low, high FROM ends WHERE high - low <= 1),
values AS (SELECT DISTINCT floor(energy_consumption_kwh * 10) / 10 AS value FROM readings),
near AS (SELECT value, level, row_number() OVER (PARTITION BY value
 ORDER BY greatest(low - value, value - high, 0.0), level) AS i FROM values, named)
SELECT value, level FROM near WHERE i = 1""")
def nearest_order(spark, sf_dir):
    """Levels in the thousands: the narrow price ranges of orders, and usage values inside and between them."""
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.min("l_extendedprice") / 500).alias("low"), (F.max("l_extendedprice") / 500).alias("high"))
    intervals = orders.where("high - low <= 1").select(F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("level"), "low", "high")
    values = readings(spark, sf_dir).select((F.floor(F.col("energy_consumption_kwh") * 10) / 10).alias("value")).distinct()
    return L.with_nearest_level(values, F.col("value"), intervals, "level")


def _ranges(features) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high,
 {hu(f'avg({c})', 1)} AS mean, CAST(floor(min({c})) AS BIGINT) AS slider_low,
 CAST(ceil(max({c})) AS BIGINT) AS slider_high FROM readings""" for c in features)


@query("feature_ranges", R + _ranges(READINGS.class_numeric))
def feature_ranges(spark, sf_dir):
    return L.feature_ranges(readings(spark, sf_dir), READINGS.class_numeric)


@query("feature_ranges_reg", R + _ranges(READINGS.regression_numeric))
def feature_ranges_reg(spark, sf_dir):
    return L.feature_ranges(readings(spark, sf_dir), READINGS.regression_numeric)


@query("floor_area_defaults", R + """SELECT building_type, CAST(median(floor_area_sqft) AS DOUBLE) AS floor_area_sqft
 FROM readings GROUP BY building_type""")
def floor_area_defaults(spark, sf_dir):
    return L.floor_area_defaults(readings(spark, sf_dir), READINGS)


@query("floor_area_filled", R + """, d AS (SELECT building_type, CAST(median(floor_area_sqft) AS DOUBLE) AS area
 FROM readings GROUP BY building_type)
SELECT reading_id, building_type, CASE WHEN reading_id % 5 = 0 THEN area ELSE CAST(floor_area_sqft AS DOUBLE) END
 AS floor_area_sqft FROM readings JOIN d USING (building_type)""")
def floor_area_filled(spark, sf_dir):
    rows = readings(spark, sf_dir)
    known = F.when(F.col("reading_id") % 5 != 0, F.col("floor_area_sqft").cast("double"))
    gaps = rows.select("reading_id", "building_type", known.alias("floor_area_sqft"))
    filled = L.with_floor_area(gaps, L.floor_area_defaults(rows, READINGS), READINGS)
    return filled.select("reading_id", "building_type", "floor_area_sqft")


# Records as they arrive from a form: every field is text, some are broken.
BROKEN = {
    "temperature_c": "CASE WHEN reading_id % 53 = 0 THEN 'NaN' ELSE CAST(temperature_c AS STRING) END",
    "humidity_pct": "CASE WHEN reading_id % 47 = 0 THEN 'abc' ELSE CAST(humidity_pct AS STRING) END",
    "occupancy_pct": "CASE WHEN reading_id % 43 = 0 THEN '101' ELSE CAST(occupancy_pct AS STRING) END",
    "hvac_usage_pct": "CASE WHEN reading_id % 71 = 0 THEN '-1' ELSE CAST(hvac_usage_pct AS STRING) END",
    "lighting_usage_pct": "CASE WHEN reading_id % 73 = 0 THEN NULL ELSE CAST(lighting_usage_pct AS STRING) END",
    "hour": "CASE WHEN reading_id % 41 = 0 THEN '24' ELSE CAST(hour AS STRING) END",
    "floor_area_sqft": "CASE WHEN reading_id % 67 = 0 THEN '0' ELSE CAST(floor_area_sqft AS STRING) END",
    "building_type": "CASE WHEN reading_id % 59 = 0 THEN 'Castle' WHEN reading_id % 61 = 0 THEN NULL ELSE building_type END",
    "temperature_level": "CASE WHEN reading_id % 79 = 0 THEN 'Tepid' ELSE temperature_level END",
    "occupancy_level": "occupancy_level",
}
_RECORDS = ", records AS (SELECT reading_id, " + ", ".join(f"{x} AS {c}" for c, x in BROKEN.items()) + " FROM readings)"
_PCT = ("humidity_pct", "occupancy_pct", "hvac_usage_pct", "lighting_usage_pct")


def _checks(numbers, area: bool) -> str:
    parts = []
    for c in numbers:
        parts.append(f"WHEN try_cast({c} AS DOUBLE) IS NULL THEN '''{c}'' must be a number.'")
        parts.append(f"WHEN NOT isfinite(try_cast({c} AS DOUBLE)) THEN '''{c}'' must be a finite number.'")
    if area:
        parts.append("WHEN CAST(floor_area_sqft AS DOUBLE) <= 0 THEN 'Floor area must be greater than 0.'")
    parts.append("WHEN CAST(hour AS DOUBLE) NOT BETWEEN 0 AND 23 THEN 'Hour must be between 0 and 23.'")
    parts += [f"WHEN CAST({c} AS DOUBLE) NOT BETWEEN 0 AND 100 THEN '''{c}'' must be between 0 and 100.'" for c in _PCT]
    return " ".join(parts)


_DOMAINS = ", domains AS (SELECT " + ", ".join(
    f"list(DISTINCT {c} ORDER BY {c}) AS d_{c}" for c in READINGS.class_categorical) + " FROM readings)"
_CLASS_ERROR = f"CASE {_checks(READINGS.class_numeric, False)} " + " ".join(
    f"WHEN {c} IS NULL OR NOT list_contains(d_{c}, {c}) THEN '''{c}'' must be one of: ' || array_to_string(d_{c}, ', ') || '.'"
    for c in READINGS.class_categorical) + " END"
_ENERGY_ERROR = f"""CASE {_checks(READINGS.regression_numeric, True)}
 WHEN building_type IS NULL OR NOT list_contains(d_building_type, building_type) THEN 'Unknown building type.' END"""


def records(rows):
    return rows.select("reading_id", *[F.expr(x).alias(c) for c, x in BROKEN.items()])


def domains(rows):
    return category_domains(rows, READINGS.class_categorical)


@query("validate_cls", R + _RECORDS + _DOMAINS + f"SELECT reading_id, {_CLASS_ERROR} AS error FROM records, domains")
def validate_cls(spark, sf_dir):
    rows = readings(spark, sf_dir)
    return validate(records(rows), class_input_check(domains(rows), READINGS)).select("reading_id", "error")


@query("validate_reg", R + _RECORDS + _DOMAINS + f"SELECT reading_id, {_ENERGY_ERROR} AS error FROM records, domains")
def validate_reg(spark, sf_dir):
    rows = readings(spark, sf_dir)
    return validate(records(rows), energy_input_check(domains(rows), READINGS)).select("reading_id", "error")


_ERRORS = ", errors AS (SELECT reading_id, hour, energy_consumption_kwh AS a, pred_kwh AS p, energy_consumption_kwh - pred_kwh AS e FROM test)"


@query("regression_metrics", SIDED + _ERRORS + f"""SELECT count(*) AS records, {hu('avg(abs(e))', 6)} AS mae,
 {hu('sqrt(avg(e * e))', 6)} AS rmse, {hu('(1 - avg(e * e) / var_pop(a))', 6)} AS r2 FROM errors""")
def regression_metrics(spark, sf_dir):
    metrics = E.regression_metrics(test_side(spark, sf_dir), "energy_consumption_kwh", "pred_kwh")
    return _digits(metrics, ("mae", "rmse", "r2"))


@query("residuals", SIDED + _ERRORS + f"SELECT reading_id, {hu('e', 6)} AS residual FROM errors")
def residuals(spark, sf_dir):
    rows = E.residuals(test_side(spark, sf_dir), "energy_consumption_kwh", "pred_kwh")
    return rows.select("reading_id", half_up(F.col("residual"), 6).alias("residual"))


@query("residual_histogram", SIDED + _ERRORS + f"""
, ends AS (SELECT min(e) AS lo, max(e) AS hi FROM errors),
bins AS (SELECT least(CAST(floor((e - lo) / ((hi - lo) / 20)) AS INT) + 1, 20) AS bin, count(*) AS n FROM errors, ends GROUP BY 1),
every AS (SELECT CAST(range AS INT) AS bin, lo + (range - 0.5) * ((hi - lo) / 20) AS mid FROM range(1, 21), ends)
SELECT bin, {hu('mid', 6)} AS midpoint, format('{{:.1f}}', mid) AS label, coalesce(n, 0) AS n FROM every LEFT JOIN bins USING (bin)""")
def residual_histogram(spark, sf_dir):
    rows = E.residuals(test_side(spark, sf_dir), "energy_consumption_kwh", "pred_kwh")
    return _digits(E.residual_histogram(rows), ("midpoint",))


@query("hourly_actual_pred", SIDED + _ERRORS + f"""SELECT hour, lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' AS label,
 {hu('avg(a)', 2)} AS actual, {hu('avg(p)', 2)} AS predicted FROM errors GROUP BY hour""")
def hourly_actual_pred(spark, sf_dir):
    return E.hourly_actual_predicted(test_side(spark, sf_dir), "energy_consumption_kwh", "pred_kwh", READINGS)


_POINTS = f""", points AS (SELECT reading_id, {hu('a', 2)} AS actual, {hu('p', 2)} AS predicted FROM errors
 ORDER BY {HASH}, reading_id, a LIMIT 500)"""


def _points(spark, sf_dir):
    return E.scatter_sample(test_side(spark, sf_dir), "energy_consumption_kwh", "pred_kwh",
                            ("reading_id", "energy_consumption_kwh"), order=order_hash()).drop("energy_consumption_kwh")


@query("scatter_sample", SIDED + _ERRORS + _POINTS + "SELECT * FROM points")
def scatter_sample(spark, sf_dir):
    return _points(spark, sf_dir)


@query("identity_bounds", SIDED + _ERRORS + _POINTS + """SELECT least(min(actual), min(predicted)) AS low,
 greatest(max(actual), max(predicted)) AS high FROM points""")
def identity_bounds(spark, sf_dir):
    return E.identity_bounds(_points(spark, sf_dir))


@query("score_energy", R + f""", p AS (SELECT reading_id, greatest(pred_kwh - 40, CAST(0 AS DOUBLE)) AS k FROM readings)
SELECT reading_id, {hu('k', 2)} AS energy_kwh, {hu('(k * CAST(8.5 AS DOUBLE))', 2)} AS cost_inr,
 {hu('(k * CAST(0.71 AS DOUBLE))', 2)} AS co2_kg FROM p""")
def score_energy(spark, sf_dir):
    """The formula part on a fixed prediction, low enough that some are clamped."""
    outputs = T.energy_outputs(F.col("pred_kwh") - 40)
    return readings(spark, sf_dir).select("reading_id", *[x.alias(c) for c, x in outputs.items()])


# The tree in SQL: the same bins, counts, gains and order of ties, one group of CTEs per level.
_NUMERIC, _CATEGORICAL = READINGS.class_numeric, READINGS.class_categorical
_DEPTH, _LEAF, _BINS = 6, 10, 256


def _entropy(parts) -> str:
    def n_log_n(n):
        return f"CASE WHEN {n} > 0 THEN ({n}) * ln(({n})::DOUBLE) ELSE 0 END"

    return f"({n_log_n(' + '.join(parts))} - " + " - ".join(n_log_n(p) for p in parts) + ")"


def _level_sql(d: int) -> str:
    cells = ", ".join([f"{{'f': {i}, 'bin': bin_{c}, 'cat': NULL::VARCHAR}}" for i, c in enumerate(_NUMERIC)]
                      + [f"{{'f': {len(_NUMERIC) + i}, 'bin': 0, 'cat': {c}}}" for i, c in enumerate(_CATEGORICAL)])
    number = f"f < {len(_NUMERIC)}"
    classes = range(len(CLASSES))
    left = [f"CASE WHEN {number} THEN p{c} ELSE w{c} - n{c} END" for c in classes]
    goes_left = "CASE " + " ".join(f"WHEN f = {i} THEN bin_{c} <= bin" for i, c in enumerate(_NUMERIC)) + " " + " ".join(
        f"WHEN f = {len(_NUMERIC) + i} THEN coalesce({c} <> cat, true)" for i, c in enumerate(_CATEGORICAL)) + " END"
    return f""",
cells{d} AS MATERIALIZED (SELECT node, cell.f AS f, cell.bin AS bin, cell.cat AS cat, {', '.join(f'count(*) FILTER (y = {c}) AS n{c}' for c in classes)}
 FROM (SELECT node, y, unnest([{cells}]) AS cell FROM at{d} WHERE side = 'train' AND depth = {d}) GROUP BY ALL),
sums{d} AS (SELECT *, {', '.join(f'sum(n{c}) OVER (PARTITION BY node, f)::BIGINT AS w{c}, sum(n{c}) OVER (PARTITION BY node, f ORDER BY bin ROWS UNBOUNDED PRECEDING)::BIGINT AS p{c}' for c in classes)}
 FROM cells{d}),
sides{d} AS (SELECT *, {', '.join(f'{x} AS l{c}' for c, x in enumerate(left))}, {', '.join(f'w{c} - ({x}) AS r{c}' for c, x in enumerate(left))} FROM sums{d}),
gains{d} AS (SELECT *, CAST(floor(({_entropy([f'w{c}' for c in classes])} - {_entropy([f'l{c}' for c in classes])} - {_entropy([f'r{c}' for c in classes])})
 / ({' + '.join(f'w{c}' for c in classes)}) / ln(2::DOUBLE) * 1e10 + 0.5) AS BIGINT) AS gain FROM sides{d}
 WHERE {' + '.join(f'l{c}' for c in classes)} >= {_LEAF} AND {' + '.join(f'r{c}' for c in classes)} >= {_LEAF} AND ({number} OR cat IS NOT NULL)),
best{d} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin, cat) AS i FROM gains{d}
 WHERE gain > 0) WHERE i = 1),
at{d + 1} AS MATERIALIZED (SELECT a.* EXCLUDE (node, depth), CASE WHEN b.node IS NULL THEN a.node WHEN {goes_left} THEN 2 * a.node + 1
  ELSE 2 * a.node + 2 END AS node, CASE WHEN b.node IS NULL THEN depth ELSE depth + 1 END AS depth
 FROM at{d} a LEFT JOIN best{d} b ON a.node = b.node AND a.depth = {d})"""


_TREE = R + f"""
, ranked AS (SELECT energy_category, {HASH} AS h, row_number() OVER (PARTITION BY energy_category ORDER BY {HASH}) AS i,
  count(*) OVER (PARTITION BY energy_category) AS n FROM readings),
sidecuts AS (SELECT energy_category, max(h) AS cut FROM ranked WHERE i <= round_even(n * 0.2, 0) GROUP BY energy_category),
sided AS MATERIALIZED (SELECT readings.*, CASE WHEN {HASH} <= cut THEN 'test' ELSE 'train' END AS side,
 array_position({sorted(CLASSES)}, energy_category) - 1 AS y FROM readings JOIN sidecuts USING (energy_category)),
""" + ", ".join(f"""cuts_{c} AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY v) - 1 AS bin FROM (SELECT DISTINCT v FROM (
  SELECT {c}::DOUBLE AS v, row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n FROM sided WHERE side = 'train')
  JOIN range(1, {_BINS}) AS k(k) ON i = (k * n + {_BINS - 1}) // {_BINS}))""" for c in _NUMERIC) + """,
at0 AS MATERIALIZED (SELECT sided.*, 0 AS node, 0 AS depth, """ + ", ".join(
    f"coalesce(cuts_{c}.bin, (SELECT count(*) FROM cuts_{c})) AS bin_{c}" for c in _NUMERIC) + " FROM sided " + " ".join(
    f"ASOF LEFT JOIN cuts_{c} ON sided.{c}::DOUBLE <= cuts_{c}.v" for c in _NUMERIC) + ")" + "".join(map(_level_sql, range(_DEPTH))) + f""",
counted AS (SELECT node, depth, {', '.join(f'count(*) FILTER (y = {c}) AS n{c}' for c in range(len(CLASSES)))}, count(*) AS n FROM (
""" + " UNION ALL ".join(f"SELECT node, depth, y FROM at{d} WHERE side = 'train' AND depth = {d}" for d in range(_DEPTH + 1)) + f""")
 GROUP BY ALL),
labelled AS (SELECT *, CASE {' '.join(f"WHEN n{c} >= greatest({', '.join(f'n{o}' for o in range(len(CLASSES)))}) THEN '{name}'" for c, name in enumerate(sorted(CLASSES)))} END AS label FROM counted),
splits AS (SELECT node, f, bin, cat, gain FROM ({' UNION ALL '.join(f'SELECT node, f, bin, cat, gain FROM best{d}' for d in range(_DEPTH))})),
named AS (SELECT l.*, {list(_NUMERIC + _CATEGORICAL)}[f + 1] AS feature, cat, gain, s.node IS NOT NULL AS inner_node,
 CASE """ + " ".join(f"WHEN f = {i} THEN (SELECT v FROM cuts_{c} q WHERE q.bin = s.bin)" for i, c in enumerate(_NUMERIC)) + """ END AS threshold
 FROM labelled l LEFT JOIN splits s USING (node))
"""


def _tree(spark, sf_dir):
    """Train and test sides by the hash that SQL can compute, and the tree of the train side."""
    needed = [*READINGS.key, *READINGS.regression_numeric, *_CATEGORICAL, READINGS.category]
    rows = readings(spark, sf_dir).select(*dict.fromkeys(needed))
    # the rows are written before they are split: the split reads two columns of them, the rest is a comparison per row
    sides = split_stratified(materialize(rows, "rows"), READINGS.key, READINGS.category, order=order_hash())
    return sides, fit_count_tree(sides.where("side = 'train'"), READINGS, _DEPTH, _LEAF, _BINS)


@query("dt_predictions", _TREE + f"""SELECT reading_id, energy_category, label AS predicted
FROM at{_DEPTH} a JOIN labelled USING (node) WHERE side = 'test'""")
def dt_predictions(spark, sf_dir):
    sides, tree = _tree(spark, sf_dir)
    return tree.predict(sides.where("side = 'test'")).select("reading_id", "energy_category", "predicted")


@query("dt_importance", _TREE + f"""SELECT feature, {hu('(coalesce(sum(gain * n), 0) / (SELECT sum(gain * n) FROM named WHERE inner_node))', 4)} AS importance
FROM (SELECT unnest({list(_NUMERIC + _CATEGORICAL)}) AS feature) LEFT JOIN (SELECT * FROM named WHERE inner_node) USING (feature) GROUP BY feature""")
def dt_importance(spark, sf_dir):
    return _tree(spark, sf_dir)[1].importance(spark)


@query("tree_nodes", _TREE + f""", shown AS (SELECT *, inner_node AND depth < {TREE_VIEW_DEPTH} AS open FROM named WHERE depth <= {TREE_VIEW_DEPTH})
SELECT c.node AS node_id, CASE WHEN c.node > 0 THEN (c.node - 1) // 2 END AS parent_id,
 CASE WHEN c.node > 0 THEN CASE WHEN (c.node % 2 = 1) = (p.cat IS NULL) THEN 'yes' ELSE 'no' END END AS branch, c.depth,
 CASE WHEN c.open THEN CASE WHEN c.cat IS NULL THEN c.feature || ' ≤ ' || format('{{:.2f}}', c.threshold) ELSE c.feature || ' = ' || c.cat END END AS split,
 CASE WHEN c.open THEN c.feature END AS split_feature, CASE WHEN c.open THEN c.cat END AS split_value,
 CASE WHEN c.open THEN c.threshold END AS threshold, c.n AS samples, c.label,
 {hu('(' + _entropy([f'c.n{c}' for c in range(len(CLASSES))]) + ' / c.n / ln(2::DOUBLE))', 3)} AS entropy, c.inner_node AND NOT c.open AS truncated
FROM shown c LEFT JOIN shown p ON p.node = (c.node - 1) // 2 AND c.node > 0""")
def tree_nodes(spark, sf_dir):
    return _tree(spark, sf_dir)[1].rows(spark)


@query("model_store", R + """SELECT a.attempt, a.reused, (SELECT count(*) FROM readings) AS records
FROM (VALUES (1, false), (2, true), (3, false)) AS a(attempt, reused)""")
def model_store(spark, sf_dir):
    """A first fit, one on the same data in another order, and one in which a value has changed."""
    columns = ["reading_id", *READINGS.class_numeric, *READINGS.class_categorical, READINGS.category]
    data = materialize(readings(spark, sf_dir).select(*columns), "train")
    moved = data.repartition(*columns)
    changed = data.withColumn("humidity_pct", F.col("humidity_pct") + F.when(F.col("hour") == 0, 1).otherwise(0))
    path, depth = scratch_dir(spark, "model"), {"max_depth": 3}
    rows = []
    for attempt, frame in enumerate((data, moved, changed), start=1):
        stored = fit_or_load(spark, path, frame, depth, lambda df: T.fit_tree(df, READINGS, **depth))
        rows.append((attempt, stored.reused, T.predict_category(frame, stored.model).count()))
    return spark.createDataFrame(rows, "attempt int, reused boolean, records long")


_SHARES = ", ".join(f"n{sorted(CLASSES).index(c)} / n AS p_{c.lower()}" for c in CLASSES)
_SCORES = _TREE + _RECORDS + _DOMAINS + f""",
checked AS (SELECT reading_id, floor_area_sqft, {_CLASS_ERROR} AS error FROM records, domains),
scored AS (SELECT reading_id, label, greatest(n0, n1, n2) / n AS confidence, {_SHARES} FROM at{_DEPTH} JOIN labelled USING (node))
"""


@query("score_category", _SCORES + """SELECT DISTINCT c.reading_id, error, CASE WHEN error IS NULL THEN label END AS predicted, """
       + ", ".join(f"CASE WHEN error IS NULL THEN {hu(x, 9)} END AS {x}" for x in ("confidence", *[f"p_{c.lower()}" for c in CLASSES]))
       + " FROM checked c JOIN scored s USING (reading_id)")
def score_category(spark, sf_dir):
    """All records: prediction, confidence and class shares, or the rule a record breaks."""
    sides, tree = _tree(spark, sf_dir)
    scored = classify_records(records(sides), tree, domains(sides), READINGS.key, READINGS)
    return _digits(scored, ("confidence", *[f"p_{c.lower()}" for c in CLASSES]), 9).distinct()


def _forest(spark, sf_dir):
    needed = [*READINGS.key, *READINGS.regression_numeric, *READINGS.class_categorical, READINGS.measure]
    rows = readings(spark, sf_dir).select(*dict.fromkeys(needed))
    # dealt out evenly: a row passes 120 trees, so one large file must not be one task
    sides = materialize(dealt(split_random(rows, READINGS.key)), "sides")
    return sides, T.fit_forest(sides.where("side = 'train'"), READINGS)


@query("rf_predictions")
def rf_predictions(spark, sf_dir):
    sides, model = _forest(spark, sf_dir)
    scored = T.predict_energy(sides.where("side = 'test'"), model)
    return scored.select("reading_id", "energy_consumption_kwh", "predicted")


@query("rf_importance")
def rf_importance(spark, sf_dir):
    return T.importance(_forest(spark, sf_dir)[1])


@query("score_energy_model")
def score_energy_model(spark, sf_dir):
    """All records: energy, cost and emissions from the fitted forest, or the rule a record breaks."""
    sides, model = _forest(spark, sf_dir)
    return predict_records(records(sides), model, domains(sides), READINGS.key, READINGS)
