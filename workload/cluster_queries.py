"""K-Means profiles: everything around the fit against fixed centers, then the fit itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.functions.numbers import half_up
from wattframe.operators import clusters as K
from wattframe.plans.clustering import cluster_profiles, scaled_rows, stored_profiles, z_columns
from wattframe.plans.clustering import k_sweep as sweep
from wattframe.session import materialize, scratch_dir
from workload.model_queries import HASH, order_hash
from workload.readings import READINGS, duckdb_cte, readings
from workload.registry import half_up_sql as hu
from workload.registry import query

COLUMNS = READINGS.cluster_numeric
Z = z_columns(READINGS)
# Centers on the z-scale, deliberately not in order of energy.
CENTERS = [
    [0.3, 0.1, 0.2, -0.1, 0.1],
    [-0.4, -0.9, -0.6, 0.0, -1.0],
    [0.5, 1.0, 0.3, 0.1, 1.1],
]


def _distance(prefix_a: str, prefix_b: str) -> str:
    return " + ".join(f"({prefix_a}{c} - {prefix_b}{c}) * ({prefix_a}{c} - {prefix_b}{c})" for c in COLUMNS)


R = duckdb_cte() + ", stats AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in COLUMNS) + " FROM readings), scaled AS (SELECT readings.*, " + ", ".join(
    f"({c} - m_{c}) / s_{c} AS z_{c}" for c in COLUMNS) + """ FROM readings, stats),
centers(cluster, """ + ", ".join(f"k_{c}" for c in COLUMNS) + ") AS (VALUES " + ", ".join(
    f"({i}, " + ", ".join(f"CAST({x} AS DOUBLE)" for x in c) + ")" for i, c in enumerate(CENTERS)) + f"""),
near AS (SELECT scaled.*, cluster, {_distance('z_', 'k_')} AS d FROM scaled, centers),
assigned AS (SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY reading_id, energy_consumption_kwh
 ORDER BY d, cluster) AS i FROM near) WHERE i = 1),
numbers AS (SELECT cluster, avg(energy_consumption_kwh) AS mean,
 row_number() OVER (ORDER BY avg(energy_consumption_kwh)) AS number FROM assigned GROUP BY cluster)
"""


def _scaled(spark, sf_dir):
    return scaled_rows(readings(spark, sf_dir), READINGS)


def _assigned(spark, sf_dir):
    return K.assign_centers(_scaled(spark, sf_dir), Z, CENTERS)


def _numbered(spark, sf_dir):
    return K.renumber(materialize(_assigned(spark, sf_dir), "assigned"), CENTERS, READINGS.measure)


@query("assign_fixed_centers", R + f"SELECT reading_id, cluster, {hu('d', 4)} AS distance2 FROM assigned")
def assign_fixed_centers(spark, sf_dir):
    return _assigned(spark, sf_dir).select(
        "reading_id", "cluster", half_up(F.col("distance2"), 4).alias("distance2"))


@query("cluster_renumber", R + f"SELECT cluster, CAST(number AS INT) AS number, {hu('mean', 4)} AS mean FROM numbers")
def cluster_renumber(spark, sf_dir):
    numbers = K.renumbering(_assigned(spark, sf_dir), READINGS.measure)
    return numbers.withColumn("mean", half_up(F.col("mean"), 4))


@query("cluster_inertia", R + f"SELECT {hu('sum(d)', 1)} AS inertia FROM assigned")
def cluster_inertia(spark, sf_dir):
    return K.inertia(_assigned(spark, sf_dir))


@query("silhouette_sampled", R + f"""
, chosen AS (SELECT row_number() OVER () AS row, cluster, {', '.join(Z)} FROM (
  SELECT * FROM assigned ORDER BY {HASH}, reading_id, energy_consumption_kwh LIMIT 3000)),
pairs AS (SELECT x.row, x.cluster AS own, y.cluster AS other, x.row = y.row AS self,
 sqrt({' + '.join(f'(x.{c} - y.{c}) * (x.{c} - y.{c})' for c in Z)}) AS d FROM chosen x, chosen y),
sums AS (SELECT row, own, other, sum(d) AS d, count(*) AS n FROM pairs GROUP BY ALL),
ab AS (SELECT row, max(n) FILTER (own = other) AS size, max(d / nullif(n - 1, 0)) FILTER (own = other) AS a,
 min(d / n) FILTER (own <> other) AS b FROM sums GROUP BY row)
SELECT count(*) AS sampled, {hu('avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)', 3)} AS silhouette FROM ab""")
def silhouette_sampled(spark, sf_dir):
    key = ("reading_id", READINGS.measure)
    return K.silhouette_sampled(_assigned(spark, sf_dir), Z, key, range(len(CENTERS)), order=order_hash())


_DESCRIBED = ", described AS (SELECT number, cluster, CASE WHEN k_energy_consumption_kwh >= 0.5 THEN 'High' " \
    "WHEN k_energy_consumption_kwh <= -0.5 THEN 'Low' ELSE 'Medium' END AS tier, list_filter([" + ", ".join(
        f"CASE WHEN k_{c} >= 0.5 THEN 'high {K.FRIENDLY_NAMES[c]}' WHEN k_{c} <= -0.5 THEN 'low {K.FRIENDLY_NAMES[c]}' END"
        for c in COLUMNS) + "], lambda x: x IS NOT NULL) AS parts FROM numbers JOIN centers USING (cluster))" + f"""
, named AS (SELECT number, cluster, 'Cluster ' || number || ' (' || tier || ' energy)' AS name,
 CASE WHEN len(parts) = 0 THEN '{K.UNREMARKABLE}' ELSE upper(array_to_string(parts, ', ')[1])
  || lower(array_to_string(parts, ', ')[2:]) END AS description FROM described)"""


@query("cluster_profile", R + _DESCRIBED + f"""SELECT CAST(number AS INT) AS cluster, name, count(*) AS size,
 {hu('(100.0 * count(*) / (SELECT count(*) FROM assigned))', 1)} AS percent,
 {hu('avg(energy_consumption_kwh)', 2)} AS avg_energy, {hu('avg(occupancy_pct)', 1)} AS avg_occupancy,
 {hu('avg(hvac_usage_pct)', 1)} AS avg_hvac, {hu('avg(lighting_usage_pct)', 1)} AS avg_lighting,
 {hu('avg(temperature_c)', 1)} AS avg_temperature, description
 FROM assigned JOIN named USING (cluster) GROUP BY number, name, description""")
def cluster_profile(spark, sf_dir):
    numbered, centers = _numbered(spark, sf_dir)
    return K.cluster_profile(numbered, centers, roles=READINGS)


@query("cluster_tiers", R + _DESCRIBED + "SELECT CAST(number AS INT) AS cluster, name FROM named")
def cluster_tiers(spark, sf_dir):
    numbered, centers = _numbered(spark, sf_dir)
    return K.center_rows(numbered, COLUMNS, centers, READINGS).select("cluster", "name")


@query("cluster_describe", R + _DESCRIBED + "SELECT CAST(number AS INT) AS cluster, description FROM named")
def cluster_describe(spark, sf_dir):
    numbered, centers = _numbered(spark, sf_dir)
    return K.center_rows(numbered, COLUMNS, centers, READINGS).select("cluster", "description")


@query("kmeans_assign")
def kmeans_assign(spark, sf_dir):
    return cluster_profiles(readings(spark, sf_dir), READINGS).numbered.select("reading_id", "cluster", "distance2")


SQUARINGS = 12


def _principal(components: int = 2) -> str:
    """Principal components in SQL. A matrix squared again and again tends to the outer product of its first
    eigenvector with itself; taken away from the matrix, the next one comes first."""
    pairs = [(i, j) for i in range(len(Z)) for j in range(len(Z))]
    sql = f"""
, m1 AS MATERIALIZED (SELECT unnest({[i for i, _ in pairs]}) AS i, unnest({[j for _, j in pairs]}) AS j,
 unnest([{', '.join(f'covar_pop({Z[i]}, {Z[j]})' for i, j in pairs)}]) AS v FROM scaled)"""
    for c in range(1, components + 1):
        sql += f", p{c}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM m{c} WHERE i = j) AS v FROM m{c})"
        for n in range(SQUARINGS):
            sql += f""",
q{c}_{n} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{c}_{n} a JOIN p{c}_{n} b ON a.j = b.i GROUP BY ALL),
p{c}_{n + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM q{c}_{n} WHERE i = j) AS v FROM q{c}_{n})"""
        last = f"p{c}_{SQUARINGS}"
        # the row of the largest diagonal element has the largest loading, with a plus
        sql += f""",
e{c} AS MATERIALIZED (SELECT j AS i, v / sqrt(max(CASE WHEN i = j THEN v END) OVER ()) AS w FROM {last}
 WHERE i = (SELECT i FROM {last} WHERE i = j ORDER BY v DESC LIMIT 1)),
l{c} AS MATERIALIZED (SELECT sum(v * a.w * b.w) AS value FROM m{c} m JOIN e{c} a ON a.i = m.i JOIN e{c} b ON b.i = m.j),
m{c + 1} AS MATERIALIZED (SELECT m.i, m.j, v - value * a.w * b.w AS v FROM m{c} m JOIN e{c} a ON a.i = m.i JOIN e{c} b ON b.i = m.j, l{c})"""
    return sql


def _loading(c: int, n: int) -> str:
    return f"(SELECT w FROM e{c} WHERE i = {n})"


@query("pca_variance", R + _principal() + " " + " UNION ALL ".join(
    f"SELECT {c} AS component, floor((SELECT value FROM l{c}) / (SELECT sum(v) FROM m1 WHERE i = j) * 1000 + 0.5) / 10 AS explained_pct, "
    + ", ".join(f"{hu(_loading(c, n), 6)} AS {z}" for n, z in enumerate(Z)) for c in (1, 2)))
def pca_variance(spark, sf_dir):
    scaled = _scaled(spark, sf_dir)
    found = K.pca_variance(scaled, K.fit_projection(scaled, Z))
    return found.withColumns({z: half_up(F.col(z), 6) for z in Z})


def _score(c: int) -> str:
    return hu("(" + " + ".join(f"{z} * {_loading(c, n)}" for n, z in enumerate(Z)) + ")", 3)


@query("pca_scatter", R + _principal() + f""" SELECT reading_id, cluster, {_score(1)} AS x, {_score(2)} AS y
 FROM assigned ORDER BY {HASH}, reading_id, energy_consumption_kwh LIMIT 900""")
def pca_scatter(spark, sf_dir):
    assigned = materialize(_assigned(spark, sf_dir), "assigned")
    key = ("reading_id", READINGS.measure)
    return K.pca_scatter(assigned, K.fit_projection(assigned, Z), key, order=order_hash()).drop(READINGS.measure)


# Loadings of two fixed components, for the part of the scatter that SQL can check.
LOADINGS = [[0.3, 0.6, 0.5, 0.2, 0.5], [0.7, -0.4, 0.1, 0.5, -0.2]]


def _component(loading) -> str:
    return " + ".join(f"z_{c} * CAST({w} AS DOUBLE)" for c, w in zip(COLUMNS, loading, strict=True))


@query("projected_scatter", R + f"""SELECT reading_id, cluster, {hu(f'({_component(LOADINGS[0])})', 3)} AS x,
 {hu(f'({_component(LOADINGS[1])})', 3)} AS y FROM assigned ORDER BY {HASH}, reading_id, energy_consumption_kwh LIMIT 900""")
def projected_scatter(spark, sf_dir):
    projection = K.Projection(tuple(Z), LOADINGS, [])
    key = ("reading_id", READINGS.measure)
    return K.pca_scatter(_assigned(spark, sf_dir), projection, key, order=order_hash()).drop(READINGS.measure)


LLOYD_ROUNDS = 8


def _lloyd() -> str:
    """The rounds of K-Means from CENTERS in SQL, on coordinates in the same units."""
    xs = [f"x{j}" for j in range(len(Z))]
    squares = " + ".join(f"(x{j} / {float(K.GRID)} - k.k_{c}) * (x{j} / {float(K.GRID)} - k.k_{c})" for j, c in enumerate(COLUMNS))
    sql = ", points AS MATERIALIZED (SELECT row_number() OVER () AS id, " + ", ".join(
        f"CAST(round({z} * {K.GRID}) AS BIGINT) AS {x}" for x, z in zip(xs, Z, strict=True)) + """ FROM scaled),
c0 AS MATERIALIZED (SELECT * FROM centers)"""
    for n in range(LLOYD_ROUNDS + 1):
        sql += f""",
a{n} AS MATERIALIZED (SELECT id, min(struct_pack(d := {squares}, cluster := cluster)) AS near FROM points, c{n} k GROUP BY id)"""
        if n < LLOYD_ROUNDS:
            sql += f""",
c{n + 1} AS MATERIALIZED (SELECT k.cluster, {', '.join(f'coalesce(s.{c}, k.k_{c}) AS k_{c}' for c in COLUMNS)} FROM c{n} k LEFT JOIN (
  SELECT near.cluster AS cluster, {', '.join(f'sum({x}) / {float(K.GRID)} / count(*) AS {c}' for x, c in zip(xs, COLUMNS, strict=True))}
  FROM a{n} JOIN points USING (id) GROUP BY ALL) s USING (cluster))"""
    last = LLOYD_ROUNDS
    return sql + f""" SELECT cluster, (SELECT count(*) FROM a{last} WHERE near.cluster = k.cluster) AS records,
 {', '.join(f"{hu(f'k_{c}', 4)} AS {c}" for c in COLUMNS)}, (SELECT {hu('sum(near.d)', 1)} FROM a{last}) AS cost FROM c{last} k"""


@query("kmeans_from_centers", R + _lloyd())
def kmeans_from_centers(spark, sf_dir):
    """(cluster, records, center, cost of all) after a fixed number of rounds from given centers."""
    scaled = materialize(_scaled(spark, sf_dir).select(*READINGS.key, *Z), "scaled")
    fit = K.fit_from_centers(scaled, Z, CENTERS, LLOYD_ROUNDS, tolerance=0.0)
    rows = [(i, *center, fit.cost) for i, center in enumerate(fit.centers)]
    found = spark.createDataFrame(rows, "cluster int, " + ", ".join(f"{c} double" for c in COLUMNS) + ", cost double")
    records = K.assign_centers(scaled, Z, fit.centers).groupBy("cluster").agg(F.count(F.lit(1)).alias("records"))
    rounded = [half_up(F.col(c), 4).alias(c) for c in COLUMNS] + [half_up(F.col("cost"), 1).alias("cost")]
    return found.join(F.broadcast(records), "cluster", "left").select("cluster", F.coalesce("records", F.lit(0)).alias("records"), *rounded)


@query("k_sweep")
def k_sweep(spark, sf_dir):
    return sweep(readings(spark, sf_dir), READINGS)


@query("profiles_store", duckdb_cte() + """SELECT a.attempt, a.k, a.reused, (SELECT count(*) FROM readings) AS records, a.k AS clusters
FROM (VALUES (1, 3, false), (2, 3, true), (3, 2, false), (4, 3, false)) AS a(attempt, k, reused)""")
def profiles_store(spark, sf_dir):
    """A first run, the same data in another order, another k, and data in which a value has changed."""
    data = materialize(readings(spark, sf_dir).select(*READINGS.key, *COLUMNS), "profiled")
    changed = data.withColumn("temperature_c", F.col("temperature_c") + F.when(F.col("reading_id") % 1000 == 0, 1).otherwise(0))
    path, rows = scratch_dir(spark, "profiles"), []
    for attempt, (frame, k) in enumerate(((data, 3), (data.repartition(*data.columns), 3), (data, 2), (changed, 3)), start=1):
        stored = stored_profiles(spark, path, frame, READINGS, k, restarts=1)
        rows.append((attempt, k, stored.reused, stored.reports["summary"].first()["records"], stored.reports["profile"].count()))
    return spark.createDataFrame(rows, "attempt int, k int, reused boolean, records long, clusters long")
