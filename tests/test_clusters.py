import math

import numpy as np
import pytest
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import functions as F

from wattframe.errors import ArgumentError
from wattframe.operators import clusters as K
from wattframe.plans.clustering import cluster_profiles, scaled_rows, z_columns
from workload import cluster_queries
from workload.readings import READINGS

KEY = ("reading_id", "energy_consumption_kwh")
Z = z_columns(READINGS)


@pytest.fixture(scope="module")
def scaled(readings):
    return scaled_rows(readings, READINGS).cache()


@pytest.fixture(scope="module")
def matrix(scaled):
    return np.array([list(r) for r in scaled.select(*Z).collect()])


def test_best_of_several_starts(scaled):
    fit = K.fit_kmeans(scaled, Z, 3, restarts=4)
    assert fit.cost == min(fit.costs) and len(fit.costs) == 4
    assigned = K.assign_centers(scaled, Z, fit.centers)
    assert assigned.agg(F.sum("distance2")).first()[0] == pytest.approx(fit.cost, rel=1e-6)


def lloyd(rows, centers, rounds=300):
    """Plain iteration from given centers."""
    for _ in range(rounds):
        near = ((rows[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([rows[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centers)])
        shift = ((moved - centers) ** 2).sum()
        centers = moved
        if shift <= K.TOLERANCE:
            break
    return centers, ((rows[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_all_starts_of_all_k_match_plain_iteration(scaled, matrix):
    fits = K.fit_all_kmeans(scaled, Z, restarts=3)
    rows = np.round(matrix * K.GRID) / K.GRID
    first = scaled.select(*[F.round(F.col(c) * K.GRID).cast("bigint").alias(f"x{j}") for j, c in enumerate(Z)])
    names = first.columns
    seeds = first.orderBy(F.xxhash64(*names, F.lit(42)), *names).limit(K.SEED_ROWS).collect()
    seeds = np.array([list(r) for r in seeds], float) / K.GRID
    assert sorted(fits) == [2, 3, 4, 5]
    for k, fit in fits.items():
        plain = [lloyd(rows, K._first_centers(seeds, k, 42 + start)) for start in range(3)]
        assert fit.costs == pytest.approx([cost for _, cost in plain], rel=1e-9)
        assert np.allclose(fit.centers, min(plain, key=lambda p: p[1])[0])
    assert fits[2].cost > fits[3].cost > fits[4].cost > fits[5].cost


def test_fits_do_not_depend_on_partitions(scaled):
    fits = [K.fit_all_kmeans(scaled.repartition(n, "z_temperature_c"), Z, (2, 5), restarts=1) for n in (1, 4, 8)]
    assert fits[0] == fits[1] == fits[2]


def test_fewer_points_than_clusters_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 5 + [(3.0, 2.0)] * 4 + [(None, 1.0)], "a double, b double")
    fit = K.fit_kmeans(df, ["a", "b"], 5, restarts=2)
    assert fit.cost == 0 and len(fit.centers) == 5 and sorted(set(map(tuple, fit.centers))) == [(1.0, 2.0), (3.0, 2.0)]
    with pytest.raises(ArgumentError):
        K.fit_kmeans(df.limit(0), ["a", "b"], 2)


def test_profiles_are_numbered_by_energy(readings):
    found = cluster_profiles(readings, READINGS, k="3", restarts=2)
    rows = found.reports["profile"].orderBy("cluster").collect()
    assert [r["cluster"] for r in rows] == [1, 2, 3]
    assert [r["avg_energy"] for r in rows] == sorted(r["avg_energy"] for r in rows)
    assert sum(r["size"] for r in rows) == readings.count()
    assert sum(r["percent"] for r in rows) == pytest.approx(100, abs=0.3)
    assert rows[0]["name"] == "Cluster 1 (Low energy)"
    assert found.reports["silhouette"].first()["sampled"] == 3000
    summary = found.reports["summary"].first()
    assert summary["k"] == found.k and summary["records"] == found.numbered.count()
    assert summary["inertia"] == pytest.approx(found.numbered.agg(F.sum("distance2")).first()[0], abs=0.051)
    assert summary["inertia"] == pytest.approx(found.fit.cost, rel=1e-4)
    scatter = found.reports["scatter"]
    assert scatter.count() == 900
    assert 30 < found.reports["variance"].agg(F.sum("explained_pct")).first()[0] < 100


def test_numbers_do_not_depend_on_the_order_of_centers(scaled):
    centers = K.fit_kmeans(scaled, Z, 3, restarts=1).centers
    results = []
    for order in ([0, 1, 2], [2, 0, 1], [1, 2, 0]):
        moved = [centers[i] for i in order]
        numbered, ordered = K.renumber(K.assign_centers(scaled, Z, moved), moved, READINGS.measure)
        results.append((sorted(map(tuple, numbered.select(*KEY, "cluster").collect())), ordered))
    assert results[0] == results[1] == results[2]


def test_projection_matches_eigenvectors(scaled, matrix):
    projection = K.fit_projection(scaled, Z)
    values, vectors = np.linalg.eigh(np.cov(matrix.T))
    order = np.argsort(values)[::-1]
    for j, loading in enumerate(projection.loadings):
        expected = vectors[:, order[j]]
        expected = expected * np.sign(expected[np.argmax(np.abs(expected))])
        assert np.allclose(loading, expected, atol=1e-6)
        assert projection.explained[j] == pytest.approx(100 * values[order[j]] / values.sum(), abs=0.051)


def brute_silhouette(points, labels):
    scores = []
    for i, p in enumerate(points):
        distances = np.sqrt(((points - p) ** 2).sum(axis=1))
        own = labels == labels[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = distances[own].sum() / (own.sum() - 1)
        b = min(distances[labels == c].mean() for c in set(labels) if c != labels[i])
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(80, 2)) + np.repeat([[0, 0], [4, 1]], 40, axis=0)
    points[7] = points[8]  # a repeated point
    labels = np.array([0] * 40 + [1] * 39 + [2])  # one cluster of a single row
    rows = [(i, float(x), float(y), int(c)) for i, ((x, y), c) in enumerate(zip(points, labels, strict=True))]
    df = spark.createDataFrame(rows, "id long, x double, y double, cluster int")
    row = K.silhouette_sampled(df, ["x", "y"], ["id"], range(3), rows=100).first()
    assert row["sampled"] == 80
    assert row["silhouette"] == pytest.approx(brute_silhouette(points, labels), abs=6e-4)


def test_tier_and_description(spark):
    centers = [[0.5, -0.5, 0.0, 0.49, 0.5], [0.0] * 5, [0.0, 0.0, 1.0, 0.0, -0.6]]
    rows = K.center_rows(spark.range(1), READINGS.cluster_numeric, centers).orderBy("cluster").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("Cluster 1 (High energy)", "High temperature, low occupancy, high energy"),
        ("Cluster 2 (Medium energy)", "Close to the campus average on all features"),
        ("Cluster 3 (Low energy)", "High hvac usage, low energy"),
    ]


@pytest.mark.parametrize("k", ["1", 6, None, "x"])
def test_allowed_k(k):
    with pytest.raises(ArgumentError, match="K must be 2, 3, 4 or 5"):
        K.check_k(k)


def test_fit_from_given_centers(spark):
    rows = [(float(x), float(y)) for x in (0, 1, 10, 11) for y in (0, 1)] + [(None, 5.0)]
    table = spark.createDataFrame(rows, "a double, b double")
    fit = K.fit_from_centers(table, ["a", "b"], [[0.0, 0.0], [5.0, 9.0], [500.0, 0.0]])
    # the third is nearest to no row and stays
    assert fit.centers == [[0.5, 0.5], [10.5, 0.5], [500.0, 0.0]] and fit.cost == pytest.approx(4.0)
    assert K.fit_from_centers(table, ["a", "b"], [[3.0, 0.0]], max_iterations=0).centers == [[3.0, 0.0]]
    empty = K.fit_from_centers(table.limit(0), ["a", "b"], [[3.0, 0.0]])
    assert (empty.centers, empty.cost) == ([[3.0, 0.0]], 0.0)


def test_nearest_centers_by_products_are_those_by_distances():
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (2, 500)).astype(float)  # many points lie halfway between centers
    centers = np.array([[1, 0], [-1, 0], [0, 1], [0, 1], [2.5, -1], [1e9, 0], [0.1, 0.2]])
    sizes = (2, 4, 1)
    hot, start = K._nearest(x, centers, sizes), 0
    for size in sizes:
        own = centers[start:start + size]
        wanted = np.array([K._direct(x, c) for c in own]).argmin(axis=0)
        assert (hot[start:start + size].argmax(axis=0) == wanted).all()
        assert (hot[start:start + size].sum(axis=0) == 1).all()
        start += size


def test_sums_of_large_whole_numbers_are_exact(spark):
    far = 2**30
    points = spark.range(5000).selectExpr(f"{far * K.GRID} + id AS x0", "id AS x1")
    counted = K._cell_sums(K._blocks(points), 2, {4: np.array([[0.0, 0.0], [float(far), 0.0]]), 7: np.array([[1.0, 1.0]])})
    n, total = counted[4]
    assert n.tolist() == [0, 5000] and counted[7][0].tolist() == [5000]
    assert total[1].tolist() == counted[7][1][0].tolist() == [(5000 * far * K.GRID + 4999 * 2500) / K.GRID, 4999 * 2500 / K.GRID]


class Seen(Exception):
    pass


def test_stored_profiles_are_tried_on_another_order_without_a_fixed_number_of_tasks(spark, sf_dir, monkeypatch):
    data = spark.range(3).selectExpr("id AS reading_id", *[f"1D AS {c}" for c in cluster_queries.COLUMNS])
    monkeypatch.setattr(cluster_queries, "readings", lambda *_: data)
    frames = []

    def seen(spark, path, frame, *rest, **named):
        frames.append(frame)
        if len(frames) == 2:
            raise Seen
        return type("Stored", (), {"reused": False, "reports": {"summary": data.selectExpr("3L AS records"), "profile": data}})

    monkeypatch.setattr(cluster_queries, "stored_profiles", seen)
    with pytest.raises(Seen):
        cluster_queries.profiles_store(spark, sf_dir)
    assert "REPARTITION_BY_COL" in frames[1]._jdf.queryExecution().executedPlan().toString()


def test_whole_numbers_are_those_of_round(spark):
    values = [0.5, -0.5, 1.5, -2.5, 0.49999999999999994, -0.49999999999999994, 2.0**52 + 0.5, -(2.0**60), 1e18, 3.2, -3.7, 0.0, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        K._whole(F.col("v")).alias("ours"), F.round("v").cast("bigint").alias("wanted")).collect()
    assert [r["ours"] for r in rows] == [r["wanted"] for r in rows] and rows[3]["ours"] == -3


def test_blocks_are_narrow_and_know_their_squares(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 100)
    for far, size in ((1, 4), (2**40, 8)):
        points = spark.range(250).selectExpr(f"(id - 100) * {far} AS x0", "id AS x1")
        rows = K._blocks(points).collect()
        assert sum(r["n"] for r in rows) == 250 and all(len(r["data"]) == size * 2 * r["n"] for r in rows)
        assert sum(int(r["q0"]) for r in rows) == far**2 * sum((i - 100) ** 2 for i in range(250))
        assert max(r["longest"] for r in rows) >= (149**2 * far**2 + 249**2) / K.GRID**2


def test_rounds_get_few_blocks_at_once_and_leave_the_session_as_it_was(spark, monkeypatch):
    seen, name, blocks = [], "spark.sql.execution.arrow.maxRecordsPerBatch", K._blocks(spark.range(9).selectExpr("id AS x0"))
    before, collect = spark.conf.get(name), type(blocks).collect
    monkeypatch.setattr(type(blocks), "collect", lambda df: (seen.append(spark.conf.get(name)), collect(df))[1])
    K._cell_sums(blocks, 1, {0: np.array([[1.0]])})
    assert seen[-1] == str(K.BATCH) and spark.conf.get(name) == before


def test_projection_is_that_of_the_library_and_needs_whole_rows(spark):
    table = spark.range(400).selectExpr("id", "hash(id) % 100 / 10D AS a", "hash(id, 1) % 50 / 9D AS b").selectExpr("a", "b", "2 * a - b + hash(id) % 7 AS c")
    found = K.fit_projection(table, ["a", "b", "c"])
    model = PCA(k=2, inputCol="f", outputCol="p").fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(table))
    for j, loading in enumerate(found.loadings):
        wanted = model.pc.toArray()[:, j]
        assert loading == pytest.approx(wanted * np.sign(wanted[np.abs(wanted).argmax()]), abs=1e-9)
    assert found.explained == [math.floor(v * 1000 + 0.5) / 10 for v in model.explainedVariance.toArray()]
    with pytest.raises(ArgumentError, match="all numbers"):
        K.fit_projection(table.selectExpr("nullif(a, 1) AS a", "if(b > 1, b, null) AS b"), ["a", "b"])
