"""K-Means usage profiles: fit, number, describe, judge and project."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.errors import ArgumentError
from wattframe.functions.labels import sentence_case
from wattframe.functions.numbers import half_up
from wattframe.operators.evaluation import sample_rows
from wattframe.roles import METERED, Roles
from wattframe.session import dealt, materialize, rows_a_batch

# Allowed numbers of clusters, limits, words and the text for an unremarkable cluster.
ALLOWED_K = (2, 3, 4, 5)
FAR_FROM_MEAN = 0.5
SILHOUETTE_ROWS = 3000
SCATTER_ROWS = 900
FRIENDLY_NAMES = {
    "temperature_c": "temperature", "occupancy_pct": "occupancy", "hvac_usage_pct": "HVAC usage",
    "lighting_usage_pct": "lighting usage", "energy_consumption_kwh": "energy",
}
UNREMARKABLE = "Close to the campus average on all features"

Centers = Sequence[Sequence[float]]


def check_k(k: int | str) -> int:
    try:
        number = int(k)
    except (TypeError, ValueError):
        number = 0
    if number not in ALLOWED_K:
        # Fixed value: the message.
        raise ArgumentError("K must be 2, 3, 4 or 5.")
    return number


@dataclass(frozen=True)
class KMeansFit:
    centers: list[list[float]]
    cost: float
    costs: list[float]


#: Coordinates are counted in these units, so that sums are whole numbers and do not depend on the order of rows.
GRID = 2**20
#: Points that a task hands to numpy at once.
BLOCK = 4096
#: Blocks that a task is sent at once.
BATCH = 64
#: Ranks of centers that differ by less than this share of the squared lengths are settled by direct distances.
CLOSE = 1e-12
#: Starts choose their first centers among at most this many rows, the first by a hash of the row.
SEED_ROWS = 1000
#: A start ends when its centers together move by less than this squared distance.
TOLERANCE = 1e-4


def _first_centers(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Each further center is drawn with a chance that grows with the squared distance to the centers so far."""
    rng = np.random.default_rng(seed)
    chosen = [rows[rng.integers(len(rows))]]
    while len(chosen) < k:
        nearest = ((rows[:, None, :] - np.array(chosen)[None]) ** 2).sum(axis=2).min(axis=1)
        total = nearest.sum()
        pick = np.searchsorted(np.cumsum(nearest), rng.random() * total, "right") if total > 0 else rng.integers(len(rows))
        chosen.append(rows[min(int(pick), len(rows) - 1)])
    return np.array(chosen, float)


def _direct(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Squared distances of points (columns of `x`) to a center, added up coordinate by coordinate."""
    total = (x[0] - center[0]) * (x[0] - center[0])
    for j in range(1, len(center)):
        total += (x[j] - center[j]) * (x[j] - center[j])
    return total


def _nearest(x: np.ndarray, centers: np.ndarray, sizes: Sequence[int], points: np.ndarray | None = None,
             longest: float | None = None) -> np.ndarray:
    """(center, point): whether the center is the nearest of its fit, the first on ties; `sizes` centers a fit.

    Products of matrices rank the centers. Where more than one is within the error of that of the lowest, distances
    are added up directly. `points`, the coordinates over a line of ones, and the `longest` squared length may be known.
    """
    if points is None:
        points = np.vstack([x, np.ones(x.shape[1])])
    if longest is None:
        longest = (x * x).sum(axis=0).max()
    weight = (centers * centers).sum(axis=1)
    score = np.column_stack([-2.0 * centers, weight]) @ points
    slack = CLOSE * (longest + weight.max())
    hot = np.empty(score.shape, bool)
    start = 0
    for size in sizes:
        own = slice(start, start + size)
        start += size
        near = hot[own]
        np.less_equal(score[own], score[own].min(axis=0) + slack, out=near)
        if np.count_nonzero(near) > near.shape[1]:
            tied = np.flatnonzero(near.sum(axis=0) > 1)
            exact = np.array([_direct(x[:, tied], c) for c in centers[own]])
            near[:, tied] = np.arange(size)[:, None] == exact.argmin(axis=0)
    return hot


def _block_sums(blocks: Iterator[pa.RecordBatch], width: int, centers: np.ndarray, sizes: Sequence[int],
                ) -> Iterator[pa.RecordBatch]:
    """Per center the number of points nearest to it and their sums, of all blocks of a task."""
    # sums are Python's whole numbers: one that does not fit a column fails instead of wrapping around
    n, sums = np.zeros(len(centers), np.int64), np.zeros((len(centers), width), object)
    points, step = np.ones((width + 1, BLOCK)), 1.0 / GRID
    for batch in blocks:
        for data, rows, longest in zip(*(batch.column(i) for i in range(3)), strict=True):
            buffer, count = data.as_buffer(), rows.as_py()
            narrow = buffer.size == 4 * width * count
            whole = np.frombuffer(buffer, np.int32 if narrow else np.int64).reshape(width, -1)
            here = points[:, :count]
            x = np.multiply(whole, step, out=here[:-1])
            hot = _nearest(x, centers, sizes, here, longest.as_py())
            # doubles add up whole numbers, and so multiples of the unit, exactly below 2^53
            if narrow or np.abs(whole).max() < 2**53 // BLOCK:
                found = hot.astype(np.float64) @ here.T
                sums += (found[:, :-1] * GRID).astype(np.int64)
                n += found[:, -1].astype(np.int64)
            else:
                sums += hot.astype(object) @ whole.T.astype(object)
                n += hot.sum(axis=1)
    names = ["center", "n", *[f"s{j}" for j in range(width)]]
    yield pa.RecordBatch.from_arrays([
        pa.array(range(len(centers)), pa.int32()), pa.array(n), *[pa.array(list(v), pa.int64()) for v in sums.T]], names)


def _cell_sums(blocks: DataFrame, width: int, fits: Mapping[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per fit the number of rows and the coordinate sums of each of its centers, all fits in one aggregation.

    Every point meets the centers of all fits in its task; what is shuffled is one row per center and task.
    """
    centers, sizes = np.concatenate(list(fits.values())), [len(c) for c in fits.values()]
    counted = blocks.select("data", "n", "longest").mapInArrow(
        lambda batches: _block_sums(batches, width, centers, sizes),
        "center int, n bigint, " + ", ".join(f"s{j} bigint" for j in range(width)))
    summed = counted.groupBy("center").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])
    n, total = np.zeros(len(centers)), np.zeros((len(centers), width))
    with rows_a_batch(blocks.sparkSession, BATCH):
        sums = summed.collect()
    for row in sums:
        n[row["center"]] = row["n"]
        total[row["center"]] = [row[f"s{j}"] / GRID for j in range(width)]
    ends = np.cumsum(sizes)[:-1]
    return dict(zip(fits, zip(np.split(n, ends), np.split(total, ends), strict=True), strict=True))


def _whole(x: Column) -> Column:
    """The nearest whole number, halves away from zero; what `round` gives, which takes longer as it counts in decimals."""
    near = x.cast("bigint")
    rest = x - near
    return near + F.when(rest >= 0.5, 1).when(rest <= -0.5, -1).otherwise(0)


def _points(scaled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null as whole numbers x0, x1, …"""
    return scaled.select(*[_whole(F.col(c).cast("double") * GRID).alias(f"x{j}") for j, c in enumerate(columns)]).dropna()


def _packed(whole: np.ndarray) -> tuple[bytes, int, float, list[int]]:
    """Coordinate after coordinate, the number of points, a bound of their squared lengths, per coordinate the sum of squares."""
    reach = [max(abs(int(x.min())), abs(int(x.max()))) for x in whole]
    # squares below 2^50 add up in 64 bits
    squares = [int(x @ x) if far < 2**25 else sum(int(v) ** 2 for v in x) for x, far in zip(whole, reach, strict=True)]
    data = whole.astype(np.int32) if max(reach) < 2**31 else whole
    return data.tobytes(), whole.shape[1], sum((far / GRID) ** 2 for far in reach), squares


def _blocks(points: DataFrame) -> DataFrame:
    """The points in blocks of up to `BLOCK`, written: rounds read them many times over."""
    squares = [f"q{j}" for j in range(len(points.columns))]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = np.array([c.to_numpy() for c in batch.columns], np.int64)
            data, n, longest, sums = zip(*[_packed(whole[:, i:i + BLOCK]) for i in range(0, whole.shape[1], BLOCK)], strict=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(data, pa.binary()), pa.array(n, pa.int32()), pa.array(longest, pa.float64()),
                *[pa.array([Decimal(v) for v in q], pa.decimal128(38, 0)) for q in zip(*sums, strict=True)],
            ], ["data", "n", "longest", *squares])

    schema = "data binary, n int, longest double, " + ", ".join(f"{q} decimal(38,0)" for q in squares)
    return materialize(dealt(points.mapInArrow(packed, schema)), "points")


def _advance(points: DataFrame, width: int, first: Mapping[int, np.ndarray], rounds: int, tolerance: float,
             ) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """The centers of every fit after so many rounds, or once they stand still, and their costs."""
    blocks = _blocks(points)
    squares = blocks.agg(*[F.sum(f"q{j}") for j in range(width)]).first()
    whole = sum(float(v or 0) for v in squares) / GRID**2
    centers, moving = dict(first), dict(first)
    for _ in range(rounds):
        if not moving:
            break
        for i, (n, total) in _cell_sums(blocks, width, moving).items():
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], moving[i])
            shift = ((moved - moving[i]) ** 2).sum()
            centers[i] = moving[i] = moved
            if shift <= tolerance:
                del moving[i]
    costs = {}
    for i, (n, total) in _cell_sums(blocks, width, centers).items():
        # sum |x - c|^2 = sum |x|^2 - 2 c . sum x + n |c|^2
        costs[i] = max(whole + float((n * (centers[i] ** 2).sum(axis=1) - 2 * (centers[i] * total).sum(axis=1)).sum()), 0.0)
    return centers, costs


def fit_from_centers(scaled: DataFrame, columns: Sequence[str], first: Centers, max_iterations: int = 300,
                     tolerance: float = TOLERANCE) -> KMeansFit:
    """K-Means from given first centers, any number of them; without rows they stay where they are, at cost 0."""
    centers, costs = _advance(_points(scaled, columns), len(columns), {0: np.array(first, float)}, max_iterations, tolerance)
    return KMeansFit([list(map(float, c)) for c in centers[0]], costs[0], [costs[0]])


def fit_all_kmeans(scaled: DataFrame, columns: Sequence[str], ks: Sequence[int] = ALLOWED_K, restarts: int = 10,
                   seed: int = 42, max_iterations: int = 300) -> dict[int, KMeansFit]:
    """Best of several starts by cost, for several numbers of clusters at once.

    All starts of all k advance together: one pass over the rows per round, until the last of them stands still. A
    center that no row is nearest to stays where it is; rows with a null take no part. First centers follow a hash of the rows, sums are whole
    numbers: the fits are the same however the rows are dealt to partitions.
    """
    for k in ks:
        check_k(k)
    width, points = len(columns), _points(scaled, columns)
    names = [f"x{j}" for j in range(width)]
    seeds = points.orderBy(F.xxhash64(*names, F.lit(seed)), *names).limit(SEED_ROWS).collect()
    if not seeds:
        raise ArgumentError("K-Means needs rows.")
    seeds = np.array([list(r) for r in seeds], float) / GRID
    plan = [(k, start) for k in ks for start in range(restarts)]
    centers, costs = _advance(points, width, {i: _first_centers(seeds, k, seed + start) for i, (k, start) in enumerate(plan)},
                              max_iterations, TOLERANCE)
    fits = {}
    for k in ks:
        own = [i for i, (other, _) in enumerate(plan) if other == k]
        best = min(own, key=lambda i: (costs[i], i))
        fits[k] = KMeansFit([list(map(float, c)) for c in centers[best]], costs[best], [costs[i] for i in own])
    return fits


def fit_kmeans(scaled: DataFrame, columns: Sequence[str], k: int = 3, restarts: int = 10, seed: int = 42,
               max_iterations: int = 300) -> KMeansFit:
    """Best of several starts for one k."""
    k = check_k(k)
    return fit_all_kmeans(scaled, columns, (k,), restarts, seed, max_iterations)[k]


def squared_distance(columns: Sequence[str], center: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for c, x in zip(columns, center, strict=True):
        total = total + (F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x)))
    return total


def assign_centers(scaled: DataFrame, columns: Sequence[str], centers: Centers, output: str = "cluster") -> DataFrame:
    """Adds the 0-based number of the nearest center (the first on ties) and `distance2` to it. No shuffle."""
    choices = F.array(*[
        F.struct(squared_distance(columns, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)
    ])
    return (
        scaled.withColumn("_near", F.array_min(choices))
        .withColumns({output: F.col("_near")["i"], "distance2": F.col("_near")["d"]}).drop("_near")
    )


def renumbering(assigned: DataFrame, measure: str, cluster: str = "cluster") -> DataFrame:
    """(cluster, number): 1-based by rising mean of the measure. One row per cluster."""
    means = assigned.groupBy(cluster).agg(F.avg(measure).alias("mean"))
    # the window sees one row per cluster
    order = Window.partitionBy(F.lit(0)).orderBy("mean", cluster)
    return means.select(cluster, F.row_number().over(order).alias("number"), "mean")


def renumber(assigned: DataFrame, centers: Centers, measure: str, cluster: str = "cluster",
             ) -> tuple[DataFrame, list[list[float]]]:
    """Clusters as 1, 2, … by rising mean of the measure, and the centers in that order."""
    numbers = {row[cluster]: row["number"] for row in renumbering(assigned, measure, cluster).collect()}
    ordered = [list(centers[old]) for old in sorted(numbers, key=numbers.get)]
    lookup = F.lit(None).cast("int")
    for old, new in numbers.items():
        lookup = F.when(F.col(cluster) == old, F.lit(new)).otherwise(lookup)
    return assigned.withColumn(cluster, lookup), ordered


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(half_up(F.sum("distance2"), 1).alias("inertia"))


def tier(energy_z: Column) -> Column:
    return (
        F.when(energy_z >= FAR_FROM_MEAN, "High").when(energy_z <= -FAR_FROM_MEAN, "Low").otherwise("Medium")
    )


def describe(center_z: Mapping[str, Column]) -> Column:
    """'High x, low y' for features far from the mean."""
    parts = [
        F.when(z >= FAR_FROM_MEAN, F.lit(f"high {FRIENDLY_NAMES.get(c, c)}"))
        .when(z <= -FAR_FROM_MEAN, F.lit(f"low {FRIENDLY_NAMES.get(c, c)}"))
        for c, z in center_z.items()
    ]
    text = F.array_join(F.array_compact(F.array(*parts)), ", ")
    return F.when(text == "", F.lit(UNREMARKABLE)).otherwise(sentence_case(text))


def center_rows(df: DataFrame, columns: Sequence[str], centers: Centers, roles: Roles = METERED) -> DataFrame:
    """(cluster, name, description) of 1-based clusters."""
    rows = [(i, *map(float, c)) for i, c in enumerate(centers, start=1)]
    schema = "cluster int, " + ", ".join(f"`{c}` double" for c in columns)
    named = df.sparkSession.createDataFrame(rows, schema)
    return named.select(
        "cluster",
        F.concat(F.lit("Cluster "), F.col("cluster").cast("string"), F.lit(" ("), tier(F.col(roles.measure)),
                 F.lit(" energy)")).alias("name"),
        describe({c: F.col(c) for c in columns}).alias("description"),
    )


def cluster_profile(numbered: DataFrame, centers: Centers, columns: Sequence[str] | None = None,
                    roles: Roles = METERED) -> DataFrame:
    """(cluster, name, size, percent, five averages, description) of renumbered clusters."""
    columns = roles.cluster_numeric if columns is None else columns
    grouped = numbered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.avg(roles.measure).alias("e"), F.avg(roles.occupancy).alias("o"),
        F.avg(roles.hvac).alias("h"), F.avg("lighting_usage_pct").alias("l"), F.avg(roles.temperature).alias("t"),
    )
    # the window sees one row per cluster, and so does the join
    everything = F.sum("size").over(Window.partitionBy(F.lit(0)))
    return grouped.withColumn("share", F.col("size") / everything * 100).join(
        F.broadcast(center_rows(numbered, columns, centers, roles)), "cluster"
    ).select(
        "cluster", "name", "size", half_up(F.col("share"), 1).alias("percent"),
        half_up(F.col("e"), 2).alias("avg_energy"), half_up(F.col("o"), 1).alias("avg_occupancy"),
        half_up(F.col("h"), 1).alias("avg_hvac"), half_up(F.col("l"), 1).alias("avg_lighting"),
        half_up(F.col("t"), 1).alias("avg_temperature"), "description",
    )


def silhouette_sampled(assigned: DataFrame, columns: Sequence[str], key: Sequence[str], clusters: Sequence[int],
                       rows: int = SILHOUETTE_ROWS, seed: int = 42, order: Column | None = None) -> DataFrame:
    """One row: Euclidean silhouette over a sample of at most `rows` rows (a property of the measure itself).

    The sample of each cluster becomes one array of at most `rows` points. Every sampled row then meets each
    cluster once and sums its distances inside that array, so no row pairs are ever produced.
    """
    chosen = sample_rows(assigned, key, rows, seed, order).select(
        F.col("cluster").alias("own"), *[F.col(c).cast("double").alias(c) for c in columns])
    chosen = materialize(chosen, "silhouette-sample")
    members = chosen.groupBy(F.col("own").alias("other")).agg(
        F.collect_list(F.struct(*columns)).alias("points"), F.count(F.lit(1)).alias("size"))

    def distance(p: Column) -> Column:
        total = F.lit(0.0)
        for c in columns:
            total = total + (p[c] - F.col(c)) * (p[c] - F.col(c))
        return F.sqrt(total)

    meetings = (
        chosen.repartition(32).withColumn("row", F.monotonically_increasing_id())
        .withColumn("other", F.explode(F.array(*[F.lit(c) for c in clusters])))
        .join(F.broadcast(members), "other")
    )
    summed = meetings.select(
        "row", "own", "other", "size",
        F.aggregate("points", F.lit(0.0), lambda acc, p: acc + distance(p)).alias("d"),
    )
    same = F.col("own") == F.col("other")
    per_row = summed.groupBy("row").agg(
        F.max(F.when(same, F.col("size"))).alias("own_size"),
        F.max(F.when(same, F.try_divide(F.col("d"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~same, F.col("d") / F.col("size"))).alias("b"),
    )
    # a row alone in its cluster scores 0
    score = F.when(F.col("own_size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per_row.agg(F.count(F.lit(1)).alias("sampled"), half_up(F.avg(score), 3).alias("silhouette"))


@dataclass(frozen=True)
class Projection:
    """Loadings per component and explained variance in percent, 1 digit."""

    columns: tuple[str, ...]
    loadings: list[list[float]]
    explained: list[float]

    def apply(self, df: DataFrame, names: Sequence[str] = ("x", "y")) -> DataFrame:
        expressions = {}
        for name, loading in zip(names, self.loadings, strict=True):
            total = F.lit(0.0)
            for c, weight in zip(self.columns, loading, strict=True):
                total = total + F.col(c) * F.lit(weight)
            expressions[name] = total
        return df.withColumns(expressions)


def fit_projection(scaled: DataFrame, columns: Sequence[str], components: int = 2) -> Projection:
    """Principal components from covariances, one aggregation; each one turned so that its largest loading is positive."""
    numbers = [F.col(c).cast("double") for c in columns]
    pairs = [(i, j) for i in range(len(numbers)) for j in range(i, len(numbers))]
    gaps = [F.count_if(x.isNull() | F.isnan(x)) for x in numbers]
    found = scaled.agg(F.count(F.lit(1)), *gaps, *[F.covar_samp(numbers[i], numbers[j]) for i, j in pairs]).first()
    if found[0] < 2 or any(found[1:len(numbers) + 1]):
        raise ArgumentError("Principal components need two rows at least, and all numbers.")
    covariance = np.zeros((len(numbers), len(numbers)))
    for (i, j), v in zip(pairs, found[len(numbers) + 1:], strict=True):
        covariance[i, j] = covariance[j, i] = v
    matrix, variances, _ = np.linalg.svd(covariance)
    loadings = []
    for j in range(components):
        loading = [float(v) for v in matrix[:, j]]
        turn = math.copysign(1.0, max(loading, key=abs))
        loadings.append([turn * v for v in loading])
    explained = [math.floor(float(v / variances.sum()) * 1000 + 0.5) / 10 for v in variances[:components]]
    return Projection(tuple(columns), loadings, explained)


def pca_variance(df: DataFrame, projection: Projection) -> DataFrame:
    rows = [(i, v, *p) for i, (v, p) in enumerate(zip(projection.explained, projection.loadings, strict=True), 1)]
    schema = "component int, explained_pct double, " + ", ".join(f"`{c}` double" for c in projection.columns)
    return df.sparkSession.createDataFrame(rows, schema)


def pca_scatter(numbered: DataFrame, projection: Projection, key: Sequence[str], rows: int = SCATTER_ROWS,
                seed: int = 42, order: Column | None = None) -> DataFrame:
    """(key, cluster, x, y) of at most `rows` rows, 3 digits."""
    chosen = projection.apply(sample_rows(numbered, key, rows, seed, order))
    return chosen.select(*key, "cluster", half_up(F.col("x"), 3).alias("x"), half_up(F.col("y"), 3).alias("y"))
