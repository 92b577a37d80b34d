"""Usage profiles for one k, and the allowed k side by side."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.functions.numbers import half_up
from wattframe.operators.clusters import (
    ALLOWED_K, KMeansFit, assign_centers, check_k, cluster_profile, fit_all_kmeans, fit_kmeans, fit_projection,
    pca_scatter, pca_variance, renumber, silhouette_sampled,
)
from wattframe.operators.encoding import fit_scaler
from wattframe.operators.splitting import row_hash
from wattframe.plans.reports import Reports
from wattframe.roles import METERED, Roles
from wattframe.session import materialize
from wattframe.sources.store import signature, table_exists


@dataclass(frozen=True)
class Profiles:
    k: int
    fit: KMeansFit
    numbered: DataFrame
    centers: list[list[float]]
    reports: Mapping[str, DataFrame]


def z_columns(roles: Roles = METERED) -> list[str]:
    return [f"z_{c}" for c in roles.cluster_numeric]


def scaled_rows(cleaned: DataFrame, roles: Roles = METERED) -> DataFrame:
    """Only the columns that clustering needs, with their z-scores."""
    columns = list(dict.fromkeys([*roles.key, *roles.cluster_numeric]))
    return fit_scaler(cleaned, roles.cluster_numeric).transform(cleaned.select(*columns))


def cluster_profiles(cleaned: DataFrame, roles: Roles = METERED, k: int | str = 3, restarts: int = 10) -> Profiles:
    """Scaled rows are written once; starts, silhouette, projection and profile read them."""
    k = check_k(k)
    scaled = materialize(scaled_rows(cleaned, roles), "scaled")
    return _profiles(scaled, roles, k, fit_kmeans(scaled, z_columns(roles), k, restarts))


def _profiles(scaled: DataFrame, roles: Roles, k: int, fit: KMeansFit) -> Profiles:
    columns = z_columns(roles)
    numbered, centers = renumber(assign_centers(scaled, columns, fit.centers), fit.centers, roles.measure)
    key = roles.key or roles.cluster_numeric
    projection = cache(lambda: fit_projection(scaled, columns))
    reports = Reports(
        summary=lambda: numbered.agg(
            F.lit(k).alias("k"), F.count(F.lit(1)).alias("records"), half_up(F.sum("distance2"), 1).alias("inertia")),
        profile=lambda: cluster_profile(numbered, centers, roles=roles),
        silhouette=lambda: silhouette_sampled(numbered, columns, key, range(1, k + 1)),
        variance=lambda: pca_variance(scaled, projection()),
        scatter=lambda: pca_scatter(numbered, projection(), key, order=row_hash(key)),
    )
    return Profiles(k, fit, numbered, centers, reports)


def k_sweep(cleaned: DataFrame, roles: Roles = METERED, restarts: int = 10) -> DataFrame:
    """(k, silhouette, inertia) for every allowed k; all starts of all k are fitted together."""
    scaled = materialize(scaled_rows(cleaned, roles), "scaled")
    columns, key = z_columns(roles), roles.key or roles.cluster_numeric
    rows = []
    for k, fit in fit_all_kmeans(scaled, columns, ALLOWED_K, restarts).items():
        score = silhouette_sampled(assign_centers(scaled, columns, fit.centers), columns, key, range(k)).first()
        rows.append((k, score["silhouette"], round(fit.cost, 1)))
    return cleaned.sparkSession.createDataFrame(rows, "k int, silhouette double, inertia double")


@dataclass(frozen=True)
class StoredProfiles:
    k: int
    reused: bool
    reports: Mapping[str, DataFrame]


_REPORTS = ("summary", "profile", "silhouette", "variance", "scatter")


def stored_profiles(spark: SparkSession, path: str, cleaned: DataFrame, roles: Roles = METERED, k: int | str = 3,
                    restarts: int = 10) -> StoredProfiles:
    """The reports of `cluster_profiles` and the numbered rows, kept per data and k: fitted once, then read.

    A result lies in a folder named by the fingerprint of the columns it depends on, k and the number of starts, so
    a changed value leads to another folder. It is written aside and published by a stamp that names where it lies;
    of two runs at the same time, readers see one whole result.
    """
    k = check_k(k)
    needed = cleaned.select(*dict.fromkeys([*roles.key, *roles.cluster_numeric]))
    folder = f"{path.rstrip('/')}/{signature(needed).replace('-', '_')}-k{k}-s{restarts}"
    reused = table_exists(spark, f"{folder}/stamp")
    if not reused:
        made = cluster_profiles(cleaned, roles, k, restarts)
        place = f"{folder}/{uuid.uuid4().hex}"
        for name in _REPORTS:
            made.reports[name].write.parquet(f"{place}/{name}")
        made.numbered.write.parquet(f"{place}/numbered")
        spark.createDataFrame([(place,)], "place string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/stamp")
    place = spark.read.parquet(f"{folder}/stamp").first()["place"]
    return StoredProfiles(k, reused, {name: spark.read.parquet(f"{place}/{name}") for name in (*_REPORTS, "numbered")})
