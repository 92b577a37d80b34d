"""From cleaned rows to a judged forest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.operators import evaluation as E
from wattframe.operators import trees as T
from wattframe.operators.encoding import Domains, category_domains
from wattframe.operators.levels import feature_ranges, floor_area_defaults
from wattframe.operators.splitting import split_random, split_sizes
from wattframe.roles import METERED, Roles
from wattframe.session import materialize


@dataclass(frozen=True)
class ForestReport:
    model: PipelineModel
    domains: Domains
    reports: dict[str, DataFrame]


def regression_report(cleaned: DataFrame, roles: Roles = METERED, model: PipelineModel | None = None,
                      **forest: int) -> ForestReport:
    """Fits on the train side (unless a model is given) and reports on the test side."""
    needed = list(dict.fromkeys(
        [*roles.key, *roles.regression_numeric, *roles.regression_categorical, roles.measure]))
    key = roles.key or tuple(needed)
    sides = materialize(split_random(cleaned.select(*needed), key), "sides")
    model = model or T.fit_forest(sides.where("side = 'train'"), roles, **forest)
    kept = list(dict.fromkeys([*key, roles.hour, roles.measure, "predicted"]))
    test = materialize(T.predict_energy(sides.where("side = 'test'"), model).select(*kept), "scored")
    points = E.scatter_sample(test, roles.measure, "predicted", key)
    reports = {
        "metrics": E.regression_metrics(test, roles.measure, "predicted"),
        "sizes": split_sizes(sides),
        "mean_energy": cleaned.agg(F.avg(roles.measure).alias("mean_energy")),
        "scatter": points,
        "identity": E.identity_bounds(points),
        "residuals": E.residual_histogram(E.residuals(test, roles.measure, "predicted")),
        "trend": E.hourly_actual_predicted(test, roles.measure, "predicted", roles),
        "importance": T.importance(model),
        "ranges": feature_ranges(cleaned, roles.regression_numeric),
        "floor_area": floor_area_defaults(cleaned, roles),
    }
    return ForestReport(model, category_domains(cleaned, roles.regression_categorical), reports)
