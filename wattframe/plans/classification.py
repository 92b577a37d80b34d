"""From cleaned rows to a judged tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.operators import evaluation as E
from wattframe.operators import trees as T
from wattframe.operators.encoding import Domains, category_domains, class_labels
from wattframe.operators.levels import feature_ranges, level_intervals
from wattframe.operators.splitting import split_sizes, split_stratified
from wattframe.roles import METERED, Roles
from wattframe.session import materialize


@dataclass(frozen=True)
class TreeReport:
    model: PipelineModel
    domains: Domains
    size: dict[str, int]
    reports: dict[str, DataFrame]


def classification_report(cleaned: DataFrame, roles: Roles = METERED, model: PipelineModel | None = None,
                          **tree: int) -> TreeReport:
    """Fits on the train side (unless a model is given) and reports on the test side."""
    needed = [*roles.key, *roles.class_numeric, *roles.class_categorical, roles.category]
    key = roles.key or tuple(needed)
    sides = materialize(split_stratified(cleaned.select(*dict.fromkeys(needed)), key, roles.category), "sides")
    model = model or T.fit_tree(sides.where("side = 'train'"), roles, **tree)
    # both sides are scored once; all metrics read the few columns kept
    scored = materialize(T.predict_category(sides, model).select("side", roles.category, "predicted"), "scored")
    test = scored.where(F.col("side") == "test")
    present = class_labels(cleaned, roles.category)
    classes = [c for c in roles.category_order if c in present]
    per_class = E.per_class_scores(test, roles.category, "predicted", classes)
    reports = {
        "accuracy": E.accuracy(scored, roles.category, "predicted"),
        "weighted": E.weighted_scores(per_class),
        "per_class": per_class,
        "confusion": E.confusion_matrix(test, roles.category, "predicted", classes),
        "sizes": split_sizes(scored),
        "importance": T.importance(model),
        "tree": T.tree_nodes(model),
        "ranges": feature_ranges(cleaned, roles.class_numeric),
        "levels": level_intervals(cleaned, roles),
    }
    domains = category_domains(cleaned, roles.class_categorical)
    return TreeReport(model, domains, T.tree_size(model), reports)
