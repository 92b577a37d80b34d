"""The data-quality report: cleaning and everything measured around it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wattframe.operators import profiling as P
from wattframe.operators.cleaning import clean
from wattframe.operators.encoding import fit_scaler
from wattframe.roles import METERED, Roles
from wattframe.session import materialize


def quality_report(raw: DataFrame, roles: Roles = METERED) -> dict[str, DataFrame]:
    """Eleven named tables. Cleaning runs once; all tables on cleaned rows read what it wrote."""
    cleaned = clean(raw, roles)
    rows = cleaned.rows
    scaler = fit_scaler(rows, roles.scaled_columns)
    summary = materialize(P.before_after(cleaned), "summary")
    stamps = P.timestamp_range(raw, rows, roles)
    return {
        "before": summary.where("stage = 'before'"),
        "after": summary.where("stage = 'after'"),
        "steps": P.step_log(summary, cleaned.log, stamps, roles),
        "missing_by_col": P.missing_profile(raw),
        "timestamp": stamps,
        "encoding": P.encoding_report(rows, roles),
        "scaling": P.scaling_report(rows, roles.scaled_columns, scaler),
        "selection": P.feature_selection(rows, roles),
        "excluded": P.excluded_columns(rows, roles),
        "preview": P.preview_clean(rows, roles),
        "scaled_preview": P.preview_scaled(rows, roles, scaler),
    }
