"""Rule mining from thresholds to the report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wattframe.operators.itemsets import (
    association_rules, check_thresholds, frequent_itemsets, rules_chart, rules_summary, top_rules,
)
from wattframe.roles import METERED, Roles


def mine_rules(
    cleaned: DataFrame, min_support: float = 0.1, min_confidence: float = 0.6, limit: int = 200,
    roles: Roles = METERED,
) -> dict[str, DataFrame]:
    """summary, rules (the best `limit`) and chart (the best ten)."""
    min_support, min_confidence = check_thresholds(min_support, min_confidence)
    found = frequent_itemsets(cleaned, min_support, roles)
    rules = association_rules(found, min_confidence)
    top = top_rules(rules, limit)
    return {"summary": rules_summary(found, rules), "rules": top, "chart": rules_chart(top)}
