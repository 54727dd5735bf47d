"""Retention by table: how long rows are hot, warm and cold, when they are archived and when they go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Days up to which rows are hot, warm and cold; days after which they are archived and deleted (None: never)."""

    hot: int
    warm: int
    cold: int
    archive: int | None
    delete: int | None
    column: str
    enabled: bool = True


# The rules of the known tables, and of any other, which is not enabled.
RULES = {
    "transactions": Rule(30, 90, 365, 2190, 2555, "transaction_date"),
    "user_events": Rule(7, 30, 90, 365, 1095, "event_timestamp"),
    "customer_profiles": Rule(90, 365, 1095, None, None, "last_updated"),
    "product_catalog": Rule(30, 90, 365, 1095, None, "created_at"),
    "marketing_campaigns": Rule(30, 90, 365, 1095, 2190, "campaign_start_date"),
    "fraud_detection_logs": Rule(30, 90, 365, 1095, 2555, "detection_timestamp"),
    "inventory_snapshots": Rule(7, 30, 90, 365, 1095, "snapshot_date"),
    "web_analytics": Rule(7, 30, 365, 1095, 2190, "page_view_timestamp"),
    "recommendation_logs": Rule(14, 30, 90, 365, 1095, "recommendation_timestamp"),
    "system_logs": Rule(3, 7, 30, 90, 365, "log_timestamp"),
}
OTHER = Rule(30, 90, 365, 1095, None, "created_at", enabled=False)


def rule_for(table: str, rules: dict[str, Rule] | None = None) -> Rule:
    return (RULES if rules is None else rules).get(table, OTHER)


def problems(rules: dict[str, Rule]) -> list[str]:
    """What is out of order in rules: each span must end after the one before."""
    out = []
    for name, rule in rules.items():
        spans = [(k, getattr(rule, k)) for k in ("hot", "warm", "cold", "archive", "delete") if getattr(rule, k) is not None]
        out += [f"{name}: {a} ({x} days) must be less than {b} ({y} days)" for (a, x), (b, y) in zip(spans[:-1], spans[1:], strict=True) if x >= y]
    return out


def tier(rule: Rule, as_of: str, column: str | None = None) -> Column:
    """hot, warm, cold, archive or delete of each row, by the age of its day; what has no date is cold."""
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date(column or rule.column))
    late = [F.when(age > days, name) for days, name in ((rule.delete, "delete"), (rule.archive, "archive")) if days is not None]
    return F.coalesce(*late, F.when(age <= rule.hot, "hot"), F.when(age <= rule.warm, "warm"), F.lit("cold"))


def distribution(df: DataFrame, rule: Rule, as_of: str, column: str | None = None) -> DataFrame:
    """tier and rows, from one aggregation."""
    return df.groupBy(tier(rule, as_of, column).alias("tier")).agg(F.count("*").alias("rows"))
