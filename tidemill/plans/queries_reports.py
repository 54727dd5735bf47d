"""Registered queries: whole reports, as the number of rows of each part; the parts have queries of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import attribution as at
from tidemill.operators import fraud, reports
from tidemill.plans import queries_business  # noqa: F401  its SQL is used below
from tidemill.plans.bindings import AS_OF, lines, table, transactions
from tidemill.plans.queries_fraud import alerts, pay
from tidemill.plans.queries_marketing import acquired, campaigns, found_paths, market, spending
from tidemill.plans.registry import ORACLE_SQL, query
from tidemill.sources.tablestore import TableStore
from tidemill.streaming import runs


def counted(report: reports.Report, parts: dict[str, str]) -> DataFrame:
    each = [report[part].agg(F.lit(part).alias("part"), F.count("*").alias("rows")) for part in parts]
    return reduce(DataFrame.unionByName, each)


def counts_of(parts: dict[str, str]) -> str:
    """The same from the SQL of the parts' own queries."""
    return " UNION ALL ".join(f"SELECT '{part}' AS part, count(*) AS rows FROM ({ORACLE_SQL[name]})" for part, name in parts.items())


PRODUCTS = {"overall_performance": "product_overall_performance", "sales_metrics": "product_sales_metrics", "velocity_analysis": "product_velocity", "profitability": "product_profitability", "seasonal_performance": "product_seasonal_performance"}
LIFECYCLE = {"lifecycle_stages": "product_lifecycle_stages", "stage_transitions": "product_stage_distribution", "stage_distribution": "product_stage_distribution", "lifecycle_metrics": "product_lifecycle_stages", "launch_analysis": "product_launch_performance"}
ATTRIBUTION = {"attribution_results": "attribution_paths", "channel_attribution": "attribution_linear", "path_analysis": "attribution_path_analysis", "model_comparison": "attribution_model_comparison", "summary": "attribution_summary"}
CAMPAIGNS = {"campaign_metrics": "campaign_metrics", "campaign_effectiveness": "campaign_effectiveness", "channel_performance": "channel_performance", "creative_performance": "creative_performance", "budget_efficiency": "budget_efficiency", "performance_trends": "campaign_performance_trends", "summary": "campaign_summary"}
ACQUISITION = {"cac_by_channel": "cac_by_channel", "cohort_cac": "cac_cohorts", "channel_efficiency": "cac_channel_efficiency", "summary": "cac_summary", "attributed_cac": "cac_attributed"}
RETURNS = {"roi_metrics": "marketing_roi", "channel_roi": "roi_by_channel", "campaign_roi": "roi_by_campaign", "roi_trends": "roi_trends", "efficiency_analysis": "roi_efficiency_tiers", "budget_optimization": "roi_budget_optimization", "incremental_analysis": "marketing_incremental", "summary": "roi_summary"}


@query(counts_of(PRODUCTS))
def report_product_performance(spark, sf):
    return counted(reports.product_performance(lines(spark, sf), unit="month"), PRODUCTS)


@query(counts_of(LIFECYCLE))
def report_product_lifecycle(spark, sf):
    launched = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.lit("1995-01-01").cast("date").alias("launch_date"))
    return counted(reports.product_lifecycle(lines(spark, sf), launched, AS_OF), LIFECYCLE)


@query(counts_of(ATTRIBUTION))
def report_multi_touch_attribution(spark, sf):
    touches, conversions = market(spark, sf)
    return counted(reports.multi_touch_attribution(touches, conversions.select("conversion_id", "user_id", "conversion_ts", "conversion_value"), days=2), ATTRIBUTION)


@query(counts_of(CAMPAIGNS))
def report_campaign_performance(spark, sf):
    return counted(reports.campaign_performance(campaigns(spark), *market(spark, sf), "week"), CAMPAIGNS)


@query(counts_of(ACQUISITION))
def report_acquisition_cost(spark, sf):
    return counted(reports.acquisition_cost(spending(spark, sf), acquired(spark, sf), at.attributed(found_paths(spark, sf))), ACQUISITION)


@query(counts_of(RETURNS))
def report_marketing_roi(spark, sf):
    return counted(reports.marketing_roi(spending(spark, sf), at.attributed(found_paths(spark, sf)), "week"), RETURNS)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df after a way through a versioned table."""
    store = TableStore(df.sparkSession, runs.folder(df.sparkSession, name))
    store.append(name, df)
    return store.read(name)


@query(ORACLE_SQL["fraud_alert_priorities"])
def fraud_saved_alerts(spark, sf):
    made = alerts(spark, sf).select("alert_id", F.round("priority_score", 6).alias("priority_score"), "alert_priority", "estimated_minutes", F.get("recommended_actions", F.lit(0)).alias("first_action"))
    return kept(made, "alerts")


@query(ORACLE_SQL["fraud_high_risk_merchants"])
def fraud_saved_profiles(spark, sf):
    made = kept(fraud.merchant_risk(pay(spark, sf), AS_OF, None), "profiles")
    return fraud.high_risk(made, 0.25).select("merchant_id", F.round("merchant_risk_score", 6).alias("merchant_risk_score"))


@query("SELECT 'rfm_profiles' AS part, count(DISTINCT o_custkey) AS rows FROM orders UNION ALL SELECT 'historical_clv', count(DISTINCT o_custkey) FROM orders")
def report_customer_value(spark, sf):
    parts = ("rfm_profiles", "historical_clv")
    return counted(reports.customer_value(transactions(spark, sf), AS_OF), dict.fromkeys(parts, ""))
