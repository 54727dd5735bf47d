"""Whole reports: the frames of an analysis by name, all of them lazy; what nobody reads is never computed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import attribution, clv, geo, product, rfm

Report = dict[str, DataFrame]


def between(df: DataFrame, start: str | None, end: str | None, ts: str = "ts") -> DataFrame:
    """Rows from the start day to the end day, both included; the condition reaches the scan."""
    if start:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    return df.filter(F.col(ts) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")) if end else df


def product_performance(lines: DataFrame, inventory: DataFrame | None = None, unit: str = "day", start: str | None = None, end: str | None = None) -> Report:
    lines = between(lines, start, end)
    out = {
        "overall_performance": product.overall(lines, unit), "sales_metrics": product.sales(lines), "velocity_analysis": product.velocity(lines), "profitability": product.profitability(lines),
        "category_performance": product.by_attribute(lines, "category", unit), "brand_performance": product.by_attribute(lines, "brand", unit), "seasonal_performance": product.seasonal(lines),
    }
    return out | ({"inventory_analysis": product.inventory_turnover(lines, inventory)} if inventory is not None else {})


def product_lifecycle(lines: DataFrame, launched: DataFrame | None = None, as_of: str | None = None) -> Report:
    """launched (product_id, launch_date) needs as_of."""
    stages = product.lifecycle(product.trends(product.series(lines)))
    distribution = product.stage_distribution(stages)
    out = {
        "lifecycle_stages": stages, "stage_transitions": distribution.drop("percentage"), "lifecycle_metrics": product.stage_scores(stages), "at_risk_products": product.at_risk(stages),
        "growth_opportunities": product.growth_opportunities(stages), "stage_distribution": distribution.select("lifecycle_stage", "product_count", "percentage"),
    }
    return out | ({"launch_analysis": product.launches(stages, launched, as_of)} if launched is not None else {})


def recommendation_engine(lines: DataFrame, features: DataFrame | None = None, least_common: int = 2, top: int = 10) -> Report:
    """Collaborative recommendations and similar items; profiles of content where products' features (product_id, category) are given."""
    made = product.frequent_interactions(product.interactions(lines))
    out = {"interactions": made, "recommendations": product.recommend(made, top=top), "item_similarity": product.item_similarity(made, least_common)}
    return out | ({"content_profiles": product.content_profiles(features, made)} if features is not None else {})


def multi_touch_attribution(touches: DataFrame, conversions: DataFrame, model: str = "linear", days: int = attribution.WINDOW_DAYS) -> Report:
    paths = attribution.paths(touches, conversions, days)
    made = attribution.attributed(paths, model)
    return {"attribution_results": made, "channel_attribution": attribution.by_channel(made), "path_analysis": attribution.path_summary(paths), "model_comparison": attribution.compare_models(paths), "summary": attribution.attribution_summary(made, conversions)}


def campaign_performance(campaigns: DataFrame, touches: DataFrame, conversions: DataFrame, unit: str = "month") -> Report:
    metrics = attribution.campaign_metrics(campaigns, touches, conversions, unit)
    return {
        "campaign_metrics": metrics, "campaign_effectiveness": attribution.effectiveness(metrics), "channel_performance": attribution.channel_performance(touches, conversions), "creative_performance": attribution.creative_performance(touches, conversions),
        "budget_efficiency": attribution.budget_efficiency(metrics), "performance_trends": attribution.performance_trends(metrics), "summary": attribution.campaign_summary(metrics),
    }


def acquisition_cost(spend: DataFrame, acquisitions: DataFrame, attributed: DataFrame | None = None) -> Report:
    costs = attribution.acquisition_cost(spend, acquisitions)
    out = {"cac_by_channel": costs, "cohort_cac": attribution.acquisition_cohorts(spend, acquisitions), "channel_efficiency": attribution.channel_efficiency(costs), "summary": attribution.acquisition_summary(costs)}
    return out | ({"attributed_cac": attribution.attributed_acquisition_cost(spend, attributed)} if attributed is not None else {})


def marketing_roi(spend: DataFrame, revenue: DataFrame, unit: str = "month") -> Report:
    made = attribution.roi(spend, revenue, unit)
    channels = attribution.roi_by(made, "channel")
    return {
        "roi_metrics": made, "channel_roi": channels, "campaign_roi": attribution.roi_by(made, "campaign_id"), "roi_trends": attribution.roi_trends(made), "efficiency_analysis": attribution.efficiency_tiers(made),
        "budget_optimization": attribution.budget_shift(channels), "incremental_analysis": attribution.incremental(spend, revenue, unit), "summary": attribution.roi_summary(made),
    }


def regional_demand(placed: DataFrame, unit: str = "month") -> Report:
    """placed: transactions with country and region."""
    country, region = geo.demand(placed, ["country"], unit), geo.demand(placed, ["region"], unit)
    return {"country_forecast": country, "region_forecast": region, "summary": geo.forecast_summary(country, region), "accuracy": geo.accuracy(placed)}


def geographic_segments(customers: DataFrame, tx: DataFrame, as_of: str, k: int = 5) -> Report:
    made = geo.cluster(geo.customer_features(customers, tx, as_of), k)
    return {"customer_segments": made, "segment_profiles": geo.clusters(made), "segment_places": geo.cluster_places(made), "segment_performance": geo.cluster_performance(made, tx)}


def customer_value(tx: DataFrame, as_of: str) -> Report:
    """RFM profiles and their segments, and the historical value of each customer."""
    profiles = rfm.profiles(tx, as_of)
    return {"rfm_profiles": profiles, "segment_summary": rfm.segment_summary(profiles), "historical_clv": clv.historical(tx)}
