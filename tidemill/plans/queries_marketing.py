"""Registered queries: attribution, campaigns, acquisition cost and return.

Touches are views and clicks, conversions are purchases; campaigns, spend and acquisitions are made from the same events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import attribution as at
from tidemill.plans.bindings import BEHAVIOR, behavior
from tidemill.plans.registry import query

MARKET = f"""{BEHAVIOR}, touches AS (SELECT event_id AS touchpoint_id, user_id, channel, 'camp_' || CAST(k % 4 AS VARCHAR) AS campaign_id, 'cr_' || CAST(k % 3 AS VARCHAR) AS creative_id, ts, event_type, value AS engagement_score FROM behavior WHERE event_type IN ('view', 'click')),
  conversions AS (SELECT event_id AS conversion_id, user_id, ts AS conversion_ts, value AS conversion_value, channel, 'camp_' || CAST(k % 4 AS VARCHAR) AS campaign_id, 'cr_' || CAST(k % 3 AS VARCHAR) AS creative_id FROM behavior WHERE event_type = 'purchase'),
  spend AS (SELECT ts AS spend_date, 'camp_' || CAST(k % 4 AS VARCHAR) AS campaign_id, channel, value * 0.4 AS spend_amount FROM behavior WHERE event_type = 'error'),
  acq AS (SELECT user_id, ts AS acquisition_ts, channel AS acquisition_channel, value AS first_purchase_value FROM behavior WHERE event_type = 'signup')"""
CAMPAIGNS = "campaigns AS (SELECT 'camp_' || CAST(i AS VARCHAR) AS campaign_id, 1000.0 * (i + 1) AS campaign_spend FROM range(5) t(i))"
PATHS = f"""{MARKET}, j AS (SELECT c.*, t.touchpoint_id, t.channel AS tc, t.campaign_id AS tcamp, t.ts FROM conversions c JOIN touches t ON t.user_id = c.user_id AND t.ts <= c.conversion_ts AND t.ts >= c.conversion_ts - INTERVAL 2 DAY),
  p AS (SELECT conversion_id, user_id, conversion_value, touchpoint_id, tc AS channel, tcamp AS campaign_id, ts, row_number() OVER (PARTITION BY conversion_id ORDER BY ts, touchpoint_id) AS pos, count(*) OVER (PARTITION BY conversion_id) AS n, (floor(epoch(conversion_ts)) - floor(epoch(ts))) / 3600 AS h FROM j)"""
WEIGHTS = {
    "first_touch": "CAST(pos = 1 AS DOUBLE)", "last_touch": "CAST(pos = n AS DOUBLE)", "linear": "CAST(1 AS DOUBLE) / n", "time_decay": "pow(2, -h / 168)",
    "position_based": "CASE WHEN pos = 1 THEN 0.4 WHEN pos = n THEN 0.4 ELSE 0.2 / greatest(n - 2, 1) END",
}


def market(spark, sf):
    b = behavior(spark, sf).withColumns({"campaign_id": F.concat(F.lit("camp_"), (F.col("k") % 4).cast("string")), "creative_id": F.concat(F.lit("cr_"), (F.col("k") % 3).cast("string"))})
    touches = b.filter(F.col("event_type").isin("view", "click")).select(F.col("event_id").alias("touchpoint_id"), "user_id", "channel", "campaign_id", "creative_id", "ts", "event_type", F.col("value").alias("engagement_score"))
    conversions = b.filter("event_type = 'purchase'").select(F.col("event_id").alias("conversion_id"), "user_id", F.col("ts").alias("conversion_ts"), F.col("value").alias("conversion_value"), "channel", "campaign_id", "creative_id")
    return touches, conversions


def found_paths(spark, sf):
    touches, conversions = market(spark, sf)
    return at.paths(touches, conversions.select("conversion_id", "user_id", "conversion_ts", "conversion_value"), 2)


def spending(spark, sf):
    b = behavior(spark, sf).filter("event_type = 'error'")
    return b.select(F.col("ts").alias("spend_date"), F.concat(F.lit("camp_"), (F.col("k") % 4).cast("string")).alias("campaign_id"), "channel", (F.col("value") * 0.4).alias("spend_amount"))


def acquired(spark, sf):
    return behavior(spark, sf).filter("event_type = 'signup'").select("user_id", F.col("ts").alias("acquisition_ts"), F.col("channel").alias("acquisition_channel"), F.col("value").alias("first_purchase_value"))


def campaigns(spark):
    return spark.range(5).select(F.concat(F.lit("camp_"), F.col("id").cast("string")).alias("campaign_id"), (1000.0 * (F.col("id") + 1)).alias("campaign_spend"))


def r(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query(f"WITH {PATHS} SELECT conversion_id, touchpoint_id, CAST(pos AS INTEGER) AS path_position, n AS path_length, round(h, 6) AS hours_to_conversion FROM p")
def attribution_paths(spark, sf):
    return r(found_paths(spark, sf), "hours_to_conversion").select("conversion_id", "touchpoint_id", "path_position", "path_length", "hours_to_conversion")


def attribution_sql(model):
    w = WEIGHTS[model]
    return f"""WITH {PATHS} SELECT channel, campaign_id, round(sum({w}), 6) AS attributed_conversions, round(sum({w} * conversion_value), 4) AS attributed_revenue, count(DISTINCT user_id) AS users, round(avg(h), 6) AS avg_hours_to_conversion, count(*) AS touchpoints FROM p GROUP BY 1, 2"""


def attribution(spark, sf, model):
    return r(r(at.by_channel(at.attributed(found_paths(spark, sf), model)), "attributed_conversions", "avg_hours_to_conversion"), "attributed_revenue", digits=4)


@query(attribution_sql("first_touch"))
def attribution_first_touch(spark, sf):
    return attribution(spark, sf, "first_touch")


@query(attribution_sql("last_touch"))
def attribution_last_touch(spark, sf):
    return attribution(spark, sf, "last_touch")


@query(attribution_sql("linear"))
def attribution_linear(spark, sf):
    return attribution(spark, sf, "linear")


@query(attribution_sql("time_decay"))
def attribution_time_decay(spark, sf):
    return attribution(spark, sf, "time_decay")


@query(attribution_sql("position_based"))
def attribution_position_based(spark, sf):
    return attribution(spark, sf, "position_based")


@query(f"""WITH {PATHS}, w AS (SELECT *, {WEIGHTS['time_decay']} / sum({WEIGHTS['time_decay']}) OVER (PARTITION BY conversion_id) AS w FROM p) SELECT channel, round(sum(w), 6) AS attributed_conversions FROM w GROUP BY 1""")
def attribution_normalized_decay(spark, sf):
    made = at.attributed(found_paths(spark, sf), "time_decay", normalize=True)
    return made.groupBy("channel").agg(F.round(F.sum("attribution_weight"), 6).alias("attributed_conversions"))


@query(f"WITH {PATHS} " + " UNION ALL ".join(f"SELECT '{m}' AS model, channel, round(sum({w}), 6) AS attributed_conversions, round(sum({w} * conversion_value), 4) AS attributed_revenue FROM p GROUP BY channel" for m, w in WEIGHTS.items()))
def attribution_model_comparison(spark, sf):
    return r(r(at.compare_models(found_paths(spark, sf)), "attributed_conversions"), "attributed_revenue", digits=4)


@query(f"WITH {PATHS} SELECT conversion_id, user_id, string_agg(channel, ' > ' ORDER BY pos) AS channel_path, max(n) AS path_length, round(max(h), 6) AS path_hours, round(1.0 / max(n), 6) AS path_efficiency FROM p GROUP BY 1, 2")
def attribution_path_analysis(spark, sf):
    return r(at.path_summary(found_paths(spark, sf)), "path_hours", "path_efficiency")


@query(f"WITH {PATHS} SELECT count(DISTINCT conversion_id) AS attributed, count(*) AS touchpoints, round(sum(conversion_value / n), 4) AS attributed_revenue, (SELECT count(*) FROM conversions) AS conversions, round(count(DISTINCT conversion_id) / (SELECT count(*) FROM conversions), 6) AS attribution_rate FROM p")
def attribution_summary(spark, sf):
    made = at.attribution_summary(at.attributed(found_paths(spark, sf)), market(spark, sf)[1])
    return r(r(made, "attribution_rate"), "attributed_revenue", digits=4)


@query(f"""WITH {MARKET}, i AS (SELECT channel, count(*) AS impressions FROM touches WHERE event_type = 'view' GROUP BY 1), c AS (SELECT channel, count(*) AS clicks FROM touches WHERE event_type = 'click' GROUP BY 1), v AS (SELECT channel, count(*) AS conversions FROM conversions GROUP BY 1)
  SELECT channel, coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks, coalesce(conversions, 0) AS conversions, round(clicks / impressions, 6) AS click_through_rate, round(conversions / clicks, 6) AS click_conversion_rate, round(conversions / impressions, 6) AS overall_conversion_rate
  FROM i FULL JOIN c USING (channel) FULL JOIN v USING (channel)""")
def channel_funnel(spark, sf):
    touches, conversions = market(spark, sf)
    made = at.channel_funnel(touches.filter("event_type = 'view'"), touches.filter("event_type = 'click'"), conversions)
    return r(made, "click_through_rate", "click_conversion_rate", "overall_conversion_rate")


CAMP = f"""{MARKET}, {CAMPAIGNS}, t AS (SELECT campaign_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, count(*) AS touches, count(DISTINCT user_id) AS users FROM touches GROUP BY 1, 2),
  v AS (SELECT campaign_id, strftime(date_trunc('week', conversion_ts), '%Y-%m-%d') AS period, count(*) AS conversions, sum(conversion_value) AS revenue FROM conversions GROUP BY 1, 2),
  m AS (SELECT campaign_id, campaign_spend, period, coalesce(touches, 0) AS touches, coalesce(users, 0) AS users, coalesce(conversions, 0) AS conversions, coalesce(revenue, 0) AS revenue FROM campaigns LEFT JOIN (t FULL JOIN v USING (campaign_id, period)) USING (campaign_id))"""


def camp(spark, sf):
    touches, conversions = market(spark, sf)
    return at.campaign_metrics(campaigns(spark), touches, conversions, "week")


@query(f"WITH {CAMP} SELECT campaign_id, period, touches, users, conversions, round(revenue, 4) AS revenue, round(conversions / nullif(touches, 0), 6) AS conversion_rate, round(CAST(revenue / campaign_spend AS DOUBLE), 6) AS roas, round(CAST(campaign_spend AS DOUBLE) / nullif(conversions, 0), 6) AS cost_per_conversion FROM m")
def campaign_metrics(spark, sf):
    return r(r(camp(spark, sf), "conversion_rate", "roas", "cost_per_conversion"), "revenue", digits=4).drop("campaign_spend")


@query(f"""WITH {CAMP}, e AS (SELECT campaign_id, CAST(max(campaign_spend) AS DOUBLE) AS s, sum(revenue) AS v, CAST(sum(conversions) AS BIGINT) AS n, CAST(sum(touches) AS BIGINT) AS t FROM m GROUP BY 1)
  SELECT campaign_id, s AS campaign_spend, round(v, 4) AS total_conversion_value, n AS total_conversions, t AS total_touchpoints, round(v / s, 6) AS return_on_ad_spend, round((n / nullif(t, 0)) * (v / s) / nullif(s / nullif(n, 0), 0), 9) AS efficiency_score,
  CASE WHEN v / s >= 4 THEN 'High Performer' WHEN v / s >= 2 THEN 'Good Performer' WHEN v / s >= 1 THEN 'Break Even' ELSE 'Underperformer' END AS effectiveness_category, CAST(row_number() OVER (ORDER BY v / s DESC, campaign_id) AS INTEGER) AS roas_rank FROM e""")
def campaign_effectiveness(spark, sf):
    return r(r(r(at.effectiveness(camp(spark, sf)), "return_on_ad_spend"), "efficiency_score", digits=9), "total_conversion_value", digits=4)


@query(f"""WITH {MARKET}, t AS (SELECT channel, count(*) AS n, count(DISTINCT user_id) AS users, avg(engagement_score) AS engagement FROM touches GROUP BY 1), v AS (SELECT channel, count(*) AS conversions, sum(conversion_value) AS revenue, avg(conversion_value) AS mean FROM conversions GROUP BY 1)
  SELECT channel, coalesce(n, 0) AS total_touchpoints, coalesce(users, 0) AS unique_users, round(coalesce(engagement, 0), 6) AS avg_engagement_score, coalesce(conversions, 0) AS total_conversions, round(coalesce(revenue, 0), 4) AS total_revenue, round(coalesce(mean, 0), 6) AS avg_order_value,
  round(coalesce(conversions, 0) / nullif(users, 0), 6) AS conversion_rate, round(coalesce(revenue, 0) / nullif(users, 0), 6) AS revenue_per_user FROM t FULL JOIN v USING (channel)""")
def channel_performance(spark, sf):
    return r(r(at.channel_performance(*market(spark, sf)), "avg_engagement_score", "avg_order_value", "conversion_rate", "revenue_per_user"), "total_revenue", digits=4)


@query(f"""WITH {MARKET}, t AS (SELECT creative_id, channel, count(*) AS touches FROM touches GROUP BY 1, 2), v AS (SELECT creative_id, channel, count(*) AS conversions, sum(conversion_value) AS revenue FROM conversions GROUP BY 1, 2)
  SELECT creative_id, channel, coalesce(touches, 0) AS touches, coalesce(conversions, 0) AS conversions, round(coalesce(revenue, 0), 4) AS revenue, round(coalesce(conversions, 0) / nullif(touches, 0), 6) AS conversion_rate FROM t FULL JOIN v USING (creative_id, channel)""")
def creative_performance(spark, sf):
    return r(r(at.creative_performance(*market(spark, sf)), "conversion_rate"), "revenue", digits=4)


@query(f"""WITH {CAMP}, e AS (SELECT campaign_id, CAST(max(campaign_spend) AS DOUBLE) AS spend, sum(revenue) AS revenue FROM m GROUP BY 1), s AS (SELECT *, spend / sum(spend) OVER () AS a, revenue / sum(revenue) OVER () AS b FROM e)
  SELECT campaign_id, spend AS campaign_spend, round(revenue, 4) AS total_conversion_value, round(a, 6) AS spend_share, round(b, 6) AS revenue_share, round(b / a, 6) AS efficiency_ratio, CASE WHEN b / a > 1.2 THEN 'Increase Budget' WHEN b / a < 0.8 THEN 'Decrease Budget' ELSE 'Maintain Budget' END AS budget_recommendation FROM s""")
def budget_efficiency(spark, sf):
    return r(r(at.budget_efficiency(camp(spark, sf)), "spend_share", "revenue_share", "efficiency_ratio"), "total_conversion_value", digits=4)


@query(f"""WITH {CAMP}, l AS (SELECT campaign_id, period, revenue / CAST(campaign_spend AS DOUBLE) AS roas, lag(revenue / CAST(campaign_spend AS DOUBLE)) OVER (PARTITION BY campaign_id ORDER BY period) AS b FROM m), c AS (SELECT *, (roas - b) / nullif(b, 0) AS ch FROM l)
  SELECT campaign_id, period, round(ch, 6) AS roas_change, CASE WHEN ch > 0.1 THEN 'Improving' WHEN ch < -0.1 THEN 'Declining' ELSE 'Stable' END AS trend FROM c""")
def campaign_performance_trends(spark, sf):
    return r(at.performance_trends(camp(spark, sf)), "roas_change").select("campaign_id", "period", "roas_change", "trend")


@query(f"""WITH {CAMP}, e AS (SELECT campaign_id, CAST(max(campaign_spend) AS DOUBLE) AS spend, sum(revenue) AS revenue, sum(conversions) AS conversions FROM m GROUP BY 1)
  SELECT count(*) AS campaigns, sum(spend) AS total_spend, round(sum(revenue), 4) AS total_revenue, CAST(sum(conversions) AS BIGINT) AS total_conversions, round(sum(revenue) / sum(spend), 6) AS overall_roas, round(sum(spend) / sum(conversions), 6) AS overall_cpa FROM e""")
def campaign_summary(spark, sf):
    return r(r(at.campaign_summary(camp(spark, sf)), "overall_roas", "overall_cpa"), "total_revenue", digits=4)


CAC = f"""{MARKET}, s AS (SELECT channel, sum(spend_amount) AS spend FROM spend GROUP BY 1), a AS (SELECT acquisition_channel AS channel, count(*) AS acquisitions, avg(first_purchase_value) AS v FROM acq GROUP BY 1),
  cac AS (SELECT channel, coalesce(spend, 0) AS spend, coalesce(acquisitions, 0) AS acquisitions, v, spend / nullif(acquisitions, 0) AS cac, v / nullif(spend / nullif(acquisitions, 0), 0) AS ratio FROM s FULL JOIN a USING (channel))"""


@query(f"""WITH {CAC} SELECT channel, round(spend, 4) AS spend, acquisitions, round(v, 6) AS avg_first_value, round(cac, 6) AS cac, round(ratio, 6) AS ltv_cac_ratio, CASE WHEN ratio >= 3 THEN 'Excellent' WHEN ratio >= 2 THEN 'Good' WHEN ratio >= 1 THEN 'Acceptable' ELSE 'Poor' END AS rating,
  CASE WHEN ratio >= 3 THEN 'Scale Up' WHEN ratio >= 2 THEN 'Maintain' WHEN ratio >= 1 THEN 'Optimize' ELSE 'Consider Pausing' END AS advice FROM cac""")
def cac_by_channel(spark, sf):
    return r(r(at.acquisition_cost(spending(spark, sf), acquired(spark, sf)), "avg_first_value", "cac", "ltv_cac_ratio"), "spend", digits=4)


@query(f"""WITH {PATHS}, s AS (SELECT channel, sum(spend_amount) AS spend FROM spend GROUP BY 1), a AS (SELECT channel, sum(1.0 / n) AS w, sum(conversion_value / n) AS v FROM p GROUP BY 1)
  SELECT channel, round(coalesce(spend, 0), 4) AS spend, round(CAST(coalesce(w, 0) AS DOUBLE), 6) AS attributed_acquisitions, round(coalesce(v, 0), 4) AS attributed_value, round(spend / w, 6) AS attributed_cac FROM s FULL JOIN a USING (channel)""")
def cac_attributed(spark, sf):
    return r(r(at.attributed_acquisition_cost(spending(spark, sf), at.attributed(found_paths(spark, sf))), "attributed_acquisitions", "attributed_cac"), "spend", "attributed_value", digits=4)


@query(f"""WITH {MARKET}, s AS (SELECT channel, strftime(spend_date, '%Y-%m') AS cohort, sum(spend_amount) AS spend FROM spend GROUP BY 1, 2), a AS (SELECT acquisition_channel AS channel, strftime(acquisition_ts, '%Y-%m') AS cohort, count(*) AS acquisitions, sum(first_purchase_value) AS value FROM acq GROUP BY 1, 2)
  SELECT channel, cohort, round(coalesce(spend, 0), 4) AS spend, coalesce(acquisitions, 0) AS acquisitions, round(coalesce(value, 0), 4) AS value, round(spend / nullif(acquisitions, 0), 6) AS cohort_cac FROM s FULL JOIN a USING (channel, cohort)""")
def cac_cohorts(spark, sf):
    return r(r(at.acquisition_cohorts(spending(spark, sf), acquired(spark, sf)), "cohort_cac"), "spend", "value", digits=4)


@query(f"""WITH {CAC}, e AS (SELECT channel, cac / avg(cac) OVER () AS x, v / avg(v) OVER () AS y FROM cac) SELECT channel, round(x, 6) AS cac_vs_average, round(y, 6) AS value_vs_average, round(y / nullif(x, 0), 6) AS efficiency_index, CAST(row_number() OVER (ORDER BY y / nullif(x, 0) DESC NULLS LAST, channel) AS INTEGER) AS priority, CASE WHEN y / nullif(x, 0) > 1.2 THEN 'High Priority' WHEN y / nullif(x, 0) > 0.8 THEN 'Medium Priority' ELSE 'Low Priority' END AS channel_priority FROM e""")
def cac_channel_efficiency(spark, sf):
    made = at.channel_efficiency(at.acquisition_cost(spending(spark, sf), acquired(spark, sf)))
    return r(made, "cac_vs_average", "value_vs_average", "efficiency_index").select("channel", "cac_vs_average", "value_vs_average", "efficiency_index", "priority", "channel_priority")


@query(f"WITH {CAC} SELECT round(sum(spend), 4) AS total_spend, CAST(sum(acquisitions) AS BIGINT) AS total_acquisitions, count(*) AS channels, round(min(cac), 6) AS best_cac, round(max(cac), 6) AS worst_cac, round(sum(spend) / sum(acquisitions), 6) AS blended_cac FROM cac")
def cac_summary(spark, sf):
    return r(r(at.acquisition_summary(at.acquisition_cost(spending(spark, sf), acquired(spark, sf))), "best_cac", "worst_cac", "blended_cac"), "total_spend", digits=4)


ROI = f"""{PATHS}, s AS (SELECT channel, campaign_id, strftime(date_trunc('week', spend_date), '%Y-%m-%d') AS period, sum(spend_amount) AS spend FROM spend GROUP BY 1, 2, 3), v AS (SELECT channel, campaign_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, sum(conversion_value / n) AS revenue FROM p GROUP BY 1, 2, 3),
  m AS (SELECT channel, campaign_id, period, spend, coalesce(revenue, 0) AS revenue FROM s LEFT JOIN v USING (channel, campaign_id, period))"""
CLASS = "CASE WHEN (sum(revenue) - sum(spend)) / sum(spend) > 2 THEN 'High' WHEN (sum(revenue) - sum(spend)) / sum(spend) > 0.5 THEN 'Medium' WHEN (sum(revenue) - sum(spend)) / sum(spend) > 0 THEN 'Low' ELSE 'Negative' END AS roi_category"
SUMS = "round(sum(spend), 4) AS spend, round(sum(revenue), 4) AS revenue, round((sum(revenue) - sum(spend)) / sum(spend), 6) AS roi, round(sum(revenue) / sum(spend), 6) AS roas"


def returns(spark, sf):
    return at.roi(spending(spark, sf), at.attributed(found_paths(spark, sf)), "week")


def sums(df):
    return r(r(df, "roi", "roas"), "spend", "revenue", digits=4)


@query(f"WITH {ROI} SELECT channel, campaign_id, period, round(spend, 4) AS spend, round(revenue, 4) AS revenue, round((revenue - spend) / spend, 6) AS roi, round(revenue / spend, 6) AS roas FROM m")
def marketing_roi(spark, sf):
    return sums(returns(spark, sf))


@query(f"WITH {ROI} SELECT channel, {SUMS}, {CLASS} FROM m GROUP BY 1")
def roi_by_channel(spark, sf):
    return sums(at.roi_by(returns(spark, sf), "channel"))


@query(f"WITH {ROI} SELECT campaign_id, {SUMS}, {CLASS} FROM m GROUP BY 1")
def roi_by_campaign(spark, sf):
    return sums(at.roi_by(returns(spark, sf), "campaign_id"))


@query(f"""WITH {ROI}, a AS (SELECT sum(spend) AS s, sum(revenue) AS v, avg((revenue - spend) / spend) AS x, avg(revenue / spend) AS y, count(*) AS n FROM m) SELECT round(s, 4) AS total_marketing_spend, round(v, 4) AS total_attributed_revenue, round(x, 6) AS average_campaign_roi, round(y, 6) AS average_campaign_roas, n AS total_campaigns_analyzed,
  round((v - s) / s, 6) AS overall_roi, round(v / s, 6) AS overall_roas, CASE WHEN (v - s) / s > 2 THEN 'Excellent' WHEN (v - s) / s > 0.5 THEN 'Good' ELSE 'Poor' END AS roi_efficiency FROM a""")
def roi_summary(spark, sf):
    made = at.roi_summary(returns(spark, sf))
    return r(r(made, "average_campaign_roi", "average_campaign_roas", "overall_roi", "overall_roas"), "total_marketing_spend", "total_attributed_revenue", digits=4)


@query(f"WITH {ROI}, g AS (SELECT channel, period, (sum(revenue) - sum(spend)) / sum(spend) AS roi FROM m GROUP BY 1, 2) SELECT channel, period, round(roi, 6) AS roi, round(roi - lag(roi) OVER (PARTITION BY channel ORDER BY period), 6) AS roi_change FROM g")
def roi_trends(spark, sf):
    return r(at.roi_trends(returns(spark, sf)), "roi", "roi_change").select("channel", "period", "roi", "roi_change")


@query(f"WITH {ROI}, g AS (SELECT channel, campaign_id, (sum(revenue) - sum(spend)) / sum(spend) AS roi FROM m GROUP BY 1, 2) SELECT channel, campaign_id, round(roi, 6) AS roi, CAST(ntile(10) OVER w AS INTEGER) AS decile, CASE WHEN ntile(10) OVER w <= 2 THEN 'Top Performer' WHEN ntile(10) OVER w <= 5 THEN 'Above Average' WHEN ntile(10) OVER w <= 8 THEN 'Average' ELSE 'Below Average' END AS performance_tier FROM g WINDOW w AS (ORDER BY roi DESC NULLS LAST, channel, campaign_id)")
def roi_efficiency_tiers(spark, sf):
    return r(at.efficiency_tiers(returns(spark, sf)), "roi").select("channel", "campaign_id", "roi", "decile", "performance_tier")


@query(f"""WITH {ROI}, g AS (SELECT channel, sum(spend) AS spend, greatest((sum(revenue) - sum(spend)) / sum(spend), 0) AS x FROM m GROUP BY 1), h AS (SELECT channel, spend / sum(spend) OVER () AS a, coalesce(x / nullif(sum(x) OVER (), 0), spend / sum(spend) OVER ()) AS b FROM g)
  SELECT channel, round(a, 6) AS current_share, round(b, 6) AS ideal_share, round(a + greatest(-0.05, least(0.05, b - a)), 6) AS recommended_share FROM h""")
def roi_budget_optimization(spark, sf):
    made = at.budget_shift(at.roi_by(returns(spark, sf), "channel"))
    return r(made, "current_share", "ideal_share", "recommended_share").select("channel", "current_share", "ideal_share", "recommended_share")


@query(f"""WITH {PATHS}, s AS (SELECT channel, strftime(date_trunc('week', spend_date), '%Y-%m-%d') AS period, sum(spend_amount) AS spend FROM spend GROUP BY 1, 2), v AS (SELECT channel, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, sum(conversion_value / n) AS revenue FROM p GROUP BY 1, 2),
  a AS (SELECT channel, period, spend - lag(spend) OVER (PARTITION BY channel ORDER BY period) AS ds FROM s), b AS (SELECT channel, period, revenue - lag(revenue) OVER (PARTITION BY channel ORDER BY period) AS dr FROM v)
  SELECT channel, period, round(ds, 4) AS spend_change, round(dr, 4) AS revenue_change, round(dr / nullif(ds, 0), 4) AS incremental_return FROM a JOIN b USING (channel, period)""")
def marketing_incremental(spark, sf):
    made = at.incremental(spending(spark, sf), at.attributed(found_paths(spark, sf)), "week")
    return r(made, "spend_change", "revenue_change", "incremental_return", digits=4).select("channel", "period", "spend_change", "revenue_change", "incremental_return")
