"""Registered queries: geography and seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import geo
from tidemill.plans.bindings import AS_OF, CUSTOMERS, LINES, TX, customers, lines, transactions
from tidemill.plans.registry import query

GEO = f"{TX}, {CUSTOMERS}, g AS (SELECT tx.*, country, region, city FROM tx JOIN customers USING (customer_id))"


def placed(spark, sf):
    return geo.with_places(transactions(spark, sf), customers(spark, sf))


def r(df, *names, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in names})


def level_sql(cols, least):
    return f"WITH {GEO} SELECT {cols}, round(sum(amount), 2) AS total_revenue, count(*) AS transactions, round(avg(amount), 5) AS avg_transaction, count(customer_id) AS customer_rows, count(DISTINCT customer_id) AS unique_customers FROM g GROUP BY {cols} HAVING count(*) >= {least}"


def level(spark, sf, cols, least):
    return r(r(geo.distribution(placed(spark, sf), cols, least), "total_revenue", digits=2), "avg_transaction", digits=5).drop("first_ts", "last_ts")


@query(level_sql("country", 10))
def geo_country_distribution(spark, sf):
    return level(spark, sf, ["country"], 10)


@query(level_sql("country, region", 10))
def geo_region_distribution(spark, sf):
    return level(spark, sf, ["country", "region"], 10)


@query(level_sql("country, region, city", 3))
def geo_city_distribution(spark, sf):
    return level(spark, sf, ["country", "region", "city"], 3)


@query(f"WITH {GEO}, p AS (SELECT country, strftime(ts, '%Y-%m') AS period, sum(amount) AS revenue, count(*) AS transactions FROM g GROUP BY 1, 2) SELECT country, period, round(revenue, 2) AS revenue, transactions, round(100 * (revenue - lag(revenue) OVER w) / lag(revenue) OVER w, 4) AS growth_pct FROM p WINDOW w AS (PARTITION BY country ORDER BY period)")
def geo_performance(spark, sf):
    return r(r(geo.performance(placed(spark, sf)), "revenue", digits=2), "growth_pct")


@query(f"WITH {GEO}, p AS (SELECT country, sum(amount) AS revenue FROM g GROUP BY 1) SELECT country, round(revenue, 2) AS revenue, round(100 * revenue / sum(revenue) OVER (), 6) AS share_pct, round(100 * sum(revenue) OVER (ORDER BY revenue DESC, country ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER (), 6) AS cumulative_pct FROM p")
def geo_concentration(spark, sf):
    return r(r(geo.concentration(placed(spark, sf)), "revenue", digits=2), "share_pct", "cumulative_pct", digits=6)


@query(f"WITH {GEO} SELECT count(DISTINCT country) AS countries, count(DISTINCT region) AS regions, count(DISTINCT city) AS cities, count(country) AS country_rows, round(sum(amount), 2) AS total_revenue, count(*) AS transactions, round(avg(amount), 4) AS avg_transaction FROM g")
def geo_summary(spark, sf):
    return r(r(geo.summary(placed(spark, sf)), "total_revenue", digits=2), "avg_transaction")


def season_sql(select, names):
    return f"WITH {TX}, p AS (SELECT {select}, sum(amount) AS revenue, count(*) AS transactions, avg(amount) AS a FROM tx GROUP BY ALL) SELECT {names}, round(revenue, 2) AS revenue, transactions, round(a, 5) AS avg_transaction, round(100 * revenue / sum(revenue) OVER (), 6) AS share_pct FROM p"


def season(spark, sf, *by):
    return r(r(r(geo.seasonal(transactions(spark, sf), list(by)), "revenue", digits=2), "avg_transaction", digits=5), "share_pct", digits=6)


@query(season_sql("CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month", "year, month"))
def season_monthly(spark, sf):
    return season(spark, sf, "year", "month")


@query(season_sql("CAST(year(ts) AS INTEGER) AS year, CAST(quarter(ts) AS INTEGER) AS quarter", "year, quarter"))
def season_quarterly(spark, sf):
    return season(spark, sf, "year", "quarter")


@query(season_sql("CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week", "day_of_week"))
def season_weekly(spark, sf):
    return season(spark, sf, "day_of_week")


@query(season_sql("CAST(day(ts) AS INTEGER) AS day_of_month", "day_of_month"))
def season_daily(spark, sf):
    return season(spark, sf, "day_of_month")


@query(f"WITH {TX}, h AS (SELECT *, CASE strftime(ts, '%m-%d') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in geo.HOLIDAYS.items()) + " END AS holiday FROM tx) SELECT holiday, CAST(year(ts) AS INTEGER) AS year, round(sum(amount), 2) AS revenue, count(*) AS transactions, round(avg(amount), 5) AS avg_transaction FROM h WHERE holiday IS NOT NULL GROUP BY 1, 2")
def season_holidays(spark, sf):
    return r(r(geo.holidays(transactions(spark, sf)), "revenue", digits=2), "avg_transaction", digits=5)


@query(f"""WITH {TX}, m AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, sum(amount) AS revenue FROM tx GROUP BY 1), a AS (SELECT month, revenue, avg(revenue) OVER (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ma, avg(revenue) OVER (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS t FROM m)
  SELECT month, round(revenue, 2) AS revenue, round(ma, 4) AS ma_3, round(t, 4) AS trend, round(ma - t, 4) AS seasonal, round(revenue - ma, 4) AS residual FROM a""")
def season_decomposition(spark, sf):
    return r(r(geo.decompose(transactions(spark, sf)), "revenue", digits=2), "ma_3", "trend", "seasonal", "residual")


@query(f"WITH {LINES}, p AS (SELECT category, CAST(month(ts) AS INTEGER) AS month, sum(revenue) AS revenue, count(*) AS transactions FROM lines GROUP BY 1, 2) SELECT category, month, round(revenue, 2) AS revenue, transactions, round(revenue / avg(revenue) OVER (PARTITION BY category), 6) AS seasonal_index FROM p")
def season_category(spark, sf):
    return r(r(geo.category_seasonality(lines(spark, sf)), "revenue", digits=2), "seasonal_index", digits=6)


def demand_sql(base, cols, value):
    return f"""WITH {base}, p AS (SELECT {cols}, strftime(ts, '%Y-%m') AS period, sum({value}) AS revenue FROM g GROUP BY ALL), l AS (SELECT *, lag(revenue) OVER w AS l1, lag(revenue, 2) OVER w AS l2 FROM p WINDOW w AS (PARTITION BY {cols} ORDER BY period))
      SELECT {cols}, period, round(revenue, 2) AS revenue, round(l1, 2) AS lag_1, round(l2, 2) AS lag_2, round((revenue - l1) / nullif(l1, 0), 6) AS trend, round(revenue * (1 + coalesce((revenue - l1) / nullif(l1, 0), 0)), 4) AS forecast FROM l"""


def demanded(df):
    return r(r(r(df, "revenue", "lag_1", "lag_2", digits=2), "trend", digits=6), "forecast")


@query(demand_sql(GEO, "country", "amount"))
def demand_country(spark, sf):
    return demanded(geo.demand(placed(spark, sf), ["country"]))


@query(demand_sql(GEO, "region", "amount"))
def demand_region(spark, sf):
    return demanded(geo.demand(placed(spark, sf), ["region"]))


PRODUCT_GEO = f"{LINES}, {CUSTOMERS}, g AS (SELECT lines.*, region FROM lines JOIN customers USING (customer_id))"


@query(demand_sql(PRODUCT_GEO, "region, category", "revenue"))
def demand_product_region(spark, sf):
    df = lines(spark, sf).join(customers(spark, sf).select("customer_id", "region"), "customer_id")
    return demanded(geo.demand(df, ["region", "category"], value="revenue"))


def total_sql(level):
    return f"SELECT '{level}' AS level, count(*) AS rows, round(sum(f), 2) AS total_forecast, round(avg(t), 6) AS avg_trend FROM (SELECT revenue * (1 + coalesce((revenue - l1) / l1, 0)) AS f, (revenue - l1) / l1 AS t FROM (SELECT revenue, lag(revenue) OVER (PARTITION BY {level} ORDER BY period) AS l1 FROM (SELECT {level}, strftime(ts, '%Y-%m') AS period, sum(amount) AS revenue FROM g GROUP BY ALL)))"


@query(f"WITH {GEO} {total_sql('country')} UNION ALL {total_sql('region')}")
def demand_summary(spark, sf):
    made = placed(spark, sf)
    return r(r(geo.forecast_summary(geo.demand(made, ["country"]), geo.demand(made, ["region"])), "total_forecast", digits=2), "avg_trend", digits=6)


@query(f"WITH {GEO} SELECT count(*) AS rows, round(avg(amount), 4) AS mean, round(stddev(amount), 4) AS stddev, min(ts) AS first_ts, max(ts) AS last_ts FROM g")
def demand_accuracy(spark, sf):
    return r(geo.accuracy(placed(spark, sf)), "mean", "stddev")


@query(f"""WITH {TX}, {CUSTOMERS}, s AS (SELECT customer_id, sum(amount) AS total_spent, count(*) AS orders, avg(amount) AS avg_order, max(ts) AS l FROM tx GROUP BY 1)
  SELECT customer_id, round(total_spent, 2) AS total_spent, orders, round(avg_order, 5) AS avg_order, CAST(date_diff('day', CAST(l AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_since_last,
  round(2 * 6371.0 * asin(sqrt(least(pow(sin(radians(0 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(0)) * pow(sin(radians(0 - longitude) / 2), 2), 1.0))), 2) AS geographic_distance FROM customers JOIN s USING (customer_id)""")
def geo_customer_features(spark, sf):
    made = geo.customer_features(customers(spark, sf), transactions(spark, sf), AS_OF)
    return r(r(made, "total_spent", digits=2), "avg_order", digits=5).select("customer_id", "total_spent", "orders", "avg_order", "days_since_last", "geographic_distance")


def clustered(spark, sf):
    return geo.cluster(geo.customer_features(customers(spark, sf), transactions(spark, sf), AS_OF))


@query()
def geo_clusters(spark, sf):
    return geo.clusters(clustered(spark, sf))


@query()
def geo_cluster_places(spark, sf):
    return geo.cluster_places(clustered(spark, sf))


@query()
def geo_cluster_performance(spark, sf):
    return geo.cluster_performance(clustered(spark, sf), transactions(spark, sf))
