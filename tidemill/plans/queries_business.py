"""Registered queries: revenue and products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.tables import written
from tidemill.operators import product, revenue
from tidemill.plans.bindings import AS_OF, LINES, TX, customers, CUSTOMERS, lines, table, transactions
from tidemill.plans.registry import query

REV = f"{TX}, r AS (SELECT *, amount AS revenue FROM tx)"


def rev(spark, sf):
    return transactions(spark, sf).withColumn("revenue", F.col("amount"))


def rounded(df, *names, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in names})


KPIS = "round(sum(revenue), 2) AS total_revenue, count(*) AS transactions, count(DISTINCT customer_id) AS customers, round(avg(revenue), 7) AS avg_order_value, round(min(revenue), 7) AS min_order_value, round(max(revenue), 7) AS max_order_value, round(stddev(revenue), 7) AS stddev_order_value, round(sum(revenue) / count(DISTINCT customer_id), 7) AS revenue_per_customer"


def kpi(df):
    return rounded(rounded(df, "avg_order_value", "min_order_value", "max_order_value", "stddev_order_value", "revenue_per_customer", digits=7), "total_revenue", digits=2)


@query(f"WITH {REV} SELECT strftime(ts, '%Y-%m') AS period, {KPIS} FROM r GROUP BY 1")
def revenue_by_period(spark, sf):
    return kpi(revenue.by_period(rev(spark, sf)))


@query(f"WITH {REV} SELECT year(ts) || '-Q' || quarter(ts) AS period, payment_method, {KPIS} FROM r GROUP BY 1, 2")
def revenue_by_dimension(spark, sf):
    return kpi(revenue.by_period(rev(spark, sf), "quarter", ["payment_method"]))


@query(f"WITH {LINES}, {CUSTOMERS} SELECT strftime(ts, '%Y') AS period, segment, region, category, {KPIS} FROM lines JOIN customers USING (customer_id) GROUP BY 1, 2, 3, 4 HAVING sum(revenue) > 0")
def revenue_cross_dimensional(spark, sf):
    df = lines(spark, sf).join(customers(spark, sf), "customer_id")
    return kpi(revenue.cross_dimensional(df, ["segment", "region", "category", "city"], "year"))


@query(f"WITH {LINES}, {CUSTOMERS} SELECT segment, region, category, grouping_id(segment, region, category) AS grouping_id, round(sum(revenue), 2) AS total_revenue, count(*) AS transactions FROM lines JOIN customers USING (customer_id) GROUP BY CUBE (segment, region, category)")
def revenue_cube(spark, sf):
    df = lines(spark, sf).join(customers(spark, sf), "customer_id")
    return rounded(revenue.cube(df, ["segment", "region", "category"]), "total_revenue", digits=2)


@query(f"""WITH {REV}, g AS (SELECT customer_id, sum(revenue) AS revenue FROM r GROUP BY 1) SELECT customer_id, round(revenue, 2) AS revenue, row_number() OVER w AS row_rank, round(100 * revenue / sum(revenue) OVER (), 6) AS share,
  round(100 * sum(revenue) OVER (ORDER BY revenue DESC, customer_id ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER (), 6) AS cumulative_share FROM g WINDOW w AS (ORDER BY revenue DESC, customer_id)""")
def revenue_pareto(spark, sf):
    return rounded(rounded(revenue.concentration(rev(spark, sf), "customer_id"), "share", "cumulative_share", digits=6), "revenue", digits=2)


DAILY = f"{REV}, d AS (SELECT CAST(ts AS DATE) AS day, sum(revenue) AS revenue, count(*) AS transactions FROM r GROUP BY 1)"


@query(f"WITH {DAILY} SELECT day, round(revenue, 2) AS revenue, transactions FROM d")
def revenue_daily_series(spark, sf):
    return rounded(revenue.daily(rev(spark, sf)), "revenue", digits=2)


@query(f"WITH {DAILY} SELECT day, " + ", ".join(f"round(avg(revenue) OVER (ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 4) AS ma_{n}" for n in (7, 14, 30, 90)) + " FROM d")
def revenue_moving_averages(spark, sf):
    names = [f"ma_{n}" for n in (7, 14, 30, 90)]
    return rounded(revenue.moving_averages(revenue.daily(rev(spark, sf))), *names).select("day", *names)


@query(f"WITH {DAILY} SELECT day, " + ", ".join(f"round(100 * (revenue - lag(revenue, {n}) OVER (ORDER BY day)) / nullif(lag(revenue, {n}) OVER (ORDER BY day), 0), 4) AS growth_{n}" for n in (7, 30, 90, 365)) + " FROM d")
def revenue_growth_ma(spark, sf):
    names = [f"growth_{n}" for n in (7, 30, 90, 365)]
    return rounded(revenue.growth_rates(revenue.daily(rev(spark, sf))), *names).select("day", *names)


@query(f"WITH {DAILY} SELECT day, " + ", ".join(f"round(lag(revenue, {n}) OVER (ORDER BY day), 2) AS lag_{n}" for n in (1, 7, 14, 30)) + ", " + ", ".join(f"round(avg(revenue) OVER (ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 4) AS ma_{n}" for n in (7, 14, 30)) + ", CAST(dayofweek(day) + 1 AS INTEGER) AS day_of_week, CAST(month(day) AS INTEGER) AS month, CAST(quarter(day) AS INTEGER) AS quarter, CAST(weekofyear(day) AS INTEGER) AS week_of_year FROM d")
def revenue_forecast_features(spark, sf):
    made = rounded(revenue.forecast_features(revenue.daily(rev(spark, sf))), "ma_7", "ma_14", "ma_30")
    made = rounded(made, "lag_1", "lag_7", "lag_14", "lag_30", digits=2)
    return made.select("day", *[f"lag_{n}" for n in (1, 7, 14, 30)], *[f"ma_{n}" for n in (7, 14, 30)], "day_of_week", "month", "quarter", "week_of_year")


@query(f"WITH {DAILY}, z AS (SELECT day, (revenue - avg(revenue) OVER ()) / stddev(revenue) OVER () AS z FROM d) SELECT day, round(z, 6) AS z_score, CASE WHEN z > 2 THEN 'high_outlier' WHEN z < -2 THEN 'low_outlier' ELSE 'normal' END AS anomaly_type FROM z")
def revenue_anomalies(spark, sf):
    return rounded(revenue.anomalies(revenue.daily(rev(spark, sf))), "z_score", digits=6).select("day", "z_score", "anomaly_type")


@query(f"WITH {DAILY} SELECT CAST(dayofweek(day) + 1 AS INTEGER) AS day_of_week, round(avg(revenue), 4) AS avg_revenue, round(stddev(revenue), 4) AS stddev_revenue, count(*) AS days FROM d GROUP BY 1")
def revenue_seasonality_weekday(spark, sf):
    return rounded(revenue.seasonality(revenue.daily(rev(spark, sf))), "avg_revenue", "stddev_revenue")


@query(f"WITH {DAILY} SELECT CAST(month(day) AS INTEGER) AS month, round(avg(revenue), 4) AS avg_revenue, round(stddev(revenue), 4) AS stddev_revenue, count(*) AS days FROM d GROUP BY 1")
def revenue_seasonality_month(spark, sf):
    return rounded(revenue.seasonality(revenue.daily(rev(spark, sf)), "month"), "avg_revenue", "stddev_revenue")


@query(f"""WITH {DAILY}, g AS (SELECT day, 100 * (revenue - lag(revenue, 7) OVER (ORDER BY day)) / lag(revenue, 7) OVER (ORDER BY day) AS g FROM d ORDER BY day DESC LIMIT 30), a AS (SELECT avg(g) AS avg_growth, count(g) AS days FROM g)
  SELECT round(avg_growth, 4) AS avg_growth, days, CASE WHEN avg_growth IS NULL THEN 'insufficient_data' WHEN avg_growth > 15 THEN 'strong_growth' WHEN avg_growth > 2 THEN 'moderate_growth' WHEN avg_growth > -5 THEN 'stable' ELSE 'declining' END AS direction FROM a""")
def revenue_trend_direction(spark, sf):
    return rounded(revenue.trend_direction(revenue.daily(rev(spark, sf))), "avg_growth")


@query(f"""WITH {DAILY}, g AS (SELECT revenue, 100 * (revenue - lag(revenue, 7) OVER w) / lag(revenue, 7) OVER w AS a, 100 * (revenue - lag(revenue, 30) OVER w) / lag(revenue, 30) OVER w AS b FROM d WINDOW w AS (ORDER BY day))
  SELECT round(avg(revenue), 4) AS average_revenue, round(stddev(revenue), 4) AS revenue_volatility, round(min(revenue), 2) AS min_revenue, round(max(revenue), 2) AS max_revenue, round(avg(a), 4) AS avg_weekly_growth_rate, round(avg(b), 4) AS avg_monthly_growth_rate, count(*) AS data_points, round(stddev(revenue) / avg(revenue), 6) AS coefficient_of_variation FROM g""")
def revenue_trend_statistics(spark, sf):
    made = revenue.trend_statistics(revenue.daily(rev(spark, sf)))
    return rounded(rounded(rounded(made, "average_revenue", "revenue_volatility", "avg_weekly_growth_rate", "avg_monthly_growth_rate"), "min_revenue", "max_revenue", digits=2), "coefficient_of_variation", digits=6)


@query(f"""WITH {LINES}, g AS (SELECT brand, sum(revenue) AS revenue, sum(revenue - coalesce(uc * quantity, revenue * 0.65)) AS gm FROM lines LEFT JOIN (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice * 0.7 END AS uc FROM part) ON product_id = p_partkey GROUP BY 1),
  p AS (SELECT brand, revenue, gm, round(100 * gm / revenue, 6) AS gross_margin_pct, gm - revenue * 0.109 - revenue * 0.15 AS nm FROM g)
  SELECT brand, round(revenue, 2) AS revenue, round(gm, 2) AS gross_margin, round(nm, 2) AS net_margin, gross_margin_pct, CASE WHEN gross_margin_pct >= 40 THEN 'High Profit' WHEN gross_margin_pct >= 20 THEN 'Medium Profit' WHEN gross_margin_pct >= 0 THEN 'Low Profit' ELSE 'Loss Making' END AS profitability,
  row_number() OVER (ORDER BY gross_margin_pct DESC, brand) AS margin_rank, round(percent_rank() OVER (ORDER BY gross_margin_pct DESC), 8) AS margin_percent_rank FROM p""")
def revenue_margin_ranking(spark, sf):
    costs = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice") * 0.7).alias("unit_cost"))
    made = revenue.margin_ranking(revenue.margins(lines(spark, sf), costs), "brand")
    return rounded(rounded(made, "revenue", "gross_margin", "net_margin", digits=2), "margin_percent_rank", digits=8)


@query(f"WITH {TX} SELECT status, round(sum(amount * 0.65), 2) AS cogs, round(sum(amount * 0.35), 2) AS gross_margin, round(sum(amount * 0.109), 2) AS operational_costs, round(sum(amount * 0.15), 2) AS marketing_costs, round(sum(amount * 0.091), 2) AS net_margin FROM tx GROUP BY 1")
def revenue_profit_margins(spark, sf):
    names = ["cogs", "gross_margin", "operational_costs", "marketing_costs", "net_margin"]
    return revenue.margins(rev(spark, sf)).groupBy("status").agg(*[F.round(F.sum(c), 2).alias(c) for c in names])


@query()
def revenue_forecast(spark, sf):
    return revenue.forecast(revenue.daily(rev(spark, sf)))


@query(f"""WITH {REV}, d AS (SELECT payment_method, CAST(ts AS DATE) AS day, sum(revenue) AS revenue FROM r GROUP BY 1, 2), t AS (SELECT *, date_diff('day', DATE '1970-01-01', day) AS t FROM d),
  l AS (SELECT payment_method, regr_slope(revenue, t) AS b, regr_intercept(revenue, t) AS a, max(day) AS last FROM t GROUP BY 1 HAVING count(*) >= 90), w AS (SELECT payment_method, dayofweek(day) AS wd, avg(revenue - a - b * t) AS e FROM t JOIN l USING (payment_method) GROUP BY 1, 2),
  x AS (SELECT payment_method, a, b, last + CAST(i AS INTEGER) AS day FROM l, range(1, 31) r(i)) SELECT payment_method, day, round(a + b * date_diff('day', DATE '1970-01-01', day) + coalesce(e, 0), 2) AS forecast FROM x LEFT JOIN w USING (payment_method) WHERE wd = dayofweek(day)""")
def revenue_forecast_by_dimension(spark, sf):
    return rounded(revenue.forecast_by(revenue.daily(rev(spark, sf), "payment_method"), "payment_method"), "forecast", digits=2)


@query()
def revenue_forecast_trees(spark, sf):
    return revenue.forecast(revenue.daily(rev(spark, sf)), kind="random_forest")


@query(f"WITH {LINES} SELECT strftime(ts, '%Y-%m') AS period, round(sum(revenue), 2) AS total_revenue, sum(quantity) AS units_sold, count(*) AS transactions, count(DISTINCT product_id) AS products, count(DISTINCT customer_id) AS customers, round(avg(price), 4) AS avg_price, round(sum(revenue) / count(DISTINCT product_id), 4) AS revenue_per_product FROM lines GROUP BY 1")
def product_overall_performance(spark, sf):
    return rounded(rounded(product.overall(lines(spark, sf)), "avg_price", "revenue_per_product"), "total_revenue", digits=2)


@query(f"""WITH {LINES} SELECT product_id, round(sum(revenue), 2) AS total_revenue, sum(quantity) AS total_units_sold, count(*) AS transaction_count, count(DISTINCT customer_id) AS unique_customers, round(avg(price), 7) AS avg_selling_price, round(min(price), 7) AS min_price, round(max(price), 7) AS max_price,
  round(stddev(price), 7) AS price_volatility, min(category) AS product_category, min(brand) AS brand, round(sum(revenue) / count(DISTINCT customer_id), 7) AS avg_revenue_per_customer, round(sum(quantity) / count(*), 7) AS avg_units_per_transaction,
  round(count(DISTINCT customer_id) / (SELECT count(DISTINCT customer_id) FROM lines), 9) AS customer_penetration_rate FROM lines GROUP BY 1""")
def product_sales_metrics(spark, sf):
    made = rounded(product.sales(lines(spark, sf)), "avg_selling_price", "min_price", "max_price", "price_volatility", "avg_revenue_per_customer", "avg_units_per_transaction", digits=7)
    return rounded(rounded(made, "customer_penetration_rate", digits=9), "total_revenue", digits=2)


def attribute_sql(name):
    return f"WITH {LINES} SELECT {name}, strftime(ts, '%Y') AS period, round(sum(revenue), 2) AS total_revenue, sum(quantity) AS units_sold, count(DISTINCT product_id) AS products, count(DISTINCT customer_id) AS customers FROM lines GROUP BY 1, 2"


@query(attribute_sql("category"))
def product_category_performance(spark, sf):
    return rounded(product.by_attribute(lines(spark, sf), "category", "year"), "total_revenue", digits=2)


@query(attribute_sql("brand"))
def product_brand_performance(spark, sf):
    return rounded(product.by_attribute(lines(spark, sf), "brand", "year"), "total_revenue", digits=2)


@query(f"""WITH {LINES}, d AS (SELECT product_id, CAST(ts AS DATE) AS day, sum(quantity) AS units FROM lines GROUP BY 1, 2), w AS (SELECT product_id, {", ".join(f"sum(units) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS u{n}" for n in (7, 30, 90))} FROM d)
  SELECT product_id, round(avg(u7), 4) AS avg_units_7, round(avg(u30), 4) AS avg_units_30, round(avg(u90), 4) AS avg_units_90, count(*) AS selling_days FROM w GROUP BY 1""")
def product_velocity(spark, sf):
    return rounded(product.velocity(lines(spark, sf)), "avg_units_7", "avg_units_30", "avg_units_90")


@query(f"WITH {LINES}, g AS (SELECT product_id, sum(revenue) AS r, sum(price * quantity * 0.6) AS c FROM lines GROUP BY 1) SELECT product_id, round(r, 2) AS total_revenue, round(c, 2) AS total_cost, round(r - c, 2) AS profit, round(100 * (r - c) / r, 4) AS margin_pct, round(100 * (r - c) / c, 4) AS roi_pct FROM g")
def product_profitability(spark, sf):
    return rounded(rounded(product.profitability(lines(spark, sf)), "total_revenue", "total_cost", "profit", digits=2), "margin_pct", "roi_pct")


@query(f"WITH {LINES}, g AS (SELECT product_id, CAST(month(ts) AS INTEGER) AS month, sum(revenue) AS revenue, sum(quantity) AS units FROM lines GROUP BY 1, 2) SELECT product_id, month, round(revenue, 2) AS revenue, units, round(revenue / avg(revenue) OVER (PARTITION BY product_id), 6) AS seasonal_index FROM g")
def product_seasonal_performance(spark, sf):
    return rounded(rounded(product.seasonal(lines(spark, sf)), "revenue", digits=2), "seasonal_index", digits=6)


@query(f"""WITH {LINES}, s AS (SELECT product_id, sum(quantity) AS units_sold FROM lines GROUP BY 1), i AS (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size * 20 END AS stock_quantity FROM part WHERE p_partkey % 13 > 0)
  SELECT product_id, units_sold, stock_quantity, round(units_sold / nullif(stock_quantity, 0), 8) AS turnover, CASE WHEN stock_quantity IS NULL THEN 'Unknown' WHEN stock_quantity = 0 THEN 'Out of Stock' WHEN units_sold / stock_quantity > 5 THEN 'Fast Moving' WHEN units_sold / stock_quantity > 1 THEN 'Normal' ELSE 'Slow Moving' END AS stock_status FROM s LEFT JOIN i USING (product_id)""")
def product_inventory_turnover(spark, sf):
    stock = table(spark, sf, "part").filter("p_partkey % 13 > 0").select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 11 == 0, 0).otherwise(F.col("p_size") * 20).alias("stock_quantity"))
    return rounded(product.inventory_turnover(lines(spark, sf), stock), "turnover", digits=8)


INTER = f"{LINES}, x AS (SELECT customer_id, product_id, count(*) AS n, sum(quantity) AS quantity, least(5, greatest(1, ln(1 + count(*)) + ln(1 + sum(quantity)))) AS rating FROM lines GROUP BY 1, 2)"


@query(f"WITH {INTER} SELECT customer_id, product_id, n, quantity, round(rating, 6) AS rating FROM x WHERE customer_id IN (SELECT customer_id FROM x GROUP BY 1 HAVING count(*) >= 20) AND product_id IN (SELECT product_id FROM x GROUP BY 1 HAVING count(*) >= 20)")
def product_interactions(spark, sf):
    return rounded(product.frequent_interactions(product.interactions(lines(spark, sf)), 20, 20), "rating", digits=6)


@query(f"""WITH {INTER}, n AS (SELECT product_id, sqrt(sum(rating * rating)) AS norm FROM x GROUP BY 1),
  p AS (SELECT a.product_id AS product_a, b.product_id AS product_b, sum(a.rating * b.rating) AS dot, count(*) AS common FROM x a JOIN x b ON a.customer_id = b.customer_id AND a.product_id < b.product_id GROUP BY 1, 2 HAVING count(*) >= 4)
  SELECT product_a, product_b, common, round(dot / (na.norm * nb.norm), 6) AS similarity FROM p JOIN n na ON na.product_id = product_a JOIN n nb ON nb.product_id = product_b""")
def product_item_similarity(spark, sf):
    return rounded(product.item_similarity(product.interactions(lines(spark, sf)), 4), "similarity", digits=6)


@query(f"WITH {INTER}, f AS (SELECT p_partkey AS product_id, p_type AS category FROM part) SELECT category, list_aggregate(list_sort(list(DISTINCT CAST(product_id AS VARCHAR))), 'string_agg', ',') AS products, count(DISTINCT customer_id) AS users FROM x JOIN f USING (product_id) GROUP BY 1")
def product_content_profiles(spark, sf):
    features = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"))
    made = product.content_profiles(features, lines(spark, sf))  # only who bought what counts
    return made.withColumn("products", F.array_join(F.sort_array(F.transform("products", lambda x: x.cast("string"))), ","))


#: All subsets of all baskets (orders have few lines), those in two baskets or more, and the rules with one consequence.
ITEMSETS = f"""{LINES}, b AS (SELECT transaction_id, list_sort(list(DISTINCT product_id)) AS items FROM lines GROUP BY 1 HAVING count(DISTINCT product_id) >= 2), n AS (SELECT count(*) AS n FROM b),
  m AS (SELECT items, unnest(range(1, CAST(pow(2, len(items)) AS BIGINT))) AS mask FROM b), sets AS (SELECT items, count(*) AS freq, len(items) AS size FROM (SELECT list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items FROM m) GROUP BY items HAVING count(*) >= 2),
  c AS (SELECT items, freq, unnest(items) AS x FROM sets WHERE size >= 2),
  rules AS (SELECT a.items AS antecedent, c.x AS consequent, c.freq / a.freq AS confidence, (c.freq / a.freq) / (o.freq / n) AS lift FROM c JOIN sets a ON a.items = list_filter(c.items, lambda y: y <> c.x) JOIN sets o ON o.items = [c.x], n WHERE c.freq / a.freq >= 0.05)"""


def itemsets(spark, sf):
    """Itemsets in two baskets or more, of any size, and the rules among them."""
    found = written(product.baskets(lines(spark, sf)), "baskets")
    return product.frequent_itemsets(found, 1.5 / max(2, found.count()), 0.05)


def listed(items):
    return F.array_join(F.transform(F.sort_array(items), lambda x: x.cast("string")), ",")


@query(f"WITH {ITEMSETS} SELECT array_to_string(items, ',') AS items, freq, CAST(size AS INTEGER) AS size, round(freq / n, 9) AS support FROM sets, n")
def product_frequent_itemsets(spark, sf):
    return itemsets(spark, sf)[0].select(listed(F.col("items")).alias("items"), "freq", "size", F.round("support", 9).alias("support"))


@query(f"WITH {ITEMSETS} SELECT array_to_string(antecedent, ',') AS antecedent, consequent, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rules")
def product_association_rules(spark, sf):
    rules = itemsets(spark, sf)[1]
    return rounded(rules.select(listed(F.col("antecedent")).alias("antecedent"), F.get("consequent", F.lit(0)).alias("consequent"), "confidence", "lift"), "confidence", "lift", digits=6)


@query(f"WITH {ITEMSETS}, p AS (SELECT unnest(antecedent) AS product_a, consequent AS product_b, confidence, lift FROM rules) SELECT product_a, product_b, round(max(confidence), 6) AS max_confidence, round(max(lift), 6) AS max_lift FROM p GROUP BY 1, 2")
def product_affinity(spark, sf):
    return rounded(product.affinity(itemsets(spark, sf)[1]), "max_confidence", "max_lift", digits=6)


@query(f"WITH {ITEMSETS} SELECT unnest(antecedent) AS product, consequent AS recommended, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rules WHERE confidence > 0.1")
def product_cross_sell(spark, sf):
    return rounded(product.cross_sell(itemsets(spark, sf)[1], 0.1), "confidence", "lift", digits=6)


@query()
def product_recommendations(spark, sf):
    return product.recommend(product.interactions(lines(spark, sf)))


STAGES = f"""{LINES}, d AS (SELECT product_id, CAST(ts AS DATE) AS day, sum(quantity) AS units FROM lines GROUP BY 1, 2), t AS (SELECT *, lag(units, 7) OVER w AS b FROM d WINDOW w AS (PARTITION BY product_id ORDER BY day)),
  l AS (SELECT product_id, avg((units - b) / b) AS avg_growth_rate, stddev((units - b) / b) AS vol, avg(units) AS avg_daily_sales, count(*) AS days_active FROM t GROUP BY 1),
  st AS (SELECT *, CASE WHEN avg_growth_rate > 0.15 THEN 'growth' WHEN avg_growth_rate < -0.10 THEN 'decline' WHEN vol < 0.05 THEN 'maturity' ELSE 'introduction' END AS lifecycle_stage FROM l)"""


def staged(spark, sf):
    return product.lifecycle(product.trends(product.series(lines(spark, sf))))


@query(f"""WITH {STAGES} SELECT product_id, lifecycle_stage, round(avg_growth_rate, 6) AS avg_growth_rate, round(avg_daily_sales, 4) AS avg_daily_sales, days_active,
  round(CASE lifecycle_stage WHEN 'growth' THEN avg_growth_rate * 10 WHEN 'maturity' THEN avg_daily_sales / 100 WHEN 'decline' THEN -avg_growth_rate * 5 ELSE 5 END, 6) AS stage_performance_score FROM st""")
def product_lifecycle_stages(spark, sf):
    made = product.stage_scores(staged(spark, sf)).select("product_id", "lifecycle_stage", "avg_growth_rate", "avg_daily_sales", "days_active", "stage_performance_score")
    return rounded(rounded(made, "avg_growth_rate", "stage_performance_score", digits=6), "avg_daily_sales")


@query(f"WITH {STAGES} SELECT lifecycle_stage, count(*) AS product_count, round(avg(avg_growth_rate), 6) AS avg_stage_growth_rate, round(avg(avg_daily_sales), 4) AS avg_stage_sales, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percentage FROM st GROUP BY 1")
def product_stage_distribution(spark, sf):
    return rounded(rounded(product.stage_distribution(staged(spark, sf)), "avg_stage_growth_rate", digits=6), "avg_stage_sales", "percentage")


@query(f"WITH {STAGES} SELECT product_id, 'risk' AS kind FROM st WHERE lifecycle_stage = 'decline' OR lifecycle_stage = 'maturity' AND avg_growth_rate < 0 UNION ALL SELECT product_id, 'opportunity' FROM st WHERE lifecycle_stage = 'introduction' OR lifecycle_stage = 'growth' AND avg_growth_rate > 0.2")
def product_risks_and_opportunities(spark, sf):
    made = staged(spark, sf)
    return product.at_risk(made).select("product_id", F.lit("risk").alias("kind")).unionByName(product.growth_opportunities(made).select("product_id", F.lit("opportunity").alias("kind")))


@query(f"WITH {STAGES}, la AS (SELECT p_partkey AS product_id, DATE '1995-01-01' + CAST(p_size AS INTEGER) AS launch_date FROM part WHERE p_partkey % 2 = 0) SELECT product_id, lifecycle_stage, CAST(date_diff('day', launch_date, DATE '{AS_OF}') AS INTEGER) AS days_since_launch FROM st LEFT JOIN la USING (product_id)")
def product_launch_performance(spark, sf):
    launched = table(spark, sf, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("product_id"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size")).alias("launch_date"))
    return product.launches(staged(spark, sf), launched, AS_OF).select("product_id", "lifecycle_stage", "days_since_launch")
