"""Geography and seasons: distribution, concentration, demand, seasonal patterns and customer clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.scalars import haversine_km, period, ratio
from tidemill.operators.enrich import calendar

# Month and day of the holidays.
HOLIDAYS = {"01-01": "New Year", "02-14": "Valentines Day", "07-04": "Independence Day", "10-31": "Halloween", "11-25": "Thanksgiving", "12-25": "Christmas"}


def with_places(tx: DataFrame, customers: DataFrame) -> DataFrame:
    return tx.join(customers.select("customer_id", "country", "region", "city", "latitude", "longitude"), "customer_id")


def distribution(placed: DataFrame, levels: list[str], least: int = 10) -> DataFrame:
    """Revenue of each place with enough transactions; customer rows and distinct customers both."""
    made = placed.groupBy(*levels).agg(
        F.sum("amount").alias("total_revenue"), F.count("*").alias("transactions"), F.avg("amount").alias("avg_transaction"), F.count("customer_id").alias("customer_rows"), F.countDistinct("customer_id").alias("unique_customers"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    return made.filter(F.col("transactions") >= least)


def performance(placed: DataFrame, level: str = "country", unit: str = "month") -> DataFrame:
    made = placed.groupBy(level, period(F.col("ts"), unit).alias("period")).agg(F.sum("amount").alias("revenue"), F.count("*").alias("transactions"))
    before = F.lag("revenue").over(W.partitionBy(level).orderBy("period"))
    return made.withColumn("growth_pct", 100 * ratio(F.col("revenue") - before, before))


def concentration(placed: DataFrame, level: str = "country") -> DataFrame:
    made = placed.groupBy(level).agg(F.sum("amount").alias("revenue"))
    order = W.orderBy(F.desc("revenue"), level)  # places are few
    total = F.sum("revenue").over(W.partitionBy())
    return made.withColumns({"share_pct": 100 * ratio(F.col("revenue"), total), "cumulative_pct": 100 * ratio(F.sum("revenue").over(order.rowsBetween(W.unboundedPreceding, 0)), total)})


def summary(placed: DataFrame) -> DataFrame:
    return placed.agg(
        F.countDistinct("country").alias("countries"), F.countDistinct("region").alias("regions"), F.countDistinct("city").alias("cities"), F.count("country").alias("country_rows"), F.sum("amount").alias("total_revenue"), F.count("*").alias("transactions"), F.avg("amount").alias("avg_transaction"),
    )


def seasonal(tx: DataFrame, by: list[str]) -> DataFrame:
    """Totals by calendar parts (see enrich.calendar) with their share of everything."""
    made = calendar(tx).groupBy(*by).agg(F.sum("amount").alias("revenue"), F.count("*").alias("transactions"), F.avg("amount").alias("avg_transaction"))
    return made.withColumn("share_pct", 100 * ratio(F.col("revenue"), F.sum("revenue").over(W.partitionBy())))


def holidays(tx: DataFrame) -> DataFrame:
    """Totals of each holiday and year, in one aggregation."""
    names = F.create_map(*[F.lit(x) for pair in HOLIDAYS.items() for x in pair])
    made = tx.withColumn("holiday", F.try_element_at(names, F.date_format("ts", "MM-dd"))).filter("holiday IS NOT NULL")
    return made.groupBy("holiday", F.year("ts").alias("year")).agg(F.sum("amount").alias("revenue"), F.count("*").alias("transactions"), F.avg("amount").alias("avg_transaction"))


def decompose(tx: DataFrame) -> DataFrame:
    """Months with moving averages over 3 (one each side) and 12 months (six before, five after), and what is left."""
    made = tx.groupBy(F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.sum("amount").alias("revenue"))
    w = W.orderBy("month")
    made = made.withColumns({"ma_3": F.avg("revenue").over(w.rowsBetween(-1, 1)), "trend": F.avg("revenue").over(w.rowsBetween(-6, 5))})
    return made.withColumns({"seasonal": F.col("ma_3") - F.col("trend"), "residual": F.col("revenue") - F.col("ma_3")})


def category_seasonality(lines: DataFrame) -> DataFrame:
    made = lines.groupBy("category", F.month("ts").alias("month")).agg(F.sum("revenue").alias("revenue"), F.count("*").alias("transactions"))
    return made.withColumn("seasonal_index", ratio(F.col("revenue"), F.avg("revenue").over(W.partitionBy("category"))))


def demand(placed: DataFrame, levels: list[str], unit: str = "month", value: str = "amount") -> DataFrame:
    """Each period's revenue, the two before, the trend, and the next period's naive forecast: revenue * (1 + trend)."""
    made = placed.groupBy(*levels, period(F.col("ts"), unit).alias("period")).agg(F.sum(value).alias("revenue"))
    w = W.partitionBy(*levels).orderBy("period")
    made = made.withColumns({"lag_1": F.lag("revenue", 1).over(w), "lag_2": F.lag("revenue", 2).over(w)})
    trend = ratio(F.col("revenue") - F.col("lag_1"), F.col("lag_1"))
    return made.withColumn("trend", trend).withColumn("forecast", F.col("revenue") * (1 + F.coalesce("trend", F.lit(0.0))))


def forecast_summary(country: DataFrame, region: DataFrame) -> DataFrame:
    """Totals of both levels' forecasts."""
    total = lambda df, level: df.agg(F.lit(level).alias("level"), F.count("*").alias("rows"), F.sum("forecast").alias("total_forecast"), F.avg("trend").alias("avg_trend"))
    return total(country, "country").unionByName(total(region, "region"))


def accuracy(placed: DataFrame) -> DataFrame:
    return placed.agg(F.count("*").alias("rows"), F.avg("amount").alias("mean"), F.stddev("amount").alias("stddev"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def customer_features(customers: DataFrame, tx: DataFrame, as_of: str, home: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """What customers are clustered by; the distance is the real one from `home`."""
    spent = tx.groupBy("customer_id").agg(F.sum("amount").alias("total_spent"), F.count("*").alias("orders"), F.avg("amount").alias("avg_order"), F.max("ts").alias("_last"), F.coalesce(F.stddev("amount"), F.lit(0.0)).alias("order_stddev"))
    made = customers.join(spent, "customer_id")
    far = F.round(haversine_km(F.col("latitude"), F.col("longitude"), F.lit(home[0]), F.lit(home[1])), 2)
    return made.withColumns({"days_since_last": F.datediff(F.lit(as_of).cast("date"), "_last"), "geographic_distance": far}).drop("_last")


CLUSTER_FEATURES = ("latitude", "longitude", "total_spent", "orders", "avg_order", "days_since_last", "geographic_distance")


def cluster(featured: DataFrame, k: int = 5, features: tuple[str, ...] = CLUSTER_FEATURES, seed: int = 42) -> DataFrame:
    """KMeans on standardized features; `cluster` for each customer."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True), KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="cluster")]
    return Pipeline(stages=steps).fit(featured).transform(featured).drop("_raw", "_scaled")


def clusters(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count("*").alias("customers"), F.avg("total_spent").alias("avg_spent"), F.avg("orders").alias("avg_orders"), F.countDistinct("country").alias("countries"), F.countDistinct("region").alias("regions"))


def cluster_places(clustered: DataFrame, level: str = "region") -> DataFrame:
    made = clustered.groupBy("cluster", level).agg(F.count("*").alias("customers"))
    return made.withColumn("share_pct", 100 * ratio(F.col("customers"), F.sum("customers").over(W.partitionBy("cluster"))))


def cluster_performance(clustered: DataFrame, tx: DataFrame) -> DataFrame:
    made = clustered.select("customer_id", "cluster").join(tx, "customer_id")
    return made.groupBy("cluster").agg(F.sum("amount").alias("revenue"), F.count("*").alias("transactions"), F.countDistinct("customer_id").alias("customers"), F.avg("amount").alias("avg_transaction"))
