"""Stateless enrichment of transactions and behavior events; all of it works on streams too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import bands, lookup, percent  # noqa: F401

# Thresholds and labels of the enrichment.
LTV = [(1000, "High"), (500, "Medium"), (100, "Low")]
PRICE = [(100, "High"), (50, "Medium"), (10, "Low")]
SIZE = [(200, "Large"), (50, "Medium"), (10, "Small")]
REGIONS = [("Northeast", "new york|boston|philadelphia|northeast"), ("West", "california|seattle|portland|west"), ("South", "texas|florida|atlanta|south"), ("Midwest", "chicago|detroit|midwest")]
AREAS = [("Urban", "city|urban|downtown|metro"), ("Suburban", "suburb")]
DURATION = {"page_view": 30, "product_view": 45, "add_to_cart": 60}
DEPTH = {"page_view": 1, "product_view": 2, "add_to_cart": 3, "checkout": 4}
INTENT = {"checkout": 90, "add_to_cart": 70, "product_view": 40, "search": 30}
ENGAGEMENT = {"purchase": 100, "add_to_cart": 80, "product_view": 60, "search": 40, "page_view": 20}
STAGE = {"page_view": "Awareness", "search": "Interest", "product_view": "Consideration", "add_to_cart": "Intent", "checkout": "Purchase"}
CONVERSION = {"checkout": 95, "add_to_cart": 60, "product_view": 25, "search": 10, "page_view": 2}
DEVICES = [("Mobile", "mobile|android|iphone"), ("Tablet", "tablet|ipad"), ("Desktop", "windows|macintosh|linux|desktop")]
BROWSERS = [("Chrome", "chrome"), ("Firefox", "firefox"), ("Safari", "safari"), ("Edge", "edge")]


def first_match(text: Column, patterns: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that text contains, in either case."""
    low = F.lower(text)
    out = None
    for label, pattern in patterns:
        out = F.when(low.rlike(pattern), F.lit(label)) if out is None else out.when(low.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def customer(df: DataFrame) -> DataFrame:
    tier = F.coalesce(F.upper(F.trim("customer_tier")), F.lit("Unknown"))
    return df.withColumns({"customer_tier_normalized": tier, "ltv_category": bands(F.col("customer_lifetime_value"), LTV, "Unknown")})


def product(df: DataFrame) -> DataFrame:
    """A category without a slash has no sub-category (null)."""
    levels = F.split("category", "/")
    score = F.when(F.col("product_id").isNull(), F.lit(0)).otherwise((F.col("price") * 0.1 + 50).cast("int"))
    return df.withColumns({"main_category": F.get(levels, F.lit(0)), "sub_category": F.get(levels, F.lit(1)), "price_category": bands(F.col("price"), PRICE, "Very Low"), "popularity_score": score})


def temporal(df: DataFrame, ts: str = "ts") -> DataFrame:
    hour, day = F.hour(ts), F.dayofweek(ts)
    weekend = day.isin(1, 7)
    part = F.when(hour.between(6, 11), "Morning").when(hour.between(12, 17), "Afternoon").when(hour.between(18, 22), "Evening").otherwise("Night")
    return df.withColumns({"hour_of_day": hour, "day_of_week": day, "is_weekend": weekend, "time_period": part, "is_business_hours": hour.between(9, 17) & ~weekend})


def geographic(df: DataFrame) -> DataFrame:
    return df.withColumns({"region_category": first_match(F.col("location"), REGIONS, "Other"), "area_type": first_match(F.col("location"), AREAS, "Rural")})


def business(df: DataFrame) -> DataFrame:
    amount = F.col("total_amount")
    return df.withColumns({"revenue_impact": F.coalesce(amount * 0.2, F.lit(0.0)), "transaction_size": bands(amount, SIZE, "Micro"), "bulk_purchase": F.coalesce(F.col("quantity") >= 5, F.lit(False))})


def risk(df: DataFrame, ts: str = "ts") -> DataFrame:
    amount, hour = F.col("total_amount"), F.hour(ts)
    score = F.when(amount > 500, 3).when(F.dayofweek(ts).isin(1, 7) & (hour < 6), 2).when(F.col("payment_method") == "cash", 1).otherwise(0)
    flags = F.when(amount > 1000, "high_amount").when(hour < 6, "unusual_time").otherwise("none")
    return df.withColumns({"risk_score": score, "risk_category": bands(score, [(3, "High"), (2, "Medium"), (1, "Low")], "Minimal"), "anomaly_flags": flags})


def transactions(df: DataFrame, ts: str = "ts") -> DataFrame:
    """All six enrichers; enrichment_timestamp is the caller's to add, as it differs from run to run."""
    for step in (customer, product):
        df = step(df)
    return risk(business(geographic(temporal(df, ts))), ts)


def session(df: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return df.withColumns({"estimated_session_duration": lookup(kind, DURATION, 15), "page_depth": lookup(kind, DEPTH, 0)})


def user_profile(df: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    level = F.when(kind.isin("add_to_cart", "checkout", "purchase"), "High").when(kind.isin("product_view", "search"), "Medium").otherwise("Low")
    return df.withColumns({"engagement_level": level, "purchase_intent_score": lookup(kind, INTENT, 10)})


def device(df: DataFrame) -> DataFrame:
    """Mobile before Tablet before Desktop, Chrome before all other browsers."""
    return df.withColumns({"device_category": first_match(F.col("user_agent"), DEVICES, "Unknown"), "browser_family": first_match(F.col("user_agent"), BROWSERS, "Other")})


def engagement(df: DataFrame) -> DataFrame:
    score = lookup(F.col("event_type"), ENGAGEMENT, 10)
    return df.withColumns({"engagement_score": score, "activity_intensity": bands(score, [(80, "High"), (40, "Medium")], "Low")})


def funnel_position(df: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return df.withColumns({"funnel_stage": lookup(kind, STAGE, "Unknown"), "conversion_probability": lookup(kind, CONVERSION, 0)})


def user_behavior(df: DataFrame) -> DataFrame:
    for step in (session, user_profile, device, engagement, funnel_position):
        df = step(df)
    return df


def clean_transactions(df: DataFrame) -> DataFrame:
    """total_amount, for rows with a user, a price and a quantity above zero."""
    return df.filter("price > 0 AND quantity > 0 AND customer_id IS NOT NULL").withColumn("total_amount", F.col("price") * F.col("quantity"))


def clean_behavior(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type").isin("page_view", "click"), "engagement").when(F.col("event_type").isin("add_to_cart", "purchase"), "conversion").otherwise("other")
    return df.filter("user_id IS NOT NULL AND event_type IS NOT NULL").withColumn("event_category", kind)


def fresh(df: DataFrame, ts: str, max_age_seconds: int, as_of: Column) -> DataFrame:
    """Rows of at most that age."""
    return df.filter(F.unix_timestamp(as_of) - F.unix_timestamp(F.col(ts).cast("timestamp")) <= max_age_seconds)


def date_range(df: DataFrame, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows between both moments, both included; the filter reaches the scan."""
    if start:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    return df.filter(F.col(ts) <= F.lit(end).cast("timestamp")) if end else df


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The calendar columns that seasonal reports group by."""
    return df.withColumns(
        {
            "year": F.year(ts), "month": F.month(ts), "quarter": F.quarter(ts), "day_of_month": F.dayofmonth(ts), "day_of_week": F.dayofweek(ts),
            "week_of_year": F.weekofyear(ts), "month_name": F.date_format(ts, "MMMM"), "day_name": F.date_format(ts, "EEEE"),
        }
    )


def anonymize(df: DataFrame, fields: list[str], method: str = "hash") -> DataFrame:
    """hash: SHA-256; remove: the columns go; mask: every character becomes *. Nulls stay null."""
    if method == "remove":
        return df.drop(*fields)
    if method == "hash":
        return df.withColumns({c: F.sha2(F.col(c).cast("string"), 256) for c in fields})
    if method == "mask":
        return df.withColumns({c: F.regexp_replace(F.col(c).cast("string"), "(?s).", "*") for c in fields})
    raise ValueError(f"not a method: {method!r}")


def schema_difference(df: DataFrame, expected: list[str]) -> dict[str, list[str]]:
    """Names that are missing from df, and those that nobody expects."""
    return {"missing": [c for c in expected if c not in df.columns], "extra": [c for c in df.columns if c not in expected]}
