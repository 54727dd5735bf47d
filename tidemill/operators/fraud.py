"""Fraud: patterns, rules, merchant risk, alert priority, and the combination with model scores.

Trailing time windows are RANGE frames over epoch seconds. "New" means not among the preceding rows of
the customer (the current one does not count). Sets that only answer "new?" are not collected: a
first occurrence is a row number of 1.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.ranking import quantiles, with_percent_rank
from tidemill.functions.scalars import bands, epoch, ratio, seconds
from tidemill.functions.tables import written


@dataclass(frozen=True)
class Rule:
    """A named SQL predicate with a severity and a weight."""

    name: str
    condition: str
    severity: str = "MEDIUM"
    weight: float = 1.0
    enabled: bool = True


# Severities, the default rules, risk weights and the weights and thresholds of priority.
SEVERITY = {"LOW": 0.1, "MEDIUM": 0.3, "HIGH": 0.7, "CRITICAL": 1.0}
SIMPLE_SEVERITY = {"low": 0.1, "medium": 0.5, "high": 1.0}
DEFAULT_RULES = (
    Rule("high_amount_threshold", "price > 10000", "HIGH"),
    Rule("velocity_check_hourly", "transaction_count_1h > 5", "MEDIUM"),
    Rule("round_amount_pattern", "price % 100 = 0 AND price > 500", "LOW"),
    Rule("unusual_time_pattern", "hour(ts) >= 2 AND hour(ts) <= 5", "MEDIUM"),
    Rule("multiple_payment_methods", "distinct_payment_methods_1h > 2", "HIGH"),
)
RISK_WEIGHTS = {"volume": 0.15, "diversity": 0.15, "volatility": 0.10, "behavioral": 0.45, "new": 0.15}
BEHAVIOR_WEIGHTS = {"high_amount_rate": 0.3, "unusual_hour_rate": 0.3, "round_amount_rate": 0.4}
#: Scores below a limit; then the score of what is not below any.
FEW_TRANSACTIONS = [(10, 0.8), (50, 0.6)]
FEW_CUSTOMERS = [(0.1, 0.9), (0.3, 0.6), (0.7, 0.3)], 0.1
YOUNG = [(30, 0.8), (90, 0.6), (180, 0.4)], 0.1
RISK_LEVELS = [(0.8, "VERY_HIGH"), (0.6, "HIGH"), (0.4, "MEDIUM"), (0.2, "LOW")]
PRIORITY_WEIGHTS = {"financial_impact": 0.25, "customer_risk": 0.20, "merchant_risk": 0.15, "pattern_complexity": 0.15, "historical_accuracy": 0.10, "time_sensitivity": 0.10, "business_criticality": 0.05}
PRIORITIES = [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM")]
ACTIONS = {
    "CRITICAL": ("IMMEDIATE_REVIEW", "BLOCK_CUSTOMER", "ESCALATE_TO_SENIOR"),
    "HIGH": ("REVIEW_WITHIN_1_HOUR", "VERIFY_CUSTOMER_CONTACT", "CHECK_RECENT_ACTIVITY"),
    "MEDIUM": ("REVIEW_WITHIN_4_HOURS", "STANDARD_VERIFICATION"),
    "LOW": ("REVIEW_WITHIN_24_HOURS", "BATCH_PROCESS"),
}
MINUTES = {"CRITICAL": 45, "HIGH": 30, "MEDIUM": 15, "LOW": 5}


def load_rules(path: str) -> tuple[Rule, ...]:
    """Rules from a JSON file: a list of objects with the fields of Rule."""
    return tuple(Rule(**x) for x in json.loads(Path(path).read_text()))


def simple_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """A flag for each rule, the sum of the severities (high 1.0, medium 0.5, low 0.1) and the names that fired."""
    fired = {r.name: F.coalesce(F.expr(r.condition), F.lit(False)) for r in rules}
    score = sum((F.when(fired[r.name], SIMPLE_SEVERITY[r.severity.lower()]).otherwise(0.0) for r in rules), F.lit(0.0))
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fired.items()]))
    return df.withColumns({f"rule_{n}_triggered": c for n, c in fired.items()} | {"fraud_score": score, "fraud_alerts": names})


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """triggered_rules, fraud_alerts, fraud_score and risk_level from the enabled rules, as one flat expression each."""
    on = [r for r in rules if r.enabled]
    fired = [F.coalesce(F.expr(r.condition), F.lit(False)) for r in on]
    score = sum((F.when(c, SEVERITY[r.severity.upper()] * r.weight).otherwise(0.0) for r, c in zip(on, fired, strict=True)), F.lit(0.0))
    alerts = [F.when(c, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity.upper()).alias("severity"), F.lit(SEVERITY[r.severity.upper()] * r.weight).alias("score"))) for r, c in zip(on, fired, strict=True)]
    made = df.withColumns({"triggered_rules": F.array_compact(F.array(*[F.when(c, F.lit(r.name)) for r, c in zip(on, fired, strict=True)])), "fraud_alerts": F.array_compact(F.array(*alerts)), "fraud_score": score})
    return made.withColumn("risk_level", bands(F.round("fraud_score", 9), [(0.7, "CRITICAL"), (0.5, "HIGH"), (0.3, "MEDIUM"), (1e-9, "LOW")], "NONE"))


def rule_statistics(scored: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """How often each rule fired, all in one aggregation."""
    flags = [F.count_if(F.array_contains("triggered_rules", r.name)).alias(r.name) for r in rules]
    sums = [F.avg(F.when(F.array_contains("triggered_rules", r.name), F.col("fraud_score"))).alias(f"{r.name}_score") for r in rules]
    one = scored.agg(F.count("*").alias("_n"), *flags, *sums)
    rows = [F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("triggers"), ratio(F.col(r.name), F.col("_n")).alias("rate"), F.col(f"{r.name}_score").alias("avg_score")) for r in rules]
    return one.select(F.inline(F.array(*rows)))


def trailing(span: str, *partition: str):
    """The rows of a partition in the `span` before and at each row."""
    return W.partitionBy(*partition).orderBy("_s").rangeBetween(-seconds(span), 0)


def with_epoch(df: DataFrame) -> DataFrame:
    return df.withColumn("_s", epoch(F.col("ts")))


def trailing_distinct(df: DataFrame, found: dict[str, tuple[str, str]]) -> DataFrame:
    """name: distinct values of a column among the customer's rows in the span before and at each row, for each name: (column, span); df has _s.

    A value counts from its first row until the span after its last one, so its rows are joined into stretches without a
    longer gap; a running sum adds one where a stretch begins and takes one away where it has ended. No sets are kept, and
    the ends come out of the rows themselves, so they stay where their customer is and rows travel once.
    """
    made = df
    for i, (column, span) in enumerate(found.values()):
        w = W.partitionBy("customer_id", column).orderBy("_s")
        far = lambda gap, span=span: F.coalesce(gap > seconds(span), F.lit(True))
        known = F.col(column).isNotNull()
        made = made.withColumns({f"_a{i}": (known & far(F.col("_s") - F.lag("_s").over(w))).cast("int"), f"_b{i}": known & far(F.lead("_s").over(w) - F.col("_s"))})
    n, rest = len(found), [c for c in df.columns if c not in ("customer_id", "_s")]
    change = lambda at, values, real: F.struct(at.alias("_s"), *[v.alias(f"_a{i}") for i, v in enumerate(values)], F.lit(real).alias("_real"))
    ends = [F.when(F.col(f"_b{i}"), change(F.col("_s") + seconds(span) + 1, [F.lit(-1 if i == j else 0) for j in range(n)], False)) for i, (_, span) in enumerate(found.values())]
    changes = F.array_compact(F.array(change(F.col("_s"), [F.col(f"_a{i}") for i in range(n)], True), *ends))
    every = made.select("customer_id", *rest, F.inline(changes)).withColumns({c: F.when(F.col("_real"), F.col(c)) for c in rest})
    upto = W.partitionBy("customer_id").orderBy("_s").rangeBetween(W.unboundedPreceding, W.currentRow)
    every = every.withColumns({name: F.sum(f"_a{i}").over(upto).cast("int") for i, name in enumerate(found)})
    return every.filter("_real").select(*df.columns, *found)


def velocity(df: DataFrame, spans: dict[str, str] | None = None) -> DataFrame:
    """Counts, sums, distinct merchants and payment methods of each customer over trailing spans."""
    spans = spans or {"1h": "1 hour", "1d": "1 day", "7d": "7 days"}
    df = with_epoch(df)
    for name, span in spans.items():
        w = trailing(span, "customer_id")
        df = df.withColumns({f"transaction_count_{name}": F.count("*").over(w), f"amount_sum_{name}": F.sum("price").over(w)})
    kinds = {"distinct_merchants": "merchant_id", "distinct_payment_methods": "payment_method"}
    return trailing_distinct(df, {f"{kind}_{name}": (column, span) for name, span in spans.items() for kind, column in kinds.items()}).drop("_s")


def amounts(df: DataFrame) -> DataFrame:
    """Each amount against its customer's, round and near-round amounts, and its place among all. df is written first, as limits, sizes and ranks read it each."""
    df = written(df, "amounts")
    w = W.partitionBy("customer_id")
    made = df.withColumns({"customer_avg_amount": F.avg("price").over(w), "customer_max_amount": F.max("price").over(w), "customer_stddev_amount": F.stddev("price").over(w)})
    p = F.col("price")
    made = made.withColumns(
        {
            "amount_deviation_ratio": ratio(p, F.col("customer_avg_amount")), "amount_zscore": ratio(p - F.col("customer_avg_amount"), F.col("customer_stddev_amount")),
            "is_round_amount": (p % 100 == 0) & (p > 100), "ends_with_99": F.pmod(F.round(p * 100).cast("long"), F.lit(100)) == 99,
        }
    )
    return with_percent_rank(made, "amount_percentile", p)


def times(df: DataFrame, tie: str = "transaction_id") -> DataFrame:
    """Hour, weekday and spacing of each transaction, against the customer's hours."""
    w, order = W.partitionBy("customer_id"), W.partitionBy("customer_id").orderBy("ts", tie)
    hour = F.hour("ts")
    gap = epoch(F.col("ts")) - epoch(F.lag("ts").over(order))
    made = df.withColumns({"hour": hour, "day_of_week": F.dayofweek("ts"), "day_of_month": F.dayofmonth("ts"), "is_business_hours": hour.between(9, 17), "is_unusual_hour": hour.between(0, 5), "is_weekend": F.dayofweek("ts").isin(1, 7)})
    return made.withColumns({"avg_hour": F.avg("hour").over(w), "seconds_since_last": gap}).withColumns({"hour_deviation": F.abs(F.col("hour") - F.col("avg_hour")), "is_rapid": F.coalesce(F.col("seconds_since_last") < 60, F.lit(False))})


def novelty(df: DataFrame, column: str, prefix: str, tie: str = "transaction_id") -> DataFrame:
    """{prefix}_count: distinct values of the customer so far, {prefix}_is_new: a first occurrence that is not the customer's first row."""
    each, order = W.partitionBy("customer_id", column).orderBy("ts", tie), W.partitionBy("customer_id").orderBy("ts", tie)
    made = df.withColumn("_first", F.row_number().over(each) == 1)
    so_far = F.sum(F.col("_first").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return made.withColumns({f"{prefix}_count": so_far, f"{prefix}_is_new": F.col("_first") & (F.row_number().over(order) > 1)}).drop("_first")


def locations(df: DataFrame) -> DataFrame:
    made = with_epoch(novelty(df, "location", "location"))
    made = made.withColumn("location_transactions_1h", F.count("*").over(trailing("1 hour", "customer_id", "location")))
    return trailing_distinct(made, {"distinct_locations_1h": ("location", "1 hour")}).drop("_s")


def merchants(df: DataFrame) -> DataFrame:
    w = W.partitionBy("customer_id", "merchant_id")
    return novelty(df, "merchant_id", "merchant").withColumns({"merchant_transactions": F.count("*").over(w), "merchant_amount": F.sum("price").over(w), "merchant_avg_amount": F.avg("price").over(w)})


def payments(df: DataFrame, tie: str = "transaction_id") -> DataFrame:
    before = F.lag("payment_method").over(W.partitionBy("customer_id").orderBy("ts", tie))
    return novelty(df, "payment_method", "payment").withColumn("payment_changed", F.coalesce(before != F.col("payment_method"), F.lit(False)))


def patterns(df: DataFrame) -> DataFrame:
    """All patterns; locations and merchants only where the columns exist. Amounts come first, as they write what they get: the rows alone, without the other patterns."""
    made = payments(times(velocity(amounts(df))))
    made = locations(made) if "location" in df.columns else made
    return merchants(made) if "merchant_id" in df.columns else made


def below(value: Column, limits: list[tuple[float, float]], otherwise: Column | float) -> Column:
    """The score of the first limit that value is below."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for limit, score in reversed(limits):
        out = F.when(value < limit, score).otherwise(out)
    return out


def merchant_risk(tx: DataFrame, as_of: str, lookback_days: int | None = 30) -> DataFrame:
    """Metrics, rates, scores, level and flags of each merchant: the merchants' means are joined back, then one aggregation."""
    now = F.lit(as_of).cast("date")
    if lookback_days is not None:
        tx = tx.filter(F.to_date("ts") >= F.date_sub(now, lookback_days))
    tx = tx.join(tx.groupBy("merchant_id").agg(F.avg("price").alias("_avg")), "merchant_id")
    rate = lambda c: ratio(F.sum(F.when(c, 1).otherwise(0)), F.count("*"))
    p = F.col("price")
    made = tx.groupBy("merchant_id").agg(
        F.count("*").alias("transaction_count"), F.sum("price").alias("total_revenue"), F.avg("price").alias("avg_amount"), F.stddev("price").alias("amount_stddev"), F.countDistinct("customer_id").alias("unique_customers"),
        F.countDistinct("payment_method").alias("payment_methods"), F.min("ts").alias("first_ts"), rate(p > 3 * F.col("_avg")).alias("high_amount_rate"), rate(F.hour("ts").between(0, 5)).alias("unusual_hour_rate"),
        rate(F.dayofweek("ts").isin(1, 7)).alias("weekend_rate"), rate((p % 100 == 0) & (p > 100)).alias("round_amount_rate"),
    )
    n = F.col("transaction_count")
    made = made.withColumns({"merchant_age_days": F.datediff(now, "first_ts"), "amount_volatility": F.coalesce(ratio(F.col("amount_stddev"), F.col("avg_amount")), F.lit(0.0)), "revenue_per_customer": ratio(F.col("total_revenue"), F.greatest("unique_customers", F.lit(1)))})
    made = made.withColumn("avg_daily_transactions", ratio(n, F.greatest("merchant_age_days", F.lit(1))))
    made = with_percent_rank(with_percent_rank(made, "_volume", n), "volatility_risk_score", F.col("amount_volatility"))
    spread, age = ratio(F.col("unique_customers"), n), F.col("merchant_age_days")
    made = made.withColumns(
        {
            "volume_risk_score": below(n, FEW_TRANSACTIONS, 1 - F.col("_volume")),
            "diversity_risk_score": below(spread, *FEW_CUSTOMERS),
            "behavioral_risk_score": sum((F.col(c) * w for c, w in BEHAVIOR_WEIGHTS.items()), F.lit(0.0)),
            "new_risk_score": below(age, *YOUNG),
        }
    ).drop("_volume")
    total = sum((F.col(f"{k}_risk_score") * w for k, w in RISK_WEIGHTS.items()), F.lit(0.0))
    flags = [(n < 10, "LOW_VOLUME"), (F.col("diversity_risk_score") > 0.7, "LOW_CUSTOMER_DIVERSITY"), (F.col("volatility_risk_score") > 0.8, "HIGH_AMOUNT_VOLATILITY"), (F.col("unusual_hour_rate") > 0.3, "HIGH_UNUSUAL_HOURS"), (F.col("round_amount_rate") > 0.5, "HIGH_ROUND_AMOUNTS"), (age < 30, "NEW_MERCHANT")]
    made = made.withColumn("merchant_risk_score", F.round(total, 9))
    level = bands(F.col("merchant_risk_score"), RISK_LEVELS, "VERY_LOW")
    return made.withColumns({"merchant_risk_level": level, "risk_flags": F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags]))})


def high_risk(scored: DataFrame, least: float = 0.6) -> DataFrame:
    return scored.filter(F.col("merchant_risk_score") >= least).orderBy(F.desc("merchant_risk_score"), "merchant_id")


def merchant_profile(tx: DataFrame, merchant_id: int) -> DataFrame:
    """One merchant by hour, weekday and amount band; the filter reaches the scan."""
    mine = tx.filter(F.col("merchant_id") == merchant_id)
    band = bands(F.col("price"), [(1000, "over_1000"), (500, "500_1000"), (100, "100_500"), (50, "50_100")], "under_50")
    made = mine.select("price", F.inline(F.array(*[F.struct(F.lit(k).alias("dimension"), v.cast("string").alias("member")) for k, v in (("hour", F.hour("ts")), ("weekday", F.date_format("ts", "EEEE")), ("amount", band))])))
    return made.groupBy("dimension", "member").agg(F.count("*").alias("transactions"), F.sum("price").alias("amount"))


def prioritize(alerts: DataFrame, as_of: Column, customers: DataFrame | None = None, merchants: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """Seven factors, score, level, actions and minutes of each alert (price, ts, triggered_rules, payment_method, max_severity).

    customers: customer_id, customer_risk; merchants: merchant_id, merchant_risk; history: rule, resolution. What is unknown is 0.5.
    The percentiles are one row, exact, by ranges, and the accuracies of rules one map, so alerts are not joined with themselves.
    """
    p, n = F.col("price"), F.size("triggered_rules")
    cuts = quantiles(alerts, ["price"], [0.5, 0.95, 0.99]).select("q").scalar()
    made = alerts.withColumn("_cuts", cuts)
    median, p95, p99 = (F.get("_cuts", F.lit(i)) for i in range(3))
    impact = F.when(p >= p99, 1.0).when(p >= p95, 0.8).when(p >= median * 5, 0.6).when(p >= median * 2, 0.4).when(p >= median, 0.2).otherwise(0.1)
    complexity = F.when(n >= 5, 1.0).when(n >= 3, 0.8).when(n >= 2, 0.6).when(n >= 1, 0.4).otherwise(0.2) * F.when(F.upper("max_severity") == "CRITICAL", 1.5).otherwise(1.0)
    minutes = (epoch(as_of) - epoch(F.col("ts"))) / 60.0
    recency = F.when(minutes <= 5, 1.0).when(minutes <= 15, 0.9).when(minutes <= 60, 0.7).when(minutes <= 240, 0.5).when(minutes <= 1440, 0.3).otherwise(0.1)
    made = made.withColumns({"financial_impact_factor": impact, "pattern_complexity_factor": complexity, "time_sensitivity_factor": recency}).drop("_cuts")
    for name, other in (("customer", customers), ("merchant", merchants)):
        if other is not None:
            made = made.join(other.select(f"{name}_id", F.col(f"{name}_risk").alias(f"{name}_risk_factor")), f"{name}_id", "left").fillna(0.5, [f"{name}_risk_factor"])
        else:
            made = made.withColumn(f"{name}_risk_factor", F.lit(0.5))
    if history is not None:
        known = history.filter("rule IS NOT NULL").groupBy("rule").agg(F.avg(F.when(F.col("resolution") == "TRUE_POSITIVE", 1.0).otherwise(0.0)).alias("_accuracy"))
        rates = known.agg(F.map_from_entries(F.collect_list(F.struct("rule", "_accuracy")))).scalar()  # one entry for each rule
        found = F.filter(F.transform("triggered_rules", lambda x: F.try_element_at(F.col("_rates"), x)), lambda x: x.isNotNull())
        mean = F.try_divide(F.aggregate(found, F.lit(0.0), lambda total, x: total + x), F.size(found))
        made = made.withColumn("_rates", rates).withColumn("historical_accuracy_factor", F.coalesce(mean, F.lit(0.5))).drop("_rates")
    else:
        made = made.withColumn("historical_accuracy_factor", F.lit(0.5))
    worst = F.greatest("customer_risk_factor", "merchant_risk_factor")
    base = F.when(F.col("payment_method").isin("credit_card", "bank_transfer"), 0.8).when(F.col("payment_method") == "digital_wallet", 0.6).when(F.col("payment_method") == "paypal", 0.5).otherwise(0.3)
    made = made.withColumn("business_criticality_factor", base * F.when(worst > 0.8, 1.2).when(worst > 0.6, 1.1).otherwise(1.0))
    made = made.withColumn("priority_score", F.round(sum((F.col(f"{k}_factor") * w for k, w in PRIORITY_WEIGHTS.items()), F.lit(0.0)), 9))
    made = made.withColumn("alert_priority", bands(F.col("priority_score"), PRIORITIES, "LOW"))
    level = F.col("alert_priority")
    actions, spent = F.lit(None).cast("array<string>"), F.lit(0)
    for k, names in ACTIONS.items():
        actions, spent = F.when(level == k, F.array(*map(F.lit, names))).otherwise(actions), F.when(level == k, MINUTES[k]).otherwise(spent)
    return made.withColumns({"recommended_actions": actions, "estimated_minutes": spent + 5 * F.size("triggered_rules")})


def priority_queue(alerts: DataFrame, most: int = 100, level: str | None = None) -> DataFrame:
    """The report of the first `most` alerts in the order of score, time and id."""
    order = [F.desc("priority_score"), F.asc("ts"), F.asc("alert_id")]
    made = alerts.filter(F.col("alert_priority") == level) if level else alerts
    return made.orderBy(*order).limit(most).withColumn("queue_position", F.row_number().over(W.orderBy(*order)))


def alert_summary(alerts: DataFrame) -> DataFrame:
    made = alerts.groupBy("alert_priority").agg(F.count("*").alias("alerts"), F.sum("price").alias("amount"), F.avg("priority_score").alias("avg_score"), F.sum("estimated_minutes").alias("minutes"))
    return made.withColumn("share", ratio(F.col("alerts"), F.sum("alerts").over(W.partitionBy())))


def top_rules(alerts: DataFrame, most: int = 10) -> DataFrame:
    """The report of the rules that fire most."""
    return alerts.select(F.explode("triggered_rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("alerts")).orderBy(F.desc("alerts"), "rule").limit(most)


def combine(df: DataFrame, rule_weight: float = 0.4, model_weight: float = 0.6, threshold: float = 0.5) -> DataFrame:
    """Rule score and model probability (null: rules alone) as one score, its verdict, and what found it."""
    total = rule_weight + model_weight
    a, b = (rule_weight / total, model_weight / total) if total > 0 else (0.5, 0.5)
    rules, model = F.col("fraud_score"), F.col("ml_fraud_probability")
    by_model = F.coalesce(model > threshold, F.lit(False))
    made = df.withColumn("combined_fraud_score", F.when(model.isNotNull(), rules * a + model * b).otherwise(rules))
    how = F.when((rules > 0) & by_model, "rules_and_ml").when(rules > 0, "rules_only").when(by_model, "ml_only").otherwise("none")
    return made.withColumns({"combined_fraud_prediction": (F.col("combined_fraud_score") > threshold).cast("int"), "detection_method": how})


def detect(tx: DataFrame, merchant_scores: DataFrame | None = None, rules: tuple[Rule, ...] = DEFAULT_RULES, spans: dict[str, str] | None = None) -> DataFrame:
    """Patterns, rules and merchant risk (0.5 and MEDIUM where unknown) of each transaction; model columns if it has them."""
    made = apply_rules(velocity(tx, spans), rules)
    if merchant_scores is not None:
        made = made.join(merchant_scores.select("merchant_id", "merchant_risk_score", "merchant_risk_level"), "merchant_id", "left").fillna({"merchant_risk_score": 0.5, "merchant_risk_level": "MEDIUM"})
    if "ml_fraud_probability" not in made.columns:
        made = made.withColumn("ml_fraud_probability", F.lit(None).cast("double"))
    return combine(made)
