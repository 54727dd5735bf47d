"""Data quality: validation, anomalies, completeness, profiles, rules of a table, and the combined score.

Rules are SQL predicates on the frame itself; all flags are columns of one projection, and each report is
one aggregation, whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.ranking import quantiles
from tidemill.functions.scalars import bands, bot_agent, epoch, ratio, seconds


@dataclass(frozen=True)
class Check:
    """A named SQL predicate that rows should satisfy."""

    name: str
    condition: str
    severity: str = "error"
    enabled: bool = True


@dataclass(frozen=True)
class Field:
    """What makes a column complete, and how much it weighs."""

    column: str
    required: bool = True
    least: int | None = None
    most: int | None = None
    allow_empty: bool = False
    pattern: str | None = None
    weight: float = 1.0


# The rules of the three stream types; {as_of} is the moment of the check.
CHECKS = {
    "transaction": (
        Check("transaction_id_format", "transaction_id IS NOT NULL AND length(transaction_id) >= 10"),
        Check("user_id_valid", "user_id IS NOT NULL AND user_id > 0"),
        Check("amount_positive", "total_amount IS NOT NULL AND total_amount > 0"),
        Check("amount_reasonable", "total_amount <= 10000", "warning"),
        Check("timestamp_recent", "ts >= {as_of} - INTERVAL 1 HOUR", "warning"),
        Check("payment_method_valid", "payment_method IN ('credit_card', 'debit_card', 'paypal', 'bank_transfer', 'cash')"),
        Check("currency_valid", "currency IS NOT NULL AND length(currency) = 3"),
        Check("location_format", "location IS NULL OR trim(location) != ''", "warning"),
    ),
    "user_behavior": (
        Check("user_id_valid", "user_id IS NOT NULL AND user_id > 0"),
        Check("session_id_format", "session_id IS NOT NULL AND trim(session_id) != ''"),
        Check("event_type_valid", "event_type IN ('page_view', 'product_view', 'add_to_cart', 'remove_from_cart', 'checkout', 'purchase', 'search', 'login', 'logout')"),
        Check("timestamp_recent", "ts >= {as_of} - INTERVAL 2 HOURS", "warning"),
        Check("page_url_format", "page_url IS NULL OR page_url RLIKE '^https?://.*'", "warning"),
        Check("user_agent_present", "user_agent IS NOT NULL AND trim(user_agent) != ''", "info"),
        Check("product_id_valid", "product_id IS NULL OR product_id > 0", "warning"),
    ),
    "customer_profile": (
        Check("user_id_valid", "user_id IS NOT NULL AND user_id > 0"),
        Check("email_format", "email IS NULL OR email RLIKE '^[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}$'"),
        Check("age_reasonable", "age IS NULL OR (age >= 13 AND age <= 120)", "warning"),
        Check("registration_date_valid", "registration_date IS NULL OR registration_date <= cast({as_of} AS date)"),
        Check("customer_tier_valid", "customer_tier IS NULL OR customer_tier IN ('Bronze', 'Silver', 'Gold', 'Platinum')", "warning"),
    ),
}
# The fields of the three stream types.
FIELDS = {
    "transaction": (
        Field("transaction_id", least=10, weight=2.0), Field("user_id", weight=2.0), Field("total_amount", weight=2.0), Field("currency", least=3, most=3, weight=1.5), Field("payment_method", least=3, weight=1.5),
        Field("ts", weight=2.0), Field("product_id", False), Field("location", False, allow_empty=True, weight=0.5), Field("customer_tier", False, weight=0.5), Field("category", False),
    ),
    "user_behavior": (
        Field("user_id", weight=2.0), Field("session_id", least=5, weight=2.0), Field("event_type", least=3, weight=2.0), Field("ts", weight=2.0), Field("page_url", False, least=7), Field("user_agent", False, least=10),
        Field("product_id", False), Field("referrer_url", False, allow_empty=True, weight=0.5), Field("device_type", False, weight=0.5),
    ),
    "customer_profile": (
        Field("user_id", weight=2.0), Field("email", least=5, weight=2.0), Field("registration_date", weight=1.5), Field("customer_tier", False), Field("age", False), Field("location", False, allow_empty=True, weight=0.5),
        Field("phone", False, least=10), Field("preferences", False, allow_empty=True, weight=0.5),
    ),
}
COMPLETENESS = [(0.98, "excellent"), (0.95, "good"), (0.90, "fair")]
PATTERNS = {"email": r"^[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", "url": r"^https?://", "numeric": r"^-?\d+(\.\d+)?$", "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"}
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "ssn": r"\b\d{3}-\d{2}-\d{4}\b", "credit_card": r"\b(?:\d{4}[- ]?){3}\d{4}\b"}


def validate(df: DataFrame, checks: tuple[Check, ...], as_of: str = "current_timestamp()") -> DataFrame:
    """rule_* flags and validation_passed: the first enabled rule and all rules of severity error hold. Null counts as failed."""
    on = [c for c in checks if c.enabled]
    flags = {f"rule_{c.name}": F.coalesce(F.expr(c.condition.format(as_of=as_of)), F.lit(False)) for c in on}
    count = [f for i, (f, c) in enumerate(zip(flags, on, strict=True)) if i == 0 or c.severity == "error"]
    made = df.withColumns(flags)
    return made.withColumn("validation_passed", reduce(lambda a, b: a & b, [F.col(f) for f in count], F.lit(True)))


def validation_summary(validated: DataFrame) -> DataFrame:
    """rule, passed, failed and rate of every flag, from one aggregation."""
    flags = [c for c in validated.columns if c.startswith("rule_")] + ["validation_passed"]
    one = validated.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    rows = [F.struct(F.lit(f.removeprefix("rule_")).alias("rule"), F.col(f).alias("passed"), (F.col("_n") - F.col(f)).alias("failed"), ratio(F.col(f), F.col("_n")).alias("pass_rate")) for f in flags]
    return one.select(F.inline(F.array(*rows)))


def outliers(df: DataFrame, column: str, z_limit: float = 3.0, iqr_factor: float = 1.5) -> DataFrame:
    """{column}_zscore, {column}_outlier: far from the mean or outside the quartiles' fences; both from one row of statistics."""
    stats = df.agg(F.struct(F.avg(column).alias("m"), F.stddev(column).alias("s"))).scalar()
    made = df.withColumns({"_st": stats, "_q": quantiles(df, [column], [0.25, 0.75]).select("q").scalar()})
    v, s, low, high = F.col(column), F.col("_st"), F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    z = ratio(v - s["m"], s["s"])
    fence = iqr_factor * (high - low)
    far = F.coalesce(F.abs(z) > z_limit, F.lit(False)) | F.coalesce((v < low - fence) | (v > high + fence), F.lit(False))
    return made.withColumns({f"{column}_zscore": z, f"{column}_outlier": far}).drop("_st", "_q")


def window_outliers(df: DataFrame, column: str, span: str = "1 hour", z_limit: float = 3.0, ts: str = "ts") -> DataFrame:
    """One row for each input row: is_anomaly against the mean and spread of its own window, which are one small row a window."""
    df = df.withColumn("_w", F.floor(epoch(F.col(ts)) / seconds(span)))
    stats = df.groupBy(F.col("_w").alias("_window")).agg(F.avg(column).alias("_mean"), F.stddev(column).alias("_spread"))
    made = df.join(stats, F.col("_w").eqNullSafe(F.col("_window")), "left")
    z = ratio(F.col(column) - F.col("_mean"), F.col("_spread"))
    return made.withColumns({"window_zscore": z, "is_anomaly": F.coalesce(F.abs(z) > z_limit, F.lit(False))}).drop("_w", "_window", "_mean", "_spread")


def burst(df: DataFrame, user: str = "user_id", ts: str = "ts", factor: float = 2.0) -> DataFrame:
    """anomaly_burst: more events of the user in this minute than `factor` times the user's mean minute."""
    minute = F.date_trunc("minute", ts)
    each = df.groupBy(user, minute.alias("_minute")).agg(F.count("*").alias("_n"))
    each = each.withColumn("anomaly_burst", F.col("_n") > factor * F.avg("_n").over(W.partitionBy(user))).drop("_n")
    return df.withColumn("_minute", minute).join(each, [user, "_minute"], "left").drop("_minute")


def deviations(df: DataFrame, user: str = "user_id", ts: str = "ts", value: str = "value", tie: str = "event_id", count_factor: float = 2.5, jump: float = 5.0) -> DataFrame:
    """anomaly_frequency: the last hour's count against the user's mean of it; anomaly_spike: value against the one before."""
    hour = W.partitionBy(user).orderBy("_s").rangeBetween(-3600, 0)
    order = W.partitionBy(user).orderBy(ts, tie)
    made = df.withColumn("_s", epoch(F.col(ts))).withColumn("_n", F.count("*").over(hour))
    made = made.withColumns({"anomaly_frequency": F.col("_n") > count_factor * F.avg("_n").over(W.partitionBy(user)), "anomaly_spike": F.coalesce(ratio(F.col(value), F.lag(value).over(order)) > jump, F.lit(False))})
    return made.drop("_s", "_n")


def anomalies(df: DataFrame, amount: str = "total_amount", ts: str = "ts") -> DataFrame:
    """Statistical, temporal, business and (where there is an agent) bot flags, and is_anomaly if any of them is set."""
    made = outliers(df, amount)
    hour = F.hour(ts)
    flags = {"anomaly_statistical": F.col(f"{amount}_outlier"), "anomaly_temporal": (hour >= 23) | (hour <= 5), "anomaly_business": F.col(amount).isNull() | (F.col(amount) <= 0)}
    if "user_agent" in df.columns:
        flags["anomaly_bot"] = bot_agent(F.col("user_agent"))
    made = made.withColumns(flags)
    return made.withColumn("is_anomaly", reduce(lambda a, b: a | b, [F.col(f) for f in flags]))


def anomaly_alerts(df: DataFrame) -> DataFrame:
    """The rows with an anomaly and the names of their flags."""
    flags = [c for c in df.columns if c.startswith("anomaly_")]
    return df.filter("is_anomaly").withColumn("anomaly_types", F.array_compact(F.array(*[F.when(F.col(f), F.lit(f.removeprefix("anomaly_"))) for f in flags])))


def complete(df: DataFrame, field: Field) -> Column:
    """Whether a row's value is there and well formed; 0 for columns that the frame lacks. NaN only in floating point."""
    if field.column not in df.columns:
        return F.lit(False)
    c, kind = F.col(field.column), df.schema[field.column].dataType
    ok = c.isNotNull()
    if isinstance(kind, T.FloatType | T.DoubleType):
        ok = ok & ~F.isnan(c)
    text = c.cast("string")
    if not field.allow_empty:
        ok = ok & (F.trim(text) != "")
    if field.least is not None:
        ok = ok & (F.length(text) >= field.least)
    if field.most is not None:
        ok = ok & (F.length(text) <= field.most)
    if field.pattern is not None:
        ok = ok & text.rlike(field.pattern)
    return F.coalesce(ok, F.lit(False))


def completeness(df: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """complete_* flags, the weighted score, its category, and whether it passes."""
    flags = {f"complete_{f.column}": complete(df, f).cast("int") for f in fields}
    total = sum(f.weight for f in fields)
    made = df.withColumns(flags)
    made = made.withColumn("completeness_score", F.round(sum((F.col(f"complete_{f.column}") * f.weight for f in fields), F.lit(0.0)) / total, 9))
    return made.withColumns({"completeness_category": bands(F.col("completeness_score"), COMPLETENESS, "poor"), "completeness_passed": F.col("completeness_score") >= COMPLETENESS[-1][0]})


def completeness_report(checked: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """For each field: complete rows, share, nulls and empty texts, from one aggregation."""
    parts = [F.count("*").alias("_n")]
    for i, f in enumerate(fields):
        there = f.column in checked.columns
        parts += [F.sum(f"complete_{f.column}").alias(f"c{i}"), (F.count_if(F.col(f.column).isNull()) if there else F.count("*")).alias(f"n{i}"), (F.count_if(F.trim(F.col(f.column).cast("string")) == "") if there else F.lit(0).cast("long")).alias(f"e{i}")]
    rows = [F.struct(F.lit(f.column).alias("field"), F.lit(f.required).alias("required"), F.col(f"c{i}").alias("complete"), ratio(F.col(f"c{i}"), F.col("_n")).alias("share"), F.col(f"n{i}").alias("nulls"), F.col(f"e{i}").alias("empty")) for i, f in enumerate(fields)]
    return checked.agg(*parts).select(F.inline(F.array(*rows)))


def assess(df: DataFrame, stream_type: str, as_of: str) -> DataFrame:
    """Validation, anomalies and completeness of the same stream type, and the score they give: 100, 75, 50 or 25."""
    amount = "total_amount" if "total_amount" in df.columns else "value"
    made = completeness(anomalies(validate(df, CHECKS[stream_type], as_of), amount), FIELDS[stream_type])
    v, c, a = F.col("validation_passed"), F.col("completeness_passed"), F.col("is_anomaly")
    score = F.when(v & c & ~a, 100).when(v & c & a, 75).when(v & ~c, 50).when(~v, 25).otherwise(0)
    return made.withColumns({"data_quality_score": score, "quality_level": bands(score, [(90, "excellent"), (75, "good"), (50, "fair"), (25, "poor")], "critical")})


def quality_dashboard(assessed: DataFrame) -> DataFrame:
    made = assessed.groupBy("quality_level").agg(F.count("*").alias("rows"), F.avg("data_quality_score").alias("avg_score"), F.avg("completeness_score").alias("avg_completeness"), F.count_if("is_anomaly").alias("anomalies"))
    return made.withColumn("share", ratio(F.col("rows"), F.sum("rows").over(W.partitionBy())))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each column: counts, distinct values, and numbers or lengths, all from one aggregation but for the quartiles.

    Statistics of a kind that a column does not have are null.
    """
    columns = columns or df.columns
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    none = F.lit(None).cast("double")

    def parts(i: int, c: str) -> list[Column]:
        v = F.col(c).cast("double") if c in numeric else none
        n = F.length(c).cast("double") if c in text else none
        stats = {
            "count": F.count(c), "nulls": F.count_if(F.col(c).isNull()), "distinct": F.countDistinct(c), "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "stddev": F.stddev(v), "skewness": F.skewness(v), "kurtosis": F.kurtosis(v),
            "zeros": F.count_if(v == 0), "negatives": F.count_if(v < 0), "min_length": F.min(n), "max_length": F.max(n), "avg_length": F.avg(n),
        }
        return [e.alias(f"_{i}_{k}") for k, e in stats.items()]

    names = ("count", "nulls", "distinct", "min", "max", "mean", "stddev", "skewness", "kurtosis", "zeros", "negatives", "min_length", "max_length", "avg_length")
    one = df.agg(*[p for i, c in enumerate(columns) for p in parts(i, c)])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}_{n}").alias(n) for n in names]) for i, c in enumerate(columns)]
    made = one.select(F.inline(F.array(*rows)))
    if of := [c for c in columns if c in numeric]:
        made = made.join(F.broadcast(quantiles(df, of, [0.25, 0.5, 0.75])), "column", "left")  # one row for each column
    else:
        made = made.withColumn("q", F.lit(None).cast("array<double>"))
    made = made.withColumns({name: F.get("q", F.lit(i)) for i, name in enumerate(("q25", "median", "q75"))}).drop("q")
    return made.withColumn("completeness", ratio(F.col("count"), F.col("count") + F.col("nulls")))


def top_values(df: DataFrame, column: str, most: int = 20) -> DataFrame:
    """The report of the most frequent values with their share."""
    made = df.groupBy(column).agg(F.count("*").alias("n"))
    return made.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy()))).orderBy(F.desc("n"), column).limit(most)


def detect_patterns(df: DataFrame, column: str) -> DataFrame:
    """Share of values of each known form, and the one that most values have (none below half)."""
    v = F.col(column).cast("string")
    one = df.filter(F.col(column).isNotNull()).agg(*[F.avg(v.rlike(p).cast("int")).alias(k) for k, p in PATTERNS.items()])
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("s"), F.lit(k).alias("k")) for k in PATTERNS]))
    return one.withColumn("pattern", F.when(best["s"] > 0.5, best["k"]))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's r of every pair of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])))


def table_rules(df: DataFrame, rules: list[dict], as_of: str) -> DataFrame:
    """rule, score and passed of stored rules: completeness, uniqueness, validity, consistency, accuracy, timeliness.

    A rule has type, columns, threshold, and what its type needs: pattern, condition, reference (a DataFrame) or max_age_hours.
    """
    parts = []
    for r in rules:
        c = r.get("columns", [None])[0]
        name, least = r.get("name", f"{r['type']}_{c}"), r.get("threshold", 0.95)
        if r["type"] == "completeness":
            score = sum((ratio(F.count(x), F.count("*")) for x in r["columns"]), F.lit(0.0)) / len(r["columns"])
        elif r["type"] == "uniqueness":
            score = ratio(F.countDistinct(*r["columns"]), F.count("*"))
        elif r["type"] == "validity":
            score = F.avg(F.coalesce(F.col(c).cast("string").rlike(r["pattern"]), F.lit(False)).cast("int"))
        elif r["type"] == "consistency":
            score = F.avg(F.coalesce(F.expr(r["condition"]), F.lit(False)).cast("int"))
        elif r["type"] == "timeliness":
            score = F.avg(F.coalesce(F.col(c) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {r['max_age_hours']} HOURS"), F.lit(False)).cast("int"))
        elif r["type"] == "accuracy":
            known = r["reference"].select(F.col(c).alias("_k"), F.lit(True).alias("_known")).distinct()
            parts.append(df.join(known, df[c] == F.col("_k"), "left").agg(F.avg(F.coalesce("_known", F.lit(False)).cast("int")).alias("score")).select(F.lit(name).alias("rule"), "score", (F.col("score") >= least).alias("passed")))
            continue
        else:
            raise ValueError(f"not a rule type: {r['type']!r}")
        parts.append((name, score, least))
    plain = [p for p in parts if isinstance(p, tuple)]
    one = df.agg(*[s.alias(f"_{i}") for i, (_, s, _) in enumerate(plain)])
    made = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("score"), (F.col(f"_{i}") >= least).alias("passed")) for i, (n, _, least) in enumerate(plain)])))
    return reduce(DataFrame.unionByName, [p for p in parts if not isinstance(p, tuple)], made)


def detect_pii(df: DataFrame, columns: list[str], least: float = 0.1) -> DataFrame:
    """Share of values with each kind of personal data by column, over all rows, and whether it exceeds `least`."""
    one = df.agg(*[F.avg(F.coalesce(F.col(c).cast("string").rlike(p), F.lit(False)).cast("int")).alias(f"{c}|{k}") for c in columns for k, p in PII.items()])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"`{c}|{k}`").alias("share")) for c in columns for k in PII]
    return one.select(F.inline(F.array(*rows))).withColumn("flagged", F.col("share") > least)


def check_table(df: DataFrame, not_null: list[str], unique: list[str], ranges: dict[str, tuple[float, float]], forms: dict[str, str]) -> DataFrame:
    """check, column, failures: nulls, repeated keys, values out of range and of another form."""
    parts = [F.count_if(F.col(c).isNull()).alias(f"null|{c}") for c in not_null]
    parts += [(F.count("*") - F.countDistinct(*unique)).alias(f"duplicate|{','.join(unique)}")]
    parts += [F.count_if((F.col(c) < a) | (F.col(c) > b)).alias(f"range|{c}") for c, (a, b) in ranges.items()]
    parts += [F.count_if(~F.col(c).rlike(p)).alias(f"form|{c}") for c, p in forms.items()]
    names = [f"null|{c}" for c in not_null] + [f"duplicate|{','.join(unique)}"] + [f"range|{c}" for c in ranges] + [f"form|{c}" for c in forms]
    rows = [F.struct(F.lit(n.split("|")[0]).alias("check"), F.lit(n.split("|")[1]).alias("column"), F.col(f"`{n}`").alias("failures")) for n in names]
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def group_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def messages(df: DataFrame, not_null: list[str], column: str, low: float, high: float) -> DataFrame:
    """quality_checks: what is wrong with a row, or null."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in not_null]
    out = F.when((F.col(column) < low) | (F.col(column) > high), F.lit(f"{column} out of range"))
    found = F.array_compact(F.array(*missing, out))
    return df.withColumn("quality_checks", F.when(F.size(found) > 0, F.array_join(found, "; ")))


def same_schema(df: DataFrame, expected: T.StructType) -> bool:
    """Names, types and nullability, in order."""
    return df.schema == expected


def null_metrics(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """df with an observation of the nulls (NaN in floating point) of the columns: no extra pass, also on streams."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    bad = lambda c: F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull()
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count_if(bad(c)).alias(c) for c in columns])


def report_struct(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The columns as one struct beside the rest of the row, for a monitoring stream."""
    return df.withColumn(name, F.struct(*columns))
