"""Row numbers, ranks, tiles and running sums over a whole table without sorting it in one task.

Rows are put into value ranges whose limits are approximate quantiles; where the limits lie
only decides how even the ranges are. A value that many rows share fills several limits; its rows are cut further, by the
tie-breaking id, where that is a number. Each range is numbered on its own, and starts at the total of the
ranges before it. As many ranges as shuffle partitions are made, 64 to 256, so tables of ranges stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_PARTS, MOST_PARTS = 64, 256
#: Limits are searched in blocks of this size, whose last ones are looked at first.
BLOCK = 16


def parts_of(df: DataFrame) -> int:
    return min(MOST_PARTS, max(LEAST_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def rough(v: Column) -> Column:
    """In single precision: a sum that comes out another way in its last bits is still in the same range."""
    return v.cast("float").cast("double")


def limits(df: DataFrame, values: list[Column], tie: str, parts: int) -> Column:
    """One struct: the limits of each of the values, the last one of each full block of them, and the least and greatest tie where that is a number."""
    steps = [i / parts for i in range(1, parts)]
    found = [F.coalesce(F.percentile_approx(rough(v), steps, 16 * parts), F.array().cast("array<double>")) for v in values]
    ends = [f(F.col(tie)).cast("double") if isinstance(df.schema[tie].dataType, T.NumericType) else F.lit(0.0) for f in (F.min, F.max)]
    made = df.agg(F.array(*found).alias("limits"), *[x.alias(f"_end{i}") for i, x in enumerate(ends)])
    heads = F.transform("limits", lambda x: F.filter(x, lambda _, i: i % BLOCK == BLOCK - 1)).alias("heads")
    return made.select(F.struct("limits", heads, F.col("_end0").alias("low"), F.col("_end1").alias("high"))).scalar()


def once(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it: a lambda binds it, as conditions are computed anew for each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def place(df: DataFrame, v: Column, tie: str, at: int, parts: int) -> Column:
    """The number of a row's range, by column `_limits`; it never falls in the order of (v, tie), nulls first."""
    found, heads = F.get("_limits.limits", F.lit(at)), F.get("_limits.heads", F.lit(at))

    numeric = isinstance(df.schema[tie].dataType, T.NumericType)
    cut = F.floor(F.try_divide(F.col(tie).cast("double") - F.col("_limits.low"), F.col("_limits.high") - F.col("_limits.low")) * (parts - 1)) if numeric else F.lit(0)
    cut = F.coalesce(cut, F.lit(0)).cast("long")
    r = rough(v)
    whole = BLOCK * F.size(F.filter(heads, lambda x: x < r))
    search = once(whole, lambda n: n + F.size(F.filter(F.slice(found, n + 1, BLOCK), lambda x: x < r)))  # limits are sorted

    def number_of(below: Column) -> Column:
        several = F.get(found, below + 1) == r  # the limits are sorted, so two of them are r
        inside = F.when(several & (v == r), cut + 1).when(several & (v > r), F.lit(parts + 1).cast("long")).otherwise(F.lit(0).cast("long"))
        return below * (parts + 2) + inside

    return F.when(v.isNull(), cut - (parts + 2)).otherwise(once(search, number_of))


def number(value: Column, descending: bool) -> Column:
    return -value.cast("double") if descending else value.cast("double")


def ranged(df: DataFrame, value: Column, tie: str, weight: Column | None = None, descending: bool = False) -> DataFrame:
    """df with _v, the value to order by, _range, _before (rows in the ranges before), _total, and _sum_before, _sum_total of weight.

    _same: in a range of rows that all have one value, and null for others, the rows before that value.
    """
    parts = parts_of(df)
    df = df.withColumn("_v", number(value, descending))
    df = df.withColumn("_limits", limits(df, [F.col("_v")], tie, parts))
    df = df.withColumn("_range", place(df, F.col("_v"), tie, 0, parts)).drop("_limits")
    weight = F.lit(0.0) if weight is None else weight.cast("double")
    sizes = df.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(weight).alias("_s"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    sizes = sizes.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy()).alias("_total"),
        F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_sum_before"),
        F.sum("_s").over(W.partitionBy()).alias("_sum_total"),
    )
    one_value = (F.col("_range") < 0) | F.pmod("_range", F.lit(parts + 2)).between(1, parts)
    sizes = sizes.withColumn("_same", F.when(one_value, F.min("_before").over(W.partitionBy(F.floor(F.col("_range") / (parts + 2)), one_value))))
    return df.join(F.broadcast(sizes), "_range")


HELPERS = ("_v", "_range", "_before", "_total", "_sum_before", "_sum_total", "_same")


def with_row_number(df: DataFrame, name: str, value: Column, tie: str, descending: bool = False) -> DataFrame:
    """name: 1, 2, ... in the order of (value, tie), nulls first; tie should be unique."""
    made = ranged(df, value, tie, descending=descending)
    return made.withColumn(name, F.row_number().over(W.partitionBy("_range").orderBy("_v", tie)) + F.col("_before")).drop(*HELPERS)


def with_ntiles(df: DataFrame, tiles: int, tie: str, values: dict[str, tuple[Column, bool]]) -> DataFrame:
    """Several columns of tiles, name: (value, descending), as ntile(tiles) over the order of (value, tie).

    The limits of all columns are one aggregate and the sizes of all ranges another, so df is
    read three times, however many columns there are.
    """
    names, parts = list(values), parts_of(df)
    df = df.withColumns({f"_v{i}": number(v, down) for i, (v, down) in enumerate(values.values())})
    df = df.withColumn("_limits", limits(df, [F.col(f"_v{i}") for i in range(len(names))], tie, parts))
    df = df.withColumns({f"_r{i}": place(df, F.col(f"_v{i}"), tie, i, parts) for i in range(len(names))}).drop("_limits")
    each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"_r{i}").alias("r")) for i in range(len(names))])).alias("x")).groupBy("x.c", "x.r").agg(F.count("*").alias("n"))
    upto = W.partitionBy("c").orderBy("r").rowsBetween(W.unboundedPreceding, -1)  # one row for each range of a column
    each = each.select("c", "r", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("c")).alias("total"))
    for i, name in enumerate(names):
        sizes = each.filter(F.col("c") == i).select(F.col("r").alias(f"_r{i}"), F.col("before").alias("_before"), F.col("total").alias("_total"))
        at = F.row_number().over(W.partitionBy(f"_r{i}").orderBy(f"_v{i}", tie)) + F.col("_before") - 1
        df = df.join(F.broadcast(sizes), f"_r{i}").withColumns({"_at": at, "_q": F.floor(F.col("_total") / tiles), "_x": F.col("_total") % tiles})
        long = F.col("_x") * (F.col("_q") + 1)
        tile = F.when(F.col("_at") < long, F.floor(F.col("_at") / (F.col("_q") + 1))).otherwise(F.col("_x") + F.floor(F.try_divide(F.col("_at") - long, F.col("_q"))))
        df = df.withColumn(name, (tile + 1).cast("int")).drop("_at", "_q", "_x", "_before", "_total", f"_v{i}", f"_r{i}")
    return df


def with_percent_rank(df: DataFrame, name: str, value: Column, descending: bool = False) -> DataFrame:
    """name: (rank - 1) / (rows - 1), 0 in a table of one row. The rows of a frequent value are dealt by a hash, as they all have one rank."""
    exact = [f.name for f in df.schema if not isinstance(f.dataType, T.DoubleType | T.FloatType | T.MapType)]
    made = ranged(df.withColumn("_tie", F.xxhash64(*exact)), value, "_tie", descending=descending)
    rank = F.coalesce("_same", F.rank().over(W.partitionBy("_range").orderBy("_v")) + F.col("_before") - 1)
    return made.withColumn(name, F.coalesce(F.try_divide(rank.cast("double"), (F.col("_total") - 1).cast("double")), F.lit(0.0))).drop("_tie", *HELPERS)


def with_share(df: DataFrame, value: Column, tie: str) -> DataFrame:
    """row_rank, cumulative, total of value in descending order of it, ties one after the other."""
    made = ranged(df, value, tie, weight=value, descending=True)
    w = W.partitionBy("_range").orderBy("_v", tie)
    made = made.withColumns(
        {
            "row_rank": F.row_number().over(w) + F.col("_before"),
            "cumulative": F.sum(value.cast("double")).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("_sum_before"),
            "total": F.col("_sum_total"),
        }
    )
    return made.drop(*HELPERS)


def quantiles(df: DataFrame, columns: list[str], at: list[float]) -> DataFrame:
    """One row for each column that has values: column, and q, its exact quantiles, interpolated between the two nearest values.

    Distinct values are counted first and laid out over ranges, so no task holds all values of a column.
    """
    parts = parts_of(df)
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")
    each = each.filter("x IS NOT NULL").groupBy("column", "x").agg(F.count("*").alias("n"))
    cuts = each.groupBy("column").agg(F.percentile_approx(rough(F.col("x")), [i / parts for i in range(1, parts)], 16 * parts).alias("limits"))  # one row for each column
    r = rough(F.col("x"))
    each = each.join(F.broadcast(cuts), "column").withColumn("range", F.size(F.filter("limits", lambda y: y < r))).drop("limits")
    upto = W.partitionBy("column").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sizes = each.groupBy("column", "range").agg(F.sum("n").alias("s"))
    sizes = sizes.select("column", "range", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("before"), F.sum("s").over(W.partitionBy("column")).alias("total"))
    inside = F.sum("n").over(W.partitionBy("column", "range").orderBy("x").rowsBetween(W.unboundedPreceding, -1))
    each = each.join(F.broadcast(sizes), ["column", "range"]).withColumn("before", F.col("before") + F.coalesce(inside, F.lit(0)))
    value_at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("x")))
    out = []
    for q in at:
        place = (F.col("total") - 1) * F.lit(float(q))
        out += [value_at(F.floor(place)).alias(f"a{len(out) // 3}"), value_at(F.ceil(place)).alias(f"b{len(out) // 3}"), F.max(place - F.floor(place)).alias(f"f{len(out) // 3}")]
    made = each.groupBy("column").agg(*out)
    return made.select("column", F.array(*[F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}") for i in range(len(at))]).alias("q"))
