"""URL filter: host and path rules, and gradient-boosted trees on lexical features for all other URLs.

The trees learn from labelled URLs, by default those that a rule decides, a bounded sample of them.
Features: lengths, path depth, digit ratios, entropies, numbers of parameters, hyphens and host
labels, and statistics of suffixes: the smoothed share of blocked URLs among the labelled ones with
the same last label, last two labels and file suffix, kept in a fixed number of hash buckets.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import let, materialize

#: Labelled URLs that the trees are fitted on, at most about this many: those with the least hashes.
MOST_LABELLED = 50_000
SUFFIX_BUCKETS = 4096
#: Pseudo-counts of the suffix statistics.
PRIOR = 5.0
TREES = 20
DEPTH = 4
THRESHOLD = 0.5
SEED = 7


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules(allow: tuple[str, ...] = (), block: tuple[str, ...] = ()) -> list[Rule]:
    """Rules from `host/path` strings."""
    return [Rule(*(x.partition("/")[0], "/" + x.partition("/")[2]), verdict) for verdict, xs in (("allow", allow), ("block", block)) for x in xs]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty for null and for URLs without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def longest_rule(host: Column, path: Column, given: list[Rule]) -> Column:
    """Struct of rule and verdict of the longest rule that fits, null if none does."""
    fits = [
        F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in given
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def entropy(text: Column) -> Column:
    """Bits for each character."""
    n = F.length(text)
    share = lambda chars: F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    bits = lambda chars: F.aggregate(share(chars), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(n > 0, let(F.split(text, ""), bits)).otherwise(F.lit(0.0))


def ratio(text: Column, kind: str) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, f"[^{kind}]", "")) / F.length(text)).otherwise(F.lit(0.0))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda text, sign: (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))).cast("double")
    return {
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_query_length": F.length(query).cast("double"),
        "f_depth": F.size(F.array_remove(F.split(path, "/"), "")).cast("double"),
        "f_labels": F.size(F.split(host, r"\.")).cast("double"),
        "f_parameters": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(F.lit(0.0)),
        "f_hyphens": count(host, "-"),
        "f_host_digits": ratio(host, "0-9"),
        "f_path_digits": ratio(path, "0-9"),
        "f_host_entropy": entropy(host),
        "f_path_entropy": entropy(path),
        "f_secure": url.startswith("https://").cast("double"),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    return {
        "s_last": F.substring_index(host, ".", -1),
        "s_two": F.substring_index(host, ".", -2),
        "s_file": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
    }


def bucket(kind: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(kind), F.col(kind)), F.lit(SUFFIX_BUCKETS)).cast("int")


def judge(pages: DataFrame, given: list[Rule], labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability for each row of pages (page_id, url; others are ignored).

    labels (url, verdict) replaces the URLs that rules decide as what the trees learn from. With
    fewer than two verdicts among the labelled URLs there is nothing to learn: the rest gets
    the only one, or `allow` without any. Null, empty and very long URLs are judged whole
    by the trees like others; repeated rows, ties and null ids stay; an empty table gives an empty result.
    At most MOST_LABELLED distinct URLs are fitted on, half of them of each verdict, weighted by the rows that they stand for.
    """
    spark = pages.sparkSession
    clean = lambda df: df.withColumns(dict(zip(("host", "path"), parts(F.col("url")), strict=True)))
    made = clean(pages.select("page_id", "url")).withColumn("_rule", longest_rule(F.col("host"), F.col("path"), given))
    made = made.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")) | suffixes(F.col("host"), F.col("path"))).withColumn("_h", F.xxhash64("url"))
    made = materialize(made.drop("url"), "urls-features")
    if labels is None:
        known = made.filter("_rule IS NOT NULL").withColumn("label", (F.col("_rule.verdict") == "block").cast("double"))
    else:
        known = clean(labels.select("url", "verdict")).withColumns(lexical(F.col("url"), F.col("host"), F.col("path")) | suffixes(F.col("host"), F.col("path")))
        known = known.withColumns({"_h": F.xxhash64("url"), "label": (F.col("verdict") == "block").cast("double")}).drop("url", "verdict")
    sizes = known.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    n, blocked = sizes["n"], sizes["blocked"] or 0.0
    rule, verdict = F.col("_rule.rule").alias("rule"), F.col("_rule.verdict")
    if blocked in (0.0, float(n)):
        chance = 1.0 if n and blocked else 0.0
        return made.select("page_id", "host", "path", rule, F.coalesce(verdict, F.lit("block" if chance >= threshold else "allow")).alias("verdict"), F.lit(chance).alias("block_probability"))

    rate = blocked / n
    dense = spark.range(SUFFIX_BUCKETS).withColumnRenamed("id", "b")
    rates = {}
    for kind in ("s_last", "s_two", "s_file"):
        seen = known.groupBy(bucket(kind).alias("b")).agg(((F.sum("label") + PRIOR * rate) / (F.count("*") + PRIOR)).alias("r"))
        pairs = F.sort_array(F.collect_list(F.struct("b", F.coalesce("r", F.lit(rate)).alias("r"))))
        rates[f"f_{kind}"] = materialize(dense.join(seen, "b", "left").agg(F.transform(pairs, lambda x: x["r"]).alias(kind)), "urls-suffixes")
    with_rates = lambda df: df.withColumns({f: F.get(r.scalar(), bucket(f[2:])) for f, r in rates.items()})
    features = sorted(c for c in with_rates(made).columns if c.startswith("f_"))
    vector = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    # A bounded sample of distinct URLs of each label; weights stand for the rows, and for the URLs left out.
    each = materialize(with_rates(known).groupBy("_h", "label", *features).agg(F.count("*").alias("rows")), "urls-labelled")
    found = {r["label"]: r["n"] for r in each.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    half = lambda label: min(found[label], MOST_LABELLED // 2)
    parts_ = [each.filter(F.col("label") == x).orderBy("_h", *features).limit(half(x)).withColumn("weight", F.col("rows") * F.lit(found[x] / half(x))) for x in sorted(found)]
    train = materialize(reduce(DataFrame.unionByName, parts_).select("label", "weight", "_h", *features), "urls-train")
    train = vector.transform(train.coalesce(1).sortWithinPartitions("_h", "label", *features)).select("features", "label", "weight")
    model = GBTClassifier(weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=1.0, featureSubsetStrategy="all").fit(train)
    scored = model.transform(vector.transform(with_rates(made)))
    chance = vector_to_array("probability")[1]
    by_trees = F.when(chance >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule, F.coalesce(verdict, by_trees).alias("verdict"), chance.alias("block_probability"))
