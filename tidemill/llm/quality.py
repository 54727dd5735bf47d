"""Quality rules: base rules and a hashed n-gram log-likelihood ratio, in DataFrame operations alone.

Grams are whole words, and runs of two words that are each represented by their last three characters (pairs of whole
words are too rare to be counted well), hashed into a fixed number of buckets. Two multinomials over the buckets are counted: one over the trusted
documents, one over the raw corpus, which is every document. The trusted one is
smoothed towards the raw one (a Dirichlet prior of `prior` grams), so without trusted rows the
ratio is 0 throughout. A document's ratio is the mean of log p_trusted - log p_raw over its
grams; it stays if that is at least `threshold`, always the same verdict for the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import let, materialize, words

BUCKETS = 1 << 15
PRIOR = 10_000.0
THRESHOLD = -0.2
WINDOW = 8
#: Trusted ids are broadcast; beyond this number they are joined by a shuffle.
MOST_TRUSTED = 500_000
SYMBOLS = "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more in the array of words, the first occurrence included.

    Sorted (hash, place) pairs bring equal windows together; O(n log n) for a text of n words.
    """
    hashes = let(found, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(window - 1)), lambda i: F.xxhash64(F.slice(w, i, window))))

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(let(pairs, twice), lambda x: x["i"]))

    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))), F.lit(0).cast("long"), lambda a, b: a + b
    )
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places(h), covered))
    return F.when(F.size(found) > window, let(hashes, count)).otherwise(F.lit(0).cast("long"))


def base_features(docs: DataFrame) -> DataFrame:
    """docs with the base counts and `_w`, the words; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.withColumn("_w", words(F.col("text"))).withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.concat_ws("", "_w")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": repeated_words(F.col("_w")),
        }
    )


def grams(found: Column, buckets: int) -> Column:
    """The buckets of a text's grams: hashes of its words, and hashes of word endings, each with the next one's shifted by a bit."""
    bucket = lambda x: F.pmod(x, F.lit(buckets)).cast("int")
    pair = lambda a, b: bucket(a.bitwiseXOR(F.shiftleft(b, 1)))

    def pairs(e: Column) -> Column:
        n = F.greatest(F.size(e) - 1, F.lit(0))
        return F.zip_with(F.slice(e, F.lit(1), n), F.slice(e, F.lit(2), n), pair)

    ends = F.transform(found, lambda w: F.xxhash64(F.substring(w, -3, 3)))
    return F.concat(F.transform(found, lambda w: bucket(F.xxhash64(w))), let(ends, pairs))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Distinct ids labelled as of good quality."""
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def marked(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, text and _t, 1 for documents with a trusted id; texts travel only if there are more than `most` such ids."""
    docs, trusted = docs.select("doc_id", "text"), materialize(trusted_ids(labels).withColumn("_t", F.lit(1)), "quality-trusted")
    if trusted.count() <= (MOST_TRUSTED if most is None else most):
        made = docs.join(F.broadcast(trusted), "doc_id", "left")
    else:  # null ids are never trusted and would all meet in one task
        made = docs.filter("doc_id IS NOT NULL").join(trusted.hint("merge"), "doc_id", "left").unionByName(docs.filter("doc_id IS NULL").withColumn("_t", F.lit(None).cast("int")))
    return made.withColumn("_t", F.coalesce("_t", F.lit(0)))


def ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row, one column: log p_trusted - log p_raw of each bucket as an array (0 where the corpus has none)."""
    each = marked(docs, labels).select("_t", F.explode(grams(words(F.col("text")), buckets)).alias("bucket"))
    counts = materialize(each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_t").alias("trusted")), "quality-counts")
    n, t = (counts.agg(F.sum(c)).scalar() for c in ("raw", "trusted"))
    raw = F.col("raw") / n
    llr = F.log((F.col("trusted") + F.lit(prior) * raw) / (t + F.lit(prior))) - F.log(raw)
    dense = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts.select("bucket", llr.alias("llr")), "bucket", "left")
    pairs = F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("llr", F.lit(0.0)).alias("llr"))))  # `buckets` of them
    return materialize(dense.agg(F.transform(pairs, lambda x: x["llr"]).alias("llr")), "quality-ratios")


def judged(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, perhaps _row) with the base counts, base_failed, llr and kept."""
    model = ratios(docs, labels, buckets, prior)
    made = base_features(docs).withColumn("_m", model.scalar()).withColumn("_g", grams(F.col("_w"), buckets))
    total = let(F.col("_m"), lambda m: F.aggregate("_g", F.lit(0.0), lambda sofar, b: sofar + F.get(m, b)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    made = made.withColumn("llr", F.when(F.size("_g") > 0, total / F.size("_g"))).withColumn("base_failed", failed)
    return made.withColumn("kept", ~F.col("base_failed") & (F.coalesce("llr", F.lit(0.0)) >= threshold)).drop("_w", "_m", "_g")


def judge(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, the base counts, base_failed, llr and kept for every row of docs (doc_id, text; others are ignored).

    base_failed: fewer than 20 words, or more than 30 % of them in repeated windows. A null or
    empty text has no words and fails. llr is null for a text without words. Texts are read whole, however long.
    Repeated rows each get a row, null ids stay (and are never trusted), empty tables give an empty result.
    """
    return judged(docs.select("doc_id", "text"), labels, **params).select("doc_id", *COUNTS, "base_failed", "llr", "kept")


def keep(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs that judge() keeps, repeated ones too, with all their columns as they were, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    made = judged(docs.select(row, "doc_id", "text"), labels, **params)
    # A filter would move below the projections and compute the words anew for each use of them.
    return made.select(F.inline(F.when(F.col("kept"), F.array("_row"))))
