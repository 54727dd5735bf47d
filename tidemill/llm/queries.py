"""The registered queries of the training-data operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import chat, katz, media, mixing, packing, quality, secrets, simhash, toxicity, urls
from tidemill.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.conversations(table(spark, sf_dir, "conversations"))
    made = chat.format_preferences(found.select("conv_id", F.col("turns").alias("chosen"), chat.stale_replies(F.col("turns")).alias("rejected")))
    spans = [chat.listed(F.col(f"{c}_spans")).alias(f"{c}_spans") for c in ("chosen", "rejected")]
    return made.select("conv_id", F.col("prompt_turns").cast("long"), "prompt", "chosen_completion", "rejected_completion", *spans)


OP2_SQL = """
WITH numbered AS (
  SELECT conv_id, role, text, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
earlier AS (
  SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reply FROM numbered),
branches AS (
  SELECT *, CASE WHEN role = 'assistant' AND i >= n // 2 THEN coalesce(reply, '') ELSE text END AS other FROM earlier),
cut AS (
  SELECT conv_id, coalesce(min(i) FILTER (WHERE text IS DISTINCT FROM other), max(n)) AS k FROM branches GROUP BY conv_id),
parts AS (
  SELECT conv_id, i, k, role, '<|' || coalesce(role, '') || '|>' || chr(10) AS head,
    replace(coalesce(text, ''), '<|', '< |') AS a, replace(coalesce(other, ''), '<|', '< |') AS b FROM branches JOIN cut USING (conv_id)),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(a) + 8) FILTER (WHERE i >= k) OVER w, 0) + length(head) AS a_at,
    coalesce(sum(length(head) + length(b) + 8) FILTER (WHERE i >= k) OVER w, 0) + length(head) AS b_at
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, CAST(max(k) AS BIGINT) AS prompt_turns,
  coalesce(string_agg(head || a || '<|end|>' || chr(10), '' ORDER BY i) FILTER (WHERE i < k), '') AS prompt,
  coalesce(string_agg(head || a || '<|end|>' || chr(10), '' ORDER BY i) FILTER (WHERE i >= k), '') AS chosen_completion,
  coalesce(string_agg(head || b || '<|end|>' || chr(10), '' ORDER BY i) FILTER (WHERE i >= k), '') AS rejected_completion,
  coalesce(string_agg(CAST(a_at AS BIGINT) || ':' || CAST(a_at + length(a) + 7 AS BIGINT), ',' ORDER BY i) FILTER (WHERE i >= k AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(CAST(b_at AS BIGINT) || ':' || CAST(b_at + length(b) + 7 AS BIGINT), ',' ORDER BY i) FILTER (WHERE i >= k AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY conv_id
"""


def op3_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op4_ngram_likelihood_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_distance=2)


def op6_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = urls.rules(allow=("example.com/en/7", "net/de/"), block=("com/en/", "example.net/de/8", "org/es/"))
    return urls.judge(table(spark, sf_dir, "pages"), given)


def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op10_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "literal")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_harmonic_packing, op2_preference_chat, op3_chunked_media, op4_ngram_likelihood_quality, op5_simhash_gray_index, op6_boosted_url_filter, op7_weak_toxicity, op8_katz_backoff, op9_pfair_mixing, op10_assignment_secrets)}
ORACLE_SQL: dict[str, str] = {"op2_preference_chat": OP2_SQL}
