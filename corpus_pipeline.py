"""The corpus pipeline: documents in, packed training sequences out.

Each stage reads what the one before wrote. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import mixing, packing, quality, secrets, simhash
from tidemill.llm.common import materialize, table
from tidemill.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: fewer than 20 words, too many repeated ones, or a low likelihood ratio.

    Null and empty texts go, as they have no words; texts are judged whole, however long. Equal texts get the same verdict,
    so repeated rows stay or go together. A null id is never trusted. An empty table, or one that is rejected as a whole, gives an empty one.
    All columns stay as they are, whatever their names.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id (of equal ids the first row; null ids come last).

    Texts without words, null ones too, are copies of each other, and so are repeated rows. Whole texts are compared, however
    long. An empty table stays empty. All columns stay as they are, whatever their names.
    """
    return simhash.distinct_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, in whole texts, and n_chars counts anew; all rows stay, repeated ones too.

    Null and empty texts and all other columns stay as they are, whatever their names; overlapping secrets get one mark; an empty table stays empty.
    """
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture: the same rows, repeated ones too, and the same columns, whatever their names.

    A null source is one of its own; in a source null ids come first and equal ids in the order of the rows; texts, null, empty or
    very long, do not matter; an empty table stays empty.
    """
    return mixing.in_order(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences, which follow the order of the mixture.

    A null or empty text has the end id alone, a very long one many pieces; null ids stay null, repeated rows are packed as often
    as they occur, in the order of the rows; an empty table gives no pieces. Columns other than doc_id and text are ignored.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), ordered=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: Quality ratios, fingerprints, the lexer and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
