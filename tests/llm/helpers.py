"""Small tables for the training-data operators: nulls, empty and very long texts, repeated rows, clashing columns."""

import re

from pyspark.sql import types as T

WORDS = re.compile("[^\x20\x09-\x0d]+")
PROSE = "The quick brown fox jumps over the lazy dog while the band plays on and nobody minds the noise at all today . "

ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, PROSE * 3, "en", "a"), (5, PROSE * 3, "en", "a"), (5, PROSE * 3, "en", "a"), (None, "no id here but words enough " * 6, "en", "b"),
    (7, "x" * 5000, "en", "b"), (8, "Ünïcödé ßtraße élève 漢字 🎉 " * 9, "fr", "b"), (9, " ".join(f"w{i}" for i in range(4000)), "en", "c"), (10, PROSE + "password = hunter2hunter2 end", "en", "c"), (11, "line one here\n" * 12, "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA).withColumnsRenamed({})


def clashing(spark):
    """Columns named like those that operators make."""
    df = docs(spark)
    from pyspark.sql import functions as F

    for c in ("kept", "llr", "n_words", "block", "position", "score", "spans", "fp", "offset", "length", "sequence_id", "feature", "rule", "verdict", "prompt", "n_chars", "component_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())]))
