"""Labelled documents: folds, and joins that keep texts out of shuffles where they can."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 1_000_000  # labels up to this many rows, 25 MB at most, are broadcast


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def with_labels(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label) of the documents that have a label."""
    marks = labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    small = marks.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return docs.select("doc_id", "text").join(F.broadcast(marks) if small else marks, "doc_id")


def sample(marks: DataFrame, rows: int) -> DataFrame:
    """At most `rows` of the labels, those with the smallest hash of the id."""
    return marks.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(rows)
