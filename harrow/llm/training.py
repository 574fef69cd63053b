"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier may be fitted on.
TRAIN_ROWS = 20_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled ids outside the held-out fold.

    The ids are the first by hash, so the same for any partitioning.  An id with
    several labels takes the largest.  At most ``rows`` ids are broadcast.
    """
    key = F.col(id_col).cast("long")
    known = labels.select(key.alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null").filter(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(key.alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
