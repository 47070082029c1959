"""Labelled rows for the classifiers: a bounded sample for fitting, and the held-out split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows that no fit may learn from: crc32 of the id as text is divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out split, by the hash of their id.

    Rows without a label or an id don't count; of repeated ids the greatest label counts.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(id_col))
    ids = usable.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` pairs of numbers
