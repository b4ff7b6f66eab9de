"""A bounded sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out

FOLDS, HELD = 5, 0


def training_labels(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, y) of labelled documents outside the held-out fold: all of them, or about ``bound`` chosen by a hash of the id."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
    rows = rows.where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id"), FOLDS, HELD))
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("labels"), "doc_id"), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
