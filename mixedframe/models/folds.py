"""Fold assignment: by the key alone, or balanced within each class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fold_of, key_hash
from ..operators.joins import join_null_safe
from ..operators.ordered import BIN_ROWS, running_sums


def stratified_folds(df: DataFrame, key: str, target: str, k: int, output: str = "fold", bin_rows: int = BIN_ROWS) -> DataFrame:
    """``df`` with a fold 0..k-1: within each class the rows, in the order of a hash of their key, are dealt in turn.

    So the folds of a class differ by one row at most. The ranks are running counts over the
    distinct hashes of a class, cut into bins of bounded size; only rows of one class and one
    hash are put in order by a window.
    """
    names = df.columns
    hashed = df.withColumn("__h", key_hash(key))
    counts = running_sums(hashed.select(target, "__h", F.lit(1).cast("long").alias("__one")), "__h", ["__one"], [target], bin_rows)
    same = W.partitionBy(target, "__h").orderBy(key)
    placed = join_null_safe(hashed.withColumn("__nth", F.row_number().over(same) - 1), counts.select(target, "__h", "__one_before"), [target, "__h"], "left")
    # a row without a key has no hash; such rows of a class come first
    rank = F.coalesce("__one_before", F.lit(0)) + F.col("__nth")
    return placed.select(*names, F.pmod(rank, F.lit(k)).cast("int").alias(output))


def with_folds(df: DataFrame, key: str, target: str, k: int, stratified: bool = True) -> DataFrame:
    return stratified_folds(df, key, target, k) if stratified else df.withColumn("fold", fold_of(key, k))
