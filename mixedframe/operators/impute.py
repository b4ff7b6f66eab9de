"""Imputation of missing numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fold_of
from ..session import stage
from .joins import attach_stats, join_null_safe
from .neighbours import NeighbourIndex, knn_join
from .ordered import exact_median, exact_quantiles


def impute_group_median(df: DataFrame, key: str, c: str, missing: Column | None = None, output: str | None = None,
                        medians: DataFrame | None = None) -> DataFrame:
    """Replace missing numbers by the median of the row's group.

    The median is over all rows of the group, the missing form included, so a group
    that is mostly missing keeps a low value. ``missing`` defaults to ``c < 2``.
    ``medians`` from ``group_medians`` of another table applies what was learned there; a
    group unknown to it then keeps null. By default the table's own medians are used.
    """
    missing = F.col(c) < 2 if missing is None else missing
    medians = group_medians(df, key, c) if medians is None else medians
    filled = attach_stats(df, medians, [key])
    value = F.when(missing, F.col("__med")).otherwise(F.col(c).cast("double"))
    return filled.withColumn(output or c, value).drop("__med")


def group_medians(df: DataFrame, key: str, c: str) -> DataFrame:
    """The median of each group, as ``impute_group_median`` applies it."""
    return exact_median(df, c, [key], "__med")


def audit_group_median(df: DataFrame, key: str, c: str, missing: Column | None = None) -> DataFrame:
    """Groups whose median moves when missing numbers get the group's median: (key, median_before, median_after).

    The rows are read once: a group's values and how often each occurs, missing or not,
    give both medians.
    """
    missing = F.col(c) < 2 if missing is None else missing
    value = F.col(c).cast("double")
    counted = df.select(key, value.alias("__v"), F.coalesce(missing, F.lit(False)).alias("__gone"))
    values = stage(counted.groupBy(key, "__v", "__gone").agg(F.count("*").alias("__rows")), "values")
    before = stage(exact_quantiles(values, "__v", {"median_before": 0.5}, [key], weight="__rows"), "medians")
    after = attach_stats(values, before, [key]).withColumn("__v", F.when(F.col("__gone"), F.col("median_before")).otherwise(F.col("__v")))
    moved = exact_quantiles(after, "__v", {"median_after": 0.5}, [key], weight="__rows")
    return join_null_safe(before, moved, [key]).filter(F.col("median_before") != F.col("median_after"))


def knn_impute(df: DataFrame, key: str, features: Sequence[str] | str, target: str, k: int = 5,
               missing: Column | None = None, output: str = "imputed", ref: DataFrame | None = None, **options) -> DataFrame:
    """Replace missing targets by the mean target of the k nearest known rows.

    Each missing row is predicted from its own features. ``ref`` is the table the
    known rows come from (fit on one table, apply to another); default the same table.
    """
    missing = (F.col(target) == 0) if missing is None else missing
    known = (df if ref is None else ref).filter(~missing)
    near = knn_join(df.filter(missing), known, key, features, k, payload=[target], **options)
    means = near.groupBy(key).agg(F.avg(target).alias("__mean"))
    return df.join(means, key, "left").withColumn(
        output, F.when(missing, F.col("__mean")).otherwise(F.col(target).cast("double"))
    ).drop("__mean")


def knn_impute_cv(df: DataFrame, key: str, features: Sequence[str] | str, target: str, ks: Sequence[int] = (5, 7, 9, 11),
                  folds: int = 10, **options) -> DataFrame:
    """Held-out predictions (key, k, fold, obs, pred) of the neighbour mean for each k.

    One index serves all folds and the largest k; smaller k are prefixes of the same result.
    A row without neighbours has no prediction.
    """
    named = [features] if isinstance(features, str) else list(features)
    folded = stage(df.select(key, target, *[c for c in named if c not in (key, target)]).withColumn("fold", fold_of(key, folds)), "folds")
    index = NeighbourIndex(key, features, max(ks), [target], apart="fold", **options).fit(folded)
    sizes = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    means = (
        index.join(folded, key).select(key, "rank", target, sizes).filter(F.col("rank") <= F.col("k"))
        .groupBy(key, "k").agg(F.avg(target).alias("pred"))
    )
    asked = folded.select(key, "fold", F.col(target).cast("double").alias("obs"), sizes)
    return asked.join(means, [key, "k"], "left")
