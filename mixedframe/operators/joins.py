"""Joins used by the other operators.

No operator here forces a broadcast. A per-group statistic is joined back as a
plain equi-join: Spark broadcasts it when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, where adaptive
execution splits the partitions of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keep every row of ``left``; its columns come first."""
    return left.join(right, key, "left")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key; the left key columns are kept."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def attach_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Put the statistics of each row's group on the row.

    Without keys ``stats`` is a one-row aggregate and becomes a scalar subquery
    (computed once, then a constant), so no join is planned at all.
    """
    if keys:
        return join_null_safe(df, stats, keys, "left")
    names = stats.columns
    packed = stats.select(F.struct(*names).alias("s")).scalar()
    return (
        df.withColumn("__attached", packed)
        .select(*df.columns, *[F.col(f"__attached.{n}").alias(n) for n in names])
    )


def attach_scalar(df: DataFrame, aggregate: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate on every row of ``df``."""
    return attach_stats(df, aggregate)


def settings(**lists: Sequence) -> list[dict]:
    """Every combination of the given parameter lists."""
    return [dict(zip(lists, values)) for values in product(*lists.values())]


def grid(spark: SparkSession, **lists: Sequence) -> DataFrame:
    """Every combination of the given parameter lists, one row each."""
    return spark.createDataFrame([tuple(s.values()) for s in settings(**lists)], list(lists))


def bind_on_key(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Put columns of several tables side by side, matched by key and never by position.

    Every row of the first table stays; a table without its key leaves nulls.
    """
    return reduce(lambda a, b: a.join(b, key, "left"), frames)
