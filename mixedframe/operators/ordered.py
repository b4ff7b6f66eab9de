"""Exact order statistics without ever sorting one group in one task.

A running total over an ordered column (ranks, quantiles, ROC counts) needs the
values of a group in order. A window over the whole group would sort a hot group
in a single task, so the work is laid out as:

1. collapse the rows to one per (group, value), which combines map-side and
   hashes on both columns, so a hot group spreads over all tasks;
2. for groups that still have more than ``bin_rows`` distinct values, take
   quantile cut points (a mergeable sketch of fixed size) and split the group
   into bins of about equal size;
3. total each bin, accumulate the bin totals, and run
   the window inside (group, bin) only.

Cut points only decide where the work is split: any cut points give the same,
exact, result. The aggregate of step 1 is used by every later step and Spark
reuses its shuffle, so the input is scanned once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import attach_stats, join_null_safe

BIN_ROWS = 1_000_000


def _side(df: DataFrame) -> int:
    """Bins of a large group are a square number, at least 1,024 and as many as there are shuffle partitions.

    So they follow the setting by which a job is fitted to its data.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(32, ceil(sqrt(partitions)))


def _cut_points(totals: DataFrame, order: str, keys: Sequence[str], bin_rows: int) -> DataFrame:
    side = _side(totals)
    accuracy = max(10_000, 10 * side**2)
    # one text literal instead of a thousand number literals keeps the plan small
    listed = ",".join(str(i / side**2) for i in range(1, side**2))
    shares = F.split(F.lit(listed), ",").cast("array<double>")
    if keys:
        heavy = totals.groupBy(*keys).agg(F.count("*").alias("__m")).filter(F.col("__m") > bin_rows)
        totals = join_null_safe(totals, heavy, keys, "left_semi")
        cuts = totals.groupBy(*keys).agg(F.percentile_approx(order, shares, accuracy).alias("__cuts"))
    else:
        cuts = totals.agg(
            F.when(F.count("*") > bin_rows, F.percentile_approx(order, shares, accuracy)).alias("__cuts")
        )
    coarse = F.filter("__cuts", lambda _, i: (i + 1) % side == 0)
    return cuts.withColumn("__coarse", coarse)


def _below(cuts: Column, value: Column) -> Column:
    return F.coalesce(F.size(F.filter(cuts, lambda cut: cut < value)), F.lit(0))


def _binned(totals: DataFrame, order: str, keys: Sequence[str], bin_rows: int) -> DataFrame:
    cuts = _cut_points(totals, order, keys, bin_rows)
    value, side = F.col(order), _side(totals)
    located = attach_stats(totals, cuts, keys).withColumn(
        "__row", F.when(F.col("__cuts").isNull(), 0).otherwise(_below(F.col("__coarse"), value))
    )
    within = F.slice("__cuts", F.col("__row") * side + 1, F.lit(side))
    number = F.when(F.col("__cuts").isNull(), 0).otherwise(
        F.col("__row") * side + _below(within, value)
    )
    return located.withColumn("__bin", number).drop("__cuts", "__coarse", "__row")


def _bin_offsets(binned: DataFrame, sums: Sequence[str], keys: Sequence[str]) -> DataFrame:
    per_bin = binned.groupBy(*keys, "__bin").agg(*[F.sum(c).alias(f"__in_{c}") for c in sums])
    group = W.partitionBy(*keys)
    earlier = group.orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    # as many rows per group as it has bins
    return per_bin.select(
        *keys,
        "__bin",
        *[F.col(f"__in_{c}") for c in sums],
        *[F.coalesce(F.sum(f"__in_{c}").over(earlier), F.lit(0)).alias(f"__off_{c}") for c in sums],
        *[F.sum(f"__in_{c}").over(group).alias(f"{c}_total") for c in sums],
    )


def _accumulate(binned: DataFrame, offsets: DataFrame, order: str, sums: Sequence[str], keys: Sequence[str]) -> DataFrame:
    earlier = W.partitionBy(*keys, "__bin").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    joined = join_null_safe(binned, offsets, [*keys, "__bin"])
    return joined.select(
        *keys,
        order,
        *sums,
        *[
            (F.col(f"__off_{c}") + F.coalesce(F.sum(c).over(earlier), F.lit(0))).alias(f"{c}_before")
            for c in sums
        ],
        *[f"{c}_total" for c in sums],
    )


def _totals(df: DataFrame, order: str, sums: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return (
        df.filter(F.col(order).isNotNull())
        .groupBy(*keys, order)
        .agg(*[F.sum(c).alias(c) for c in sums])
    )


def running_sums(df: DataFrame, order: str, sums: Sequence[str], keys: Sequence[str] = (), bin_rows: int = BIN_ROWS) -> DataFrame:
    """One row per (keys, order value): ``c``, ``c_before`` (total of smaller values), ``c_total``."""
    totals = _totals(df, order, sums, keys)
    binned = _binned(totals, order, keys, bin_rows)
    return _accumulate(binned, _bin_offsets(binned, sums, keys), order, sums, keys)


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = (), bin_rows: int = BIN_ROWS,
                    weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles per group: keys, one column per name in ``probs``.

    ``weight`` names a column of row counts where ``df`` is already collapsed.

    Only the bins that hold a wanted position are ordered; all others are dropped
    after they are counted. A group with no non-null value has no row; without keys the one row
    is then null.
    """
    each = (F.col(weight) if weight else F.lit(1)).cast("long")
    counted = df.select(*keys, F.col(value).cast("double").alias("__v"), each.alias("__n"))
    totals = _totals(counted, "__v", ["__n"], keys)
    binned = _binned(totals, "__v", keys, bin_rows)
    position = {name: (F.col("__n_total") - 1) * F.lit(float(p)) for name, p in probs.items()}

    def touches(before: Column, size: Column) -> Column:
        hit = F.lit(False)
        for pos in position.values():
            hit = hit | ((before <= F.ceil(pos)) & (before + size > F.floor(pos)))
        return hit

    offsets = _bin_offsets(binned, ["__n"], keys).filter(touches(F.col("__off___n"), F.col("__in___n")))
    ranked = _accumulate(binned, offsets, "__v", ["__n"], keys)
    before, size = F.col("__n_before"), F.col("__n")

    def at(rank: Column) -> Column:
        return F.max(F.when((before <= rank) & (before + size > rank), F.col("__v")))

    picked = ranked.filter(touches(before, size)).groupBy(*keys).agg(
        F.max("__n_total").alias("__n_total"),
        *[at(F.floor(pos)).alias(f"__lo_{name}") for name, pos in position.items()],
        *[at(F.ceil(pos)).alias(f"__hi_{name}") for name, pos in position.items()],
    )
    return picked.select(
        *keys,
        *[
            (
                F.col(f"__lo_{name}")
                + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * (pos - F.floor(pos))
            ).alias(name)
            for name, pos in position.items()
        ],
    )


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "median", bin_rows: int = BIN_ROWS) -> DataFrame:
    return exact_quantiles(df, value, {name: 0.5}, keys, bin_rows)


def approx_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """One-pass alternative: rank error at most 1/accuracy, state of fixed size per group."""
    sketch = df.groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), list(probs.values()), accuracy).alias("__q")
    )
    return sketch.select(*keys, *[F.col("__q")[i].alias(name) for i, name in enumerate(probs)])


def dense_positions(df: DataFrame, order: str, name: str, descending: bool = False, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Dense rank of ``order`` over the whole table, joined on as column ``name``."""
    key = -F.col(order) if descending else F.col(order)
    keyed = df.withColumn("__o", key)
    distinct = keyed.select("__o").distinct().withColumn("__one", F.lit(1).cast("long"))
    ranks = running_sums(distinct, "__o", ["__one"], bin_rows=bin_rows).select(
        "__o", (F.col("__one_before") + 1).alias(name)
    )
    return join_null_safe(keyed, ranks, ["__o"], "left").drop("__o")
