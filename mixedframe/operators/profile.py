"""Profiling tables: counts, shares, summaries, structure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import round_half_even
from .joins import attach_stats, join_null_safe
from .ordered import approx_quantiles, dense_positions, exact_median, exact_quantiles


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def sorted_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Most frequent first; ties in order of the value."""
    return value_counts(df, *cols).orderBy(F.desc("n"), *cols)


def top_k_values(df: DataFrame, col: str, k: int) -> DataFrame:
    return sorted_counts(df, col).limit(k)


def value_shares(df: DataFrame, col: str, digits: int | None = None) -> DataFrame:
    counts = value_counts(df, col)
    share = F.col("n") / counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", share if digits is None else round_half_even(share, digits))


def crosstab_shares(df: DataFrame, row: str, col: str, digits: int | None = 2, levels: Sequence | None = None) -> DataFrame:
    """Two-way table with row-margin shares: (row, col, n, share), each row sums to 1.

    Cells that occur are listed; ``levels`` of the column adds its empty ones. A value
    outside the given levels keeps its cell.
    """
    cells = value_counts(df, row, col)
    margin = cells.groupBy(row).agg(F.sum("n").alias("__total"))
    if levels is not None:
        kind = df.schema[col].dataType
        listed = F.array(*[F.lit(v).cast(kind) for v in levels])
        frame = margin.select(row, F.explode(listed).alias(col)).withColumn("n", F.lit(0).cast("long"))
        cells = cells.unionByName(frame).groupBy(row, col).agg(F.sum("n").alias("n"))
    cells = join_null_safe(cells, margin, [row])
    share = F.col("n") / F.col("__total")
    return cells.select(
        row, col, "n", (share if digits is None else round_half_even(share, digits)).alias("share")
    )


def share(df: DataFrame, pred: Column, name: str = "share") -> DataFrame:
    """Share of all rows that satisfy a condition; an unknown outcome counts as no."""
    return df.agg(F.try_divide(F.count_if(pred), F.count("*")).alias(name))


def group_share(df: DataFrame, keys: Sequence[str], pred: Column, name: str = "share") -> DataFrame:
    return df.groupBy(*keys).agg((F.count_if(pred) / F.count("*")).alias(name))


def missing_profile(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Per column: rows, rows with the column's own missing form, and their share.

    All columns are counted in one pass.
    """
    counts = df.agg(
        F.count("*").alias("n_rows"), *[F.count_if(pred).alias(c) for c, pred in rules.items()]
    )
    long = counts.unpivot("n_rows", list(rules), "column", "n_missing")
    return long.withColumn("share", F.try_divide("n_missing", "n_rows"))


def null_profile(df: DataFrame) -> DataFrame:
    """Null and non-null cells per column, in one pass."""
    counts = df.agg(
        F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    long = counts.unpivot("__n", df.columns, "column", "n_null")
    return long.select("column", "n_null", (F.col("__n") - F.col("n_null")).alias("n_present"))


def _long_numbers(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    numbers = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return numbers.unpivot(list(keys), list(cols), "column", "value")


def numeric_summary(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """min, quartiles, mean and max per column.

    Quartiles are exact (linear interpolation); ``approximate`` takes them from a
    one-pass sketch instead.
    """
    long = _long_numbers(df, cols, keys).filter(F.col("value").isNotNull())
    by = [*keys, "column"]
    plain = long.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
    )
    find = approx_quantiles if approximate else exact_quantiles
    quartiles = find(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    return join_null_safe(plain, quartiles, by).select(
        *by, "n", "min", "q1", "median", "mean", "q3", "max"
    )


def level_summary(df: DataFrame, col: str, max_levels: int = 100, other: str = "(Other)") -> DataFrame:
    """Level counts, most frequent first; beyond ``max_levels`` the rest is one ``other`` row.

    Only the ``max_levels`` leading rows are ever gathered: the remainder is the
    total less what was kept.
    """
    counts = value_counts(df, col)
    whole = counts.agg(F.sum("n").alias("__rows"), F.count("*").alias("__levels"))
    leading = attach_stats(counts.orderBy(F.desc("n"), col).limit(max_levels), whole)
    # at most max_levels rows from here on
    ranked = leading.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), col)))
    kept = ranked.filter(
        (F.col("__levels") <= max_levels) | (F.col("rank") < max_levels)
    )
    rest = kept.agg(
        F.max("__rows").alias("__rows"), F.max("__levels").alias("__levels"), F.sum("n").alias("__kept")
    ).filter(F.col("__levels") > max_levels)
    rest = rest.select(
        F.lit(other).alias(col), (F.col("__rows") - F.col("__kept")).alias("n"), F.lit(max_levels).alias("rank")
    )
    return kept.select(F.col(col).cast("string").alias(col), "n", "rank").unionByName(rest)


def grouped_summary(df: DataFrame, keys: Sequence[str], value: str, pred: Column) -> DataFrame:
    """Per group: rows, rows satisfying a condition, exact median, max and mean."""
    plain = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(pred).alias("n_true"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
    )
    return join_null_safe(plain, exact_median(df, value, keys, "median_value"), keys, "left")


def median_where(df: DataFrame, value: str, pred: Column, name: str = "median") -> DataFrame:
    return exact_median(df.filter(pred), value, (), name)


def share_of_groups(df: DataFrame, keys: Sequence[str], value: str, pred, name: str = "share") -> DataFrame:
    """Share of groups whose median satisfies ``pred(median column)``."""
    medians = exact_median(df, value, keys, "med")
    return share(medians, pred(F.col("med")), name)


def imputation_audit(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Groups whose median was moved by an imputation."""
    columns = {before: "median_before", after: "median_after"}
    long = df.select(key, *[F.col(c).cast("double").alias(name) for c, name in columns.items()]).unpivot(
        [key], list(columns.values()), "which", "value"
    )
    each = exact_median(long, "value", [key, "which"])
    medians = each.groupBy(key).agg(
        *[F.max(F.when(F.col("which") == name, F.col("median"))).alias(name) for name in columns.values()]
    )
    return medians.filter(F.col("median_before") != F.col("median_after"))


def n_distinct(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column as (column, n_distinct); null is not a value."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(*[count(F.col(c)).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "n_distinct")


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    """Rows whose class changed: one row per (from, to), and the total with both null."""
    changed = df.filter(~F.col(before).eqNullSafe(F.col(after)))
    cells = changed.groupBy(before, after).agg(F.count("*").alias("n"))
    total = cells.agg(
        F.lit(None).cast("string").alias(before),
        F.lit(None).cast("string").alias(after),
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"),
    )
    return cells.unionByName(total)


def describe_structure(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: position, type, rows, non-null rows, levels, smallest value.

    Levels are counted exactly, unless ``approximate``: column by column, so that each count
    reads and shuffles one narrow column, and combines before the shuffle.
    """
    atomic = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.count("*").alias("n_rows"),
            F.count(F.col(f.name)).alias("n_present"),
            (F.approx_count_distinct(f.name) if approximate and f.name in atomic else F.lit(None).cast("long")).alias("n_levels"),
            (F.min(F.col(f.name)).cast("string") if f.name in atomic else F.lit(None).cast("string")).alias("example"),
        )
        for i, f in enumerate(df.schema)
    ]
    described = df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    if approximate or not atomic:
        return described
    counts = [df.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count("*").alias("n_levels")).select(F.lit(c).alias("column"), "n_levels") for c in atomic]
    levels = reduce(DataFrame.unionAll, counts)
    return described.drop("n_levels").join(levels, "column", "left").select("position", "column", "type", "n_rows", "n_present", "n_levels", "example")


def column_relation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Is ``a`` a relabelling of ``b``, or does one determine the other?

    Counts the levels of each and of the pair over the distinct pairs, which are
    found once with map-side combining.
    """
    pairs = df.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null").distinct()
    n = pairs.agg(
        F.count_distinct("a").alias("n_a"), F.count_distinct("b").alias("n_b"), F.count("*").alias("n_pairs")
    )
    return n.select(
        F.lit(a).alias("column_a"),
        F.lit(b).alias("column_b"),
        "n_a",
        "n_b",
        "n_pairs",
        (F.col("n_pairs") == F.col("n_a")).alias("a_determines_b"),
        (F.col("n_pairs") == F.col("n_b")).alias("b_determines_a"),
        ((F.col("n_pairs") == F.col("n_a")) & (F.col("n_pairs") == F.col("n_b"))).alias("relabelling"),
    )


def low_variance(df: DataFrame, cols: Sequence[str], rare: int = 100) -> DataFrame:
    """Per column: levels, share of the commonest, rows of the rarest, and the number of rare levels."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    counts = value_counts(text.unpivot([], list(cols), "column", "value"), "column", "value")
    stats = counts.groupBy("column").agg(
        F.count("*").alias("n_levels"),
        (F.max("n") / F.sum("n")).alias("top_share"),
        F.min("n").alias("min_level_n"),
        F.count_if(F.col("n") < rare).alias("n_rare_levels"),
    )
    return stats.withColumn("constant", F.col("n_levels") == 1)


def with_group_size(df: DataFrame, keys: Sequence[str], name: str = "group_n") -> DataFrame:
    """The size of each row's group on the row: counted with map-side combining and joined
    back, so a hot group is never gathered in one task."""
    return attach_stats(df, df.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group.

    Spark limits each group before the shuffle too (``WindowGroupLimit``), so a hot group
    sends at most k rows per task, for k up to ``spark.sql.optimizer.windowGroupLimitThreshold``
    (1000 by default; raise it for a larger k).
    """
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def class_profile(df: DataFrame, cat: str, target: str, focus: str, ordered: bool = True) -> DataFrame:
    """Class mix per category: (category, class, n, category_n, share, focus_share, overall_share).

    ``focus`` is the class the categories are ordered by, highest share first; the
    overall share of that class is repeated on every row as the reference level.
    """
    cells = value_counts(df, cat, target)
    is_focus = F.col(target) == F.lit(focus)
    per_cat = cells.groupBy(cat).agg(
        F.sum("n").alias("category_n"),
        F.sum(F.when(is_focus, F.col("n")).otherwise(0)).alias("__focus_n"),
    )
    overall = per_cat.agg(
        F.sum("__focus_n").alias("__f"), F.sum("category_n").alias("__n")
    ).select(
        F.when(F.col("__f") == 0, F.raise_error(f"class {focus} does not occur in {target}"))
        .otherwise(F.col("__f") / F.col("__n"))
        .alias("overall_share")
    )
    profile = join_null_safe(cells, per_cat, [cat]).select(
        cat,
        target,
        "n",
        "category_n",
        (F.col("n") / F.col("category_n")).alias("share"),
        (F.col("__focus_n") / F.col("category_n")).alias("focus_share"),
    )
    profile = profile.withColumn("overall_share", overall.scalar())
    return profile.orderBy(F.desc("focus_share"), cat, target) if ordered else profile


def ordered_categories(df: DataFrame, cat: str, flag: Column, name: str = "position") -> DataFrame:
    """Categories with the mean of a flag and their dense rank, highest mean first."""
    means = df.groupBy(cat).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("flag_share"))
    return dense_positions(means, "flag_share", name, descending=True)
