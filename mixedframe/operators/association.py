"""Association between columns of mixed type.

* number - number: Pearson r;
* number - category: correlation ratio, sqrt(SS between / SS total);
* category - category: Cramer's V without continuity correction.

Null cells are left out pair by pair. A pair in which a column is constant has no
association and gives null. The columns are stored once, and each pair is computed once
and mirrored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

NUMBER, CATEGORY = "number", "category"


def column_kinds(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    """Kind of each column; any type that is neither number nor text is an error."""
    kinds: dict[str, str] = {}
    for name in cols or df.columns:
        kind = df.schema[name].dataType
        if isinstance(kind, T.NumericType):
            kinds[name] = NUMBER
        elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
            kinds[name] = CATEGORY
        else:
            raise TypeError(f"column {name} is {kind.simpleString()}; expected a number or text")
    return kinds


def column_pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    """Every unordered pair of columns, self pairs included."""
    return [(a, b) for i, a in enumerate(cols) for b in cols[i:]]


def _clip(r: Column, lo: float) -> Column:
    # least() and greatest() skip nulls, so a missing r is kept apart
    return F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(lo)))


def _pearson(a: str, b: str) -> Column:
    # built from covariance and variances: corr() itself fails on a constant column in ANSI mode
    x = F.when(F.col(b).isNotNull(), F.col(a).cast("double"))
    y = F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def _number_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(a).alias("col_x"),
            F.lit(b).alias("col_y"),
            F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"),
            _clip(_pearson(a, b), -1.0).alias("r"),
        )
        for a, b in pairs
    ]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def _ratio_pairs(df: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """All number-category pairs from one grouping by (category column, level).

    Level statistics are means and variances, which merge without cancellation.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in numbers], *categories)
    levels = values.unpivot(list(numbers), list(categories), "__cat", "__level")
    per_level = levels.filter(F.col("__level").isNotNull()).groupBy("__cat", "__level").agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("num"),
                    F.count(c).alias("cnt"),
                    F.avg(c).alias("mean"),
                    (F.var_pop(c) * F.count(c)).alias("inner"),
                )
                for c in numbers
            ]
        ).alias("__s")
    )
    # written once, for the grand means and for the sums around them
    parts = stage(per_level.select("__cat", F.inline("__s")).filter(F.col("cnt") > 0), "levels")
    # one row per (category column, number column): bounded by the square of the column count
    whole = parts.groupBy("__cat", "num").agg(
        (F.sum(F.col("mean") * F.col("cnt")) / F.sum("cnt")).alias("grand")
    )
    joined = parts.join(whole, ["__cat", "num"])
    deviation = F.col("mean") - F.col("grand")
    sums = joined.groupBy("__cat", "num").agg(
        F.sum("cnt").alias("n"),
        F.sum(F.col("cnt") * deviation * deviation).alias("between"),
        F.sum("inner").alias("within"),
        F.count("*").alias("__levels"),
    )
    ratio = F.sqrt(F.try_divide("between", F.col("between") + F.col("within")))
    return sums.select(
        F.col("num").alias("col_x"),
        F.col("__cat").alias("col_y"),
        "n",
        F.when(F.col("__levels") > 1, _clip(ratio, 0.0)).alias("r"),
    )


def _category_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """All category pairs from one grouping into contingency cells.

    chi2 / N = sum(n_ij^2 / (n_i n_j)) - 1, so empty cells are never written out.
    """
    entries = [
        F.struct(F.lit(i).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y"))
        for i, (a, b) in enumerate(pairs)
    ]
    cells = (
        df.select(F.inline(F.array(*entries)))
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("pair", "x", "y")
        .agg(F.count("*").alias("n"))
    )
    # written once, for both margins and for the cells themselves
    cells = stage(cells, "cells")
    rows = cells.groupBy("pair", "x").agg(F.sum("n").alias("nx"))
    cols = cells.groupBy("pair", "y").agg(F.sum("n").alias("ny"))
    sizes = rows.groupBy("pair").agg(F.count("*").alias("levels_x"), F.sum("nx").alias("total"))
    widths = cols.groupBy("pair").agg(F.count("*").alias("levels_y"))
    n = F.col("n").cast("double")
    spread = (
        cells.join(rows, ["pair", "x"])
        .join(cols, ["pair", "y"])
        .groupBy("pair")
        .agg(F.sum(n * n / F.col("nx") / F.col("ny")).alias("spread"))
    )
    smaller = F.least("levels_x", "levels_y") - 1
    v = F.sqrt(F.try_divide(F.greatest(F.col("spread") - 1, F.lit(0.0)), smaller))
    names = F.array(*[F.struct(F.lit(a).alias("col_x"), F.lit(b).alias("col_y")) for a, b in pairs])
    return (
        spread.join(sizes, "pair")
        .join(widths, "pair")
        .withColumn("__p", F.element_at(names, F.col("pair") + 1))
        .select(
            "__p.col_x",
            "__p.col_y",
            F.col("total").alias("n"),
            F.when(smaller > 0, _clip(v, 0.0)).alias("r"),
        )
    )


def _category_selves(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """A category with itself: 1 unless it is constant."""
    levels = df.select(*categories).unpivot([], list(categories), "col_x", "__level").filter(F.col("__level").isNotNull())
    counts = levels.groupBy("col_x", "__level").agg(F.count("*").alias("__n"))
    return counts.groupBy("col_x").agg(F.sum("__n").alias("n"), F.count("*").alias("__levels")).select(
        "col_x", F.col("col_x").alias("col_y"), "n", F.when(F.col("__levels") > 1, 1.0).alias("r")
    )


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    return _number_pairs(df, [(a, b)])


def correlation_ratio(df: DataFrame, num: str, cat: str) -> DataFrame:
    return _ratio_pairs(df, [num], [cat])


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    return _category_pairs(df, [(a, b)])


def association_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long symmetric matrix (col_x, col_y, kind, n, r) over all pairs of columns."""
    kinds = column_kinds(df, cols)
    numbers = [c for c, k in kinds.items() if k == NUMBER]
    categories = [c for c, k in kinds.items() if k == CATEGORY]
    # written once: the input may be a join, and every kind of pair reads its columns
    data = stage(df.select(*kinds), "mixed")
    parts = []
    if numbers:
        parts.append(_number_pairs(data, column_pairs(numbers)).withColumn("kind", F.lit("pearson")))
    if numbers and categories:
        parts.append(_ratio_pairs(data, numbers, categories).withColumn("kind", F.lit("correlation_ratio")))
    if categories:
        parts.append(_category_selves(data, categories).withColumn("kind", F.lit("cramers_v")))
        pairs = [(a, b) for a, b in column_pairs(categories) if a != b]
        if pairs:
            parts.append(_category_pairs(data, pairs).withColumn("kind", F.lit("cramers_v")))
    half = parts[0]
    for part in parts[1:]:
        half = half.unionByName(part)
    both = F.when(
        F.col("col_x") == F.col("col_y"), F.array(F.struct("col_x", "col_y"))
    ).otherwise(
        F.array(
            F.struct("col_x", "col_y"), F.struct(F.col("col_y").alias("col_x"), F.col("col_x").alias("col_y"))
        )
    )
    return half.select(F.inline(both), "kind", "n", "r")


def strong_pairs(matrix: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs with absolute association above the threshold, strongest first."""
    return matrix.filter((F.abs("r") > threshold) & (F.col("col_x") < F.col("col_y"))).orderBy(
        F.desc(F.abs("r")), "col_x", "col_y"
    )


def matrix_display(matrix: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The square layout, one row and one column per table column."""
    return matrix.groupBy("col_x").pivot("col_y", list(cols)).agg(F.first("r"))
