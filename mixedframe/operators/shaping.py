"""Column and row shaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The named columns, in the order listed."""
    return df.select(*cols)


def drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def derive(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns in one projection."""
    return df.withColumns(dict(exprs))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def move_first(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols, *[c for c in df.columns if c not in set(cols)])


def first_n(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first n rows in a stated order (a distributed table has no row position)."""
    return df.orderBy(*order).limit(n)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def stack_named(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), name: str = "name", value: str = "value") -> DataFrame:
    """Named columns to a long (name, value) table."""
    return df.unpivot(list(ids), list(cols), name, value)


def scalar(df: DataFrame, expr: Column) -> Column:
    """An aggregate of ``df`` as a value usable in another table's expressions."""
    return df.agg(expr.alias("v")).scalar()


def as_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Treat the named columns as categories."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})
