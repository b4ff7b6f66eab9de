"""Which columns determine which: every function and every relabelling among many columns.

A set of columns determines another column when no two rows that agree on the set differ in
it. The search goes level by level, sets of one column first, and keeps only minimal sets.
One pass over the table estimates the distinct values of all sets and of all sets with one
column more, by sketches of fixed size: where a set with the column has clearly more values
than the set alone, it is ruled out. What is left is decided exactly, one grouping per set for
all its possible dependents together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: relative standard deviation of a sketch, and how many of them rule a dependency out
DEVIATION, SURE = 0.02, 6.0
#: sketches in one pass
AT_ONCE = 400


def _known(cols: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in cols])


def _sketched(df: DataFrame, sets: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """About how many different values each set of columns has, over rows without a null in it."""
    found = {}
    for at in range(0, len(sets), AT_ONCE):
        some = sets[at : at + AT_ONCE]
        values = [F.approx_count_distinct(F.when(_known(s), F.xxhash64(*s)), DEVIATION).alias(f"s{i}") for i, s in enumerate(some)]
        found.update(zip(some, df.agg(*values).first()))
    return found


def _confirmed(df: DataFrame, determinant: tuple[str, ...], dependents: Sequence[str]) -> list[str]:
    """Those of ``dependents`` that never have two values where the determinant has one."""
    groups = df.where(_known(determinant)).groupBy(*determinant)
    ends = groups.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(dependents)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(dependents)])
    split = ends.agg(*[F.coalesce(F.bool_or(F.col(f"lo{i}") < F.col(f"hi{i}")), F.lit(False)).alias(f"d{i}") for i in range(len(dependents))]).first()
    return [c for c, s in zip(dependents, split) if not s]


def column_dependencies(df: DataFrame, cols: Sequence[str] | None = None, max_size: int = 1) -> DataFrame:
    """(determinant, dependent, size, relabelling) for every minimal set of at most ``max_size`` columns.

    ``determinant`` names the set's columns, joined by commas in the order of ``cols``. Rows
    with a null in the set or the dependent say nothing about the two; a column of one value
    depends on each other column. ``relabelling`` marks single columns that determine each
    other. Columns must be of types that can be ordered.
    """
    cols = list(cols or df.columns)
    determined: dict[tuple[str, ...], set[str]] = {}
    for size in range(1, max_size + 1):
        open_ = {}
        for s in combinations(cols, size):
            known = set().union(*[determined.get(part, set()) for n in range(1, size) for part in combinations(s, n)])
            if any(c in determined.get(tuple(x for x in s if x != c), ()) for c in s):
                continue  # a part of the set determines the rest, so the set is not minimal
            left = [c for c in cols if c not in s and c not in known]
            if left:
                open_[s] = left
        wider = {tuple(c for c in cols if c in (*s, d)) for s, left in open_.items() for d in left}
        counts = _sketched(df, [*open_, *sorted(wider)])
        for s, left in open_.items():
            likely = [d for d in left if counts[tuple(c for c in cols if c in (*s, d))] <= counts[s] * (1 + SURE * DEVIATION)]
            determined[s] = set(_confirmed(df, s, likely)) if likely else set()
    rows = [
        (",".join(s), d, len(s), len(s) == 1 and s[0] in determined.get((d,), ()))
        for s, found in determined.items() for d in cols if d in found
    ]
    return df.sparkSession.createDataFrame(rows, "determinant string, dependent string, size int, relabelling boolean")
