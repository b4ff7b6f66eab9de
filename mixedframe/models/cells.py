"""Rows that a forest cannot tell apart, counted: the table as its histograms see it.

A forest compares a number with the middles between at most ``maxBins`` values. Here these
values are quantiles of all rows (or all values, if they are few), and each number moves to the
nearest of them, which leaves it on its side of every middle; so the fitted forest applies to
the numbers as they are. Equal rows are then counted, in one pass that all folds and settings
share; where the draws of the trees are known, as in a bagged forest, these are summed instead,
and what a fit reads follows the number of cells.

The bootstrap of a built-in forest draws single rows, whatever their number: a cell of n rows
is laid out as n rows for it, so such a fit reads as many as there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stage
from .features import FEATURES, LABEL

#: rows of a cell that go to one task together
BLOCK_ROWS = 10_000


def moved_to(value: Column, cuts: Sequence[float], targets: Sequence[float]) -> Column:
    """The target of the interval that holds the value; an interval ends with its cut."""
    if not len(cuts):
        return F.lit(float(targets[0]))
    mid = len(cuts) // 2
    return F.when(value <= float(cuts[mid]), moved_to(value, cuts[:mid], targets[: mid + 1])).otherwise(
        moved_to(value, cuts[mid + 1 :], targets[mid + 1 :])
    )


def counts_rows(estimator: Estimator) -> bool:
    """Whether a fit on cells is the fit on rows: a forest that weighs all rows alike."""
    return isinstance(estimator, RandomForestClassifier) and not estimator.isSet("weightCol") and estimator.getSubsamplingRate() == 1.0


class RowCells:
    """The cells of ``vectors`` (label, feature vector and the columns ``by``), each with the sums of ``weights`` or its rows."""

    def __init__(self, vectors: DataFrame, bins: int, by: Sequence[str] = (), weights: Sequence[Column] = ()):
        self.meta = vectors.schema[FEATURES].metadata.get("ml_attr", {})
        rows = vectors.withColumn("__x", vector_to_array(FEATURES))
        self.d = self.meta.get("num_attrs") or len(rows.select("__x").first()[0])
        named = {a["idx"] for kind in ("nominal", "binary") for a in self.meta.get("attrs", {}).get(kind, [])}
        self.columns = [f"__c{j}" for j in range(self.d)]
        self.weights = [f"__w{t}" for t in range(len(weights))] or ["__w0"]
        rows = rows.select(*by, LABEL, *[F.col("__x")[j].alias(c) for j, c in enumerate(self.columns)], *[w.alias(n) for w, n in zip(weights, self.weights)])
        values = self._values(rows, [c for j, c in enumerate(self.columns) if j not in named], bins)
        moved = {c: moved_to(F.col(c), (v[:-1] + v[1:]) / 2, v) for c, v in values.items()}
        sums = [F.sum(n).cast("double").alias(n) for n in self.weights] if weights else [F.count("*").cast("double").alias("__w0")]
        cells = rows.withColumns(moved).groupBy(*by, LABEL, *self.columns).agg(*sums)
        self.parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.table = stage(cells, "cells")

    def _values(self, rows: DataFrame, columns: Sequence[str], bins: int) -> dict[str, np.ndarray]:
        if not columns:
            return {}
        wanted = [(i + 0.5) / bins for i in range(bins)]
        found = rows.agg(
            *[F.approx_count_distinct(c).alias(f"{c}n") for c in columns],
            *[F.percentile_approx(c, wanted, 10_000).alias(f"{c}q") for c in columns],
        ).first()
        few = [c for c in columns if found[f"{c}n"] <= 2 * bins]
        sets = rows.agg(*[F.collect_set(c).alias(c) for c in few]).first() if few else {}
        each = {c: np.unique(np.array(found[f"{c}q"] or [0.0], float)) for c in columns}
        return each | {c: np.unique(np.array(sets[c], float)) for c in few if 0 < len(sets[c]) <= bins}

    def rows(self, where: Column | None = None, features: Sequence[int] | None = None, weight: str = "__w0") -> DataFrame:
        """(label, feature vector, __weight), the vector with the listed places or all."""
        cells = self.table if where is None else self.table.where(where)
        placed = self._placed(cells.where(F.col(weight) > 0))
        return placed.select(LABEL, self._vector(features), F.col(weight).alias("__weight"))

    def each_row(self, where: Column | None = None, features: Sequence[int] | None = None) -> DataFrame:
        """(label, feature vector) of every row counted; a cell of many rows is dealt to tasks in blocks."""
        cells, n = self.table if where is None else self.table.where(where), F.col("__w0").cast("long")
        blocks = cells.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / BLOCK_ROWS))))
        blocks = blocks.withColumn("__n", F.least(n - F.col("__at") * BLOCK_ROWS, F.lit(BLOCK_ROWS)).cast("int"))
        # a null adds nothing to the hash: the first block stays where its cell belongs
        placed = self._placed(blocks.withColumn("__at", F.nullif("__at", F.lit(0))), "__at")
        rows = placed.select(LABEL, self._vector(features), "__n")
        return rows.select(LABEL, FEATURES, F.explode(F.array_repeat(F.lit(0), F.col("__n")))).select(LABEL, FEATURES)

    def _placed(self, cells: DataFrame, *by: str) -> DataFrame:
        by = (LABEL, *self.columns, *by)
        return cells.repartition(self.parts, *by).sortWithinPartitions(*by)

    def _vector(self, features: Sequence[int] | None) -> Column:
        picked = list(range(self.d)) if features is None else list(features)
        attrs = {
            kind: [{**a, "idx": picked.index(a["idx"])} for a in own if a["idx"] in picked] for kind, own in self.meta.get("attrs", {}).items()
        }
        meta = {"ml_attr": {"attrs": {kind: own for kind, own in attrs.items() if own}, "num_attrs": len(picked)}} if self.meta.get("attrs") else {}
        return array_to_vector(F.array(*[F.col(self.columns[j]) for j in picked])).alias(FEATURES, metadata=meta)

    def fit(self, forest: RandomForestClassifier, where: Column | None = None, features: Sequence[int] | None = None):
        """The forest fitted on the rows of the cells."""
        return forest.fit(self.each_row(where, features))

    def discard(self) -> None:
        discard(self.table.sparkSession, self.table)


def fit_rows(estimator: Estimator, vectors: DataFrame):
    """The estimator fitted on stored vectors, by way of their cells where that is the same."""
    if not counts_rows(estimator):
        return estimator.fit(vectors)
    cells = RowCells(vectors, estimator.getMaxBins())
    model = cells.fit(estimator)
    cells.discard()
    return model
