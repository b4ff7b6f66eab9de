"""Single trees of fitted ensembles, for what an ensemble's own prediction does not tell.

A fitted forest is written in its public stored form and its nodes are read back as arrays, so
that a task can follow each tree by itself over a whole batch of rows: predictions of every
prefix of the ensemble in one pass, or of each tree on the rows it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, scratch_path
from .features import FEATURES


@dataclass
class StoredTree:
    """Nodes of a tree; ``feature`` is -1 at a leaf, ``category`` the row of ``goes_left`` where a split is by category."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    category: np.ndarray
    goes_left: np.ndarray
    shares: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(self.feature[at] >= 0)
        while len(open_):
            node = at[open_]
            value = x[open_, self.feature[node]]
            low = value <= self.cut[node]
            by = self.category[node]
            named = np.flatnonzero(by >= 0)
            if len(named):
                low[named] = self.goes_left[by[named], value[named].astype(np.int64)]
            at[open_] = np.where(low, self.left[node], self.right[node])
            open_ = open_[self.feature[at[open_]] >= 0]
        return at

    @property
    def used(self) -> set[int]:
        return set(self.feature[self.feature >= 0].tolist())


def _tree(nodes: pd.DataFrame) -> StoredTree:
    nodes = nodes.sort_values("id")
    column = lambda c, kind=np.int64: nodes[c].to_numpy(kind)
    inner, width = column("leftChild") >= 0, column("numCategories")
    by_category = inner & (width >= 0)
    cut = np.array([v[0] if i and w < 0 else 0.0 for v, i, w in zip(nodes["values"], inner, width)])
    goes_left = np.zeros((int(by_category.sum()), max(1, int(width.max()))), bool)
    row = np.where(by_category, np.cumsum(by_category) - 1, -1)
    for r, values in zip(row[by_category], nodes["values"][by_category]):
        goes_left[r, np.asarray(values, int)] = True
    stats = np.stack(nodes["impurityStats"].to_numpy())
    total = stats.sum(axis=1, keepdims=True)
    return StoredTree(np.where(inner, column("featureIndex"), -1), cut, column("leftChild"), column("rightChild"), row, goes_left, stats / np.where(total, total, 1))


def trees_of(spark: SparkSession, model) -> list[StoredTree]:
    """The trees of a fitted classification forest, in their order. The driver holds the model already."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    node = ["id", "leftChild", "rightChild", "impurityStats"]
    split = [F.col("nodeData.split.featureIndex"), F.col("nodeData.split.leftCategoriesOrThreshold").alias("values"), F.col("nodeData.split.numCategories")]
    nodes = spark.read.parquet(f"{path}/data").select("treeID", *[F.col(f"nodeData.{c}") for c in node], *split).toPandas()
    discard(spark, path)
    return [_tree(own) for _, own in nodes.groupby("treeID")]


def cumulative_votes(trees: Sequence[StoredTree], x: np.ndarray, counts: Sequence[int]) -> Iterator[np.ndarray]:
    """Summed class shares of the first n trees, for each n in ascending ``counts``."""
    total, at = np.zeros((len(x), trees[0].shares.shape[1])), 0
    for n in counts:
        for tree in trees[at:n]:
            total += tree.shares[tree.leaves(x)]
        at = n
        yield total


def staged_predictions(model, df: DataFrame, counts: Sequence[int], output: str = "staged") -> DataFrame:
    """``df`` with ``output``: a map from each tree count to the class number those first trees predict.

    Every tree is followed once, whatever the number of counts.
    """
    counts = sorted(set(counts))
    if counts[0] < 1 or counts[-1] > model.getNumTrees:
        raise ValueError(f"counts must be from 1 to {model.getNumTrees}")
    held = df.sparkSession.sparkContext.broadcast(trees_of(df.sparkSession, model))

    @F.pandas_udf("array<int>")
    def predict(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        found = [v.argmax(axis=1) for v in cumulative_votes(held.value, np.stack(x.to_numpy()).astype(float), counts)]
        return pd.Series(list(np.stack(found, axis=1).astype(np.int32)))

    keys = F.array(*[F.lit(n) for n in counts])
    return df.withColumn(output, F.map_from_arrays(keys, predict(vector_to_array(FEATURES))))
