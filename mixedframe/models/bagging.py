"""Forest whose bootstrap is known, so that every tree can be judged on the rows it has not seen.

How often a tree draws a row is a Poisson count from a hash of row, tree and seed: any task can
say it again, nothing is stored. A tree is fitted on the drawn rows, weighted by their counts,
which are summed for rows that it cannot tell apart, ``TOGETHER`` trees in one pass;
the rows it has not drawn, a third of all, are out of its bag.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .cells import RowCells
from .features import FEATURES, LABEL
from .scoring import permuted
from .trees import StoredTree, trees_of

TOGETHER = 16
_CDF = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13)]


def times_drawn(key: str, tree: Column | int, seed: int = 1) -> Column:
    """How often a tree's bootstrap holds the row, a Poisson count with mean 1."""
    tree = tree if isinstance(tree, Column) else F.lit(tree)
    u = F.pmod(F.xxhash64(F.lit(f"bag-{seed}"), tree, F.col(key)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    # the variable of a lambda is worked out once, whatever number of comparisons share it
    return F.transform(F.array(u), lambda v: sum((v >= float(below)).cast("int") for below in _CDF))[0]


@dataclass
class BaggedForest:
    """Single trees, the key their bags follow from, and the seed."""

    trees: list[StoredTree]
    key: str
    seed: int

    @classmethod
    def fit(cls, vectors: DataFrame, key: str, ntree: int = 201, mtry: int = 3, max_depth: int = 20, seed: int = 1,
            max_bins: int = 32, parallelism: int = 4) -> BaggedForest:
        """``vectors`` has the key, the label index and the feature vector, and should be stored: each tree reads it."""
        spark = vectors.sparkSession

        def grow(t: int, cells: RowCells, weight: str) -> StoredTree:
            single = RandomForestClassifier(
                labelCol=LABEL, featuresCol=FEATURES, weightCol="__weight", numTrees=1, bootstrap=False, subsamplingRate=1.0,
                featureSubsetStrategy=str(mtry), maxDepth=max_depth, maxBins=max_bins, seed=seed + t,
            )
            return trees_of(spark, single.fit(cells.rows(weight=weight)))[0]

        trees: list[StoredTree] = []
        for first in range(0, ntree, TOGETHER):
            numbers = range(first, min(ntree, first + TOGETHER))
            cells = RowCells(vectors, max_bins, weights=[times_drawn(key, t, seed) for t in numbers])
            with ThreadPool(parallelism) as pool:
                trees += pool.starmap(grow, [(t, cells, w) for t, w in zip(numbers, cells.weights)])
            cells.discard()
        return cls(trees, key, seed)

    def _with_bags(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bags", F.transform(F.sequence(F.lit(0), F.lit(len(self.trees) - 1)), lambda t: times_drawn(self.key, t, self.seed) > 0))

    def out_of_bag(self, vectors: DataFrame) -> DataFrame:
        """(key, label, prediction): the class number that the trees which have not seen the row vote for, null without one."""
        held = vectors.sparkSession.sparkContext.broadcast(self.trees)
        rows = self._with_bags(vectors.select(F.col(self.key).alias("key"), F.col(LABEL).alias("label"), vector_to_array(FEATURES).alias("x"), F.col(self.key)))
        kind = rows.schema["key"].dataType.simpleString()

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, bags = _matrix(batch, "x", float), _matrix(batch, "bags", bool)
                votes = np.zeros((len(x), held.value[0].shares.shape[1]))
                for t, tree in enumerate(held.value):
                    out = np.flatnonzero(~bags[:, t])
                    votes[out] += tree.shares[tree.leaves(x[out])]
                found = pa.array(votes.argmax(axis=1).astype(float), mask=~votes.any(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), found], ["key", "label", "prediction"])

        return rows.select("key", "label", "x", "bags").mapInArrow(vote, f"key {kind}, label double, prediction double")

    def importance(self, vectors: DataFrame, slots: Sequence[Sequence[int]], names: Sequence[str]) -> DataFrame:
        """(feature, accuracy_drop, sd): mean over the trees of the accuracy a tree loses on its out-of-bag rows
        when a feature takes the values of other rows, and the deviation between trees.

        ``slots`` are the places of each feature in the vector; they move together. All trees
        and features are scored in one pass over the rows.
        """
        held = vectors.sparkSession.sparkContext.broadcast(self.trees)
        places = [list(s) for s in slots]
        rows = vectors.select(self.key, F.col(LABEL).alias("label"), vector_to_array(FEATURES).alias("x"))
        rows = self._with_bags(permuted(rows, self.key, ["x"], str(self.seed))).select("label", "x", "x__moved", "bags")

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = held.value
            n, lost = np.zeros(len(trees), np.int64), np.zeros((len(trees), len(places)), np.int64)
            for batch in batches:
                x, moved, bags = _matrix(batch, "x", float), _matrix(batch, "x__moved", float), _matrix(batch, "bags", bool)
                label = batch.column("label").to_numpy().astype(int)
                for t, tree in enumerate(trees):
                    out = np.flatnonzero(~bags[:, t])
                    own, y, used = x[out], label[out], tree.used
                    n[t] += len(out)
                    right = tree.shares[tree.leaves(own)].argmax(axis=1) == y
                    for j, at in enumerate(places):
                        if used.isdisjoint(at):
                            continue
                        changed = own.copy()
                        changed[:, at] = moved[np.ix_(out, at)]
                        lost[t, j] += int(right.sum()) - int((tree.shares[tree.leaves(changed)].argmax(axis=1) == y).sum())
            t, j = np.indices(lost.shape).reshape(2, -1)
            columns = [pa.array(t, pa.int32()), pa.array(j, pa.int32()), pa.array(np.repeat(n, len(places))), pa.array(lost.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "at", "n", "lost"])

        each = rows.mapInArrow(judge, "tree int, at int, n long, lost long").groupBy("tree", "at").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))
        drop = F.coalesce(F.try_divide("lost", "n"), F.lit(0.0))
        named = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("at") + 1)
        return each.select(named.alias("feature"), drop.alias("drop")).groupBy("feature").agg(F.avg("drop").alias("accuracy_drop"), F.coalesce(F.stddev_samp("drop"), F.lit(0.0)).alias("sd"))


def _matrix(batch: pa.RecordBatch, column: str, kind) -> np.ndarray:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), kind)


def bagged_vectors(prepared: DataFrame, key: str) -> DataFrame:
    """The columns a bagged forest reads, stored once."""
    return stage(prepared.select(key, LABEL, FEATURES), "vectors")
