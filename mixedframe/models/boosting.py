"""Softmax boosting: one ensemble for all classes, a tree per class and round.

Features are cut into bins at sketched quantiles and stored, one byte a feature. A level of
all trees of a round is one pass: every task sums the gradients of its rows per (class, node,
feature, bin), the sums are added up in a tree of tasks, and the driver, which holds nothing
but such a histogram and the trees, chooses the splits. Gradients are rounded to 2**-24 and
summed as integers, so the result does not depend on the order of the sums. Rows are sampled
per round by a hash, columns per tree. Margins are written to the shared folder every
``KEEP`` rounds; between, a task adds the trees grown since.

The split gain and leaf values are those of second-order boosting with a ridge of 1: a node
with gradient sum G and curvature sum H is worth G**2 / (H + 1) and its leaf -G / (H + 1).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stage
from .features import FEATURES, INDEX, LABEL, SHARES

BINS = 64
UNIT = float(1 << 24)
RIDGE = 1.0
KEEP = 8
FAN_IN = 32


@dataclass
class Tree:
    """A binary tree in heap order; a node without a feature (-1) is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n), np.zeros(n))

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node each row ends in; ``x`` has features, or their bins where ``cut`` has bins."""
        at = np.zeros(len(x), np.int64)
        for _ in range(len(self.feature).bit_length() - 1):
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            own = at[inner]
            at[inner] = 2 * own + 1 + (x[inner, f[inner]] > self.cut[own])
        return at


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss, in whole units."""
    p = softmax(margins)
    g = p.copy()
    g[np.arange(len(p)), label] -= 1
    return np.rint(g * UNIT).astype(np.int64), np.rint(np.maximum(2 * p * (1 - p), 1e-16) * UNIT).astype(np.int64)


def sampled(row: np.ndarray, round_: int, seed: int, share: float) -> np.ndarray:
    """Which rows a round learns from, by a hash of row, round and seed."""
    if share >= 1:
        return np.ones(len(row), bool)
    with np.errstate(over="ignore"):
        x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((round_ * 0x1F123BB5 + seed * 0x5851F42D + 1) % (1 << 63))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)).astype(np.float64) < share * (1 << 24)


def level_histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray, trees: Sequence[Tree], level: int, n_bins: int) -> np.ndarray:
    """Sums per (class, node of the level, feature, bin) of both derivatives."""
    first, width = (1 << level) - 1, 1 << level
    d = bins.shape[1]
    out = np.zeros((len(trees), width, d, n_bins, 2), np.int64)
    for k, tree in enumerate(trees):
        node = tree.nodes(bins) - first
        here = np.flatnonzero(node >= 0)
        if not len(here):
            continue
        base = node[here] * n_bins
        for j in range(d):
            slot = base + bins[here, j]
            for part, source in enumerate((g, h)):
                # whole units below 2**53 in a batch, so the sums of doubles are exact
                out[k, :, j, :, part] = np.bincount(slot, source[here, k], width * n_bins).reshape(width, n_bins).astype(np.int64)
    return out


def grow_level(tree: Tree, sums: np.ndarray, level: int, columns: np.ndarray, eta: float, gamma: float, least: float) -> None:
    """Split the nodes of a level where it gains, by their sums (node, feature, bin, derivative); ``cut`` gets bins."""
    first = (1 << level) - 1
    sums = sums.astype(np.float64) / UNIT
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + RIDGE)
    for i in range(len(sums)):
        total = sums[i, 0].sum(axis=0)
        if first + i and not tree.value[first + i]:
            continue
        left = np.cumsum(sums[i][columns], axis=1)[:, :-1]
        right = total - left
        gain = worth(left) + worth(right) - worth(total)
        gain[(left[..., 1] < least) | (right[..., 1] < least)] = -np.inf
        best = int(gain.argmax()) if gain.size else -1
        if best < 0 or gain.flat[best] <= max(gamma, 1e-6):
            continue
        j, b = np.unravel_index(best, gain.shape)
        node = first + i
        tree.feature[node], tree.cut[node] = columns[j], b
        for child, s in ((2 * node + 1, left[j, b]), (2 * node + 2, right[j, b])):
            tree.value[child] = -s[0] / (s[1] + RIDGE) * eta


def add_trees(margins: np.ndarray, x: np.ndarray, rounds: Sequence[Sequence[Tree]]) -> np.ndarray:
    for trees in rounds:
        for k, tree in enumerate(trees):
            margins[:, k] += tree.value[tree.nodes(x)]
    return margins


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _margins(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.array(batch.column("margins").flatten().to_numpy(zero_copy_only=False)).reshape(-1, n)


def _tree_sum(partial: DataFrame, parts: int) -> np.ndarray:
    """Sum of the arrays that tasks emit as (part, data), each task of a level adding up ``FAN_IN``."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["data"].to_pylist())
        return pa.table({"part": table["group"].slice(0, 1).cast(pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    while parts > FAN_IN:
        grouped = partial.select(F.floor(F.col("part") / FAN_IN).cast("int").alias("group"), "data")
        partial, parts = grouped.groupBy("group").applyInArrow(add, "part int, data binary"), -(-parts // FAN_IN)
    return sum(np.frombuffer(r.data, np.int64) for r in partial.collect())


class SoftmaxBooster(Estimator):
    """Boosted trees for any number of classes, trained on the multi-class log loss."""

    def __init__(self, nrounds: int = 250, max_depth: int = 5, eta: float = 0.4, gamma: float = 0.0, colsample: float = 0.8,
                 min_child_weight: float = 1.0, subsample: float = 0.75, seed: int = 1, bins: int = BINS):
        super().__init__()
        if not 2 <= bins <= 256:
            raise ValueError("2 to 256 bins")
        self.nrounds, self.max_depth, self.eta, self.gamma, self.colsample = nrounds, max_depth, eta, gamma, colsample
        self.min_child_weight, self.subsample, self.seed, self.bins = min_child_weight, subsample, seed, bins

    def _cuts(self, rows: DataFrame, d: int) -> list[np.ndarray]:
        """Upper ends of the bins of each feature but the last."""
        wanted = [i / self.bins for i in range(1, self.bins)]
        found = rows.agg(*[F.percentile_approx(F.col("x")[j], wanted, 10_000).alias(f"f{j}") for j in range(d)]).first()
        return [np.unique(np.array(found[j], float)) for j in range(d)]

    def _stored(self, rows: DataFrame, cuts: list[np.ndarray], classes: int) -> DataFrame:
        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("x").flatten().to_numpy().reshape(-1, len(cuts))
                found = np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]).astype(np.uint8)
                data = pa.array([r.tobytes() for r in found], pa.binary())
                zero = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * classes, pa.int32()), pa.array(np.zeros(len(x) * classes)))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("label"), data, zero], ["row", "label", "bins", "margins"])

        return stage(rows.mapInArrow(binned, "row long, label int, bins binary, margins array<double>"), "binned")

    def _fit(self, dataset: DataFrame) -> SoftmaxBoosterModel:
        rows = dataset.select(F.col(LABEL).cast("int").alias("label"), vector_to_array(FEATURES).alias("x"))
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "boosting")
        d, classes = rows.agg(F.max(F.size("x")), F.max("label") + 1).first()
        if d is None:
            raise ValueError("no rows to learn from")
        cuts = self._cuts(rows, d)
        table = self._stored(rows, cuts, classes)
        discard(dataset.sparkSession, rows)
        parts = table.rdd.getNumPartitions()
        rng = np.random.default_rng(self.seed)
        n_columns = max(1, round(self.colsample * d))
        done: list[list[Tree]] = []
        losses, since = [], 0
        for round_ in range(self.nrounds):
            columns = [np.sort(rng.choice(d, n_columns, replace=False)) for _ in range(classes)]
            trees = [Tree.empty(self.max_depth) for _ in range(classes)]
            for level in range(self.max_depth):
                sums, loss, n = self._pass(table, parts, done[since:], trees, level, round_, d, classes)
                if not level:
                    losses.append(float(loss / max(n, 1)))
                for k in range(classes):
                    grow_level(trees[k], sums[k], level, columns[k], self.eta, self.gamma, self.min_child_weight)
            done.append(trees)
            if len(done) - since == KEEP and len(done) < self.nrounds:
                old, table, since = table, self._advanced(table, done[since:], d, classes), len(done)
                discard(dataset.sparkSession, old)
                parts = table.rdd.getNumPartitions()
        discard(dataset.sparkSession, table)
        real = [[Tree(t.feature, _real_cuts(t, cuts), t.value) for t in trees] for trees in done]
        return SoftmaxBoosterModel(real, d, losses)

    def _pass(self, table: DataFrame, parts: int, since: list, trees: list[Tree], level: int, round_: int, d: int, classes: int):
        """Histogram of a level over the sampled rows, summed log loss (before the round) and number of all rows."""
        n_bins, shape = self.bins, (classes, 1 << level, d, self.bins, 2)
        share, seed = self.subsample, self.seed

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss, n = np.zeros(shape, np.int64), 0, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, label = _matrix(batch.column("bins"), d), batch.column("label").to_numpy()
                margins = add_trees(_margins(batch, classes), bins, since)
                if not level:
                    loss += int(np.rint(-np.log(np.maximum(softmax(margins)[np.arange(len(label)), label], 1e-300)) * UNIT).sum())
                n += len(label)
                use = sampled(batch.column("row").to_numpy(), round_, seed, share)
                g, h = gradients(margins[use], label[use])
                total += level_histogram(bins[use], g, h, trees, level, n_bins)
            data = np.concatenate([total.ravel(), [loss, n]]).astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])

        columns = ["row", "label", "bins", "margins"]
        summed = _tree_sum(table.select(*columns).mapInArrow(partial, "part int, data binary"), parts)
        return summed[:-2].reshape(shape), summed[-2] / UNIT, int(summed[-1])

    def _advanced(self, table: DataFrame, since: list, d: int, classes: int) -> DataFrame:
        """The table with the trees grown since added to its margins."""

        def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = add_trees(_margins(batch, classes), _matrix(batch.column("bins"), d), since)
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(margins) + 1) * classes, pa.int32()), pa.array(margins.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "label", "bins")), column], ["row", "label", "bins", "margins"])

        return stage(table.select("row", "label", "bins", "margins").mapInArrow(advance, table.schema), "margins")


def _real_cuts(tree: Tree, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(tree.cut))
    for i in np.flatnonzero(tree.feature >= 0):
        out[i] = cuts[tree.feature[i]][int(tree.cut[i])]
    return out


class SoftmaxBoosterModel(Model, MLWritable, MLReadable):
    """Fitted trees (round by round, one per class); ``losses`` is the training log loss before each round."""

    def __init__(self, rounds: list[list[Tree]], n_features: int, losses: list[float] = ()):
        super().__init__()
        self.rounds, self.n_features, self.losses = rounds, n_features, list(losses)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Share of the splits at each feature, weighted by the depth at which they stand."""
        total = np.zeros(self.n_features)
        for trees in self.rounds:
            for tree in trees:
                inner = np.flatnonzero(tree.feature >= 0)
                np.add.at(total, tree.feature[inner], 1.0 / (inner + 1))
        return DenseVector(total / total.sum() if total.sum() else total)

    def first(self, nrounds: int) -> SoftmaxBoosterModel:
        """The model as it was after ``nrounds`` rounds."""
        return SoftmaxBoosterModel(self.rounds[:nrounds], self.n_features, self.losses[:nrounds])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = dataset.sparkSession.sparkContext.broadcast(self.rounds)
        classes = len(self.rounds[0]) if self.rounds else 1

        @F.pandas_udf("array<double>")
        def shares(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            values = np.stack(x.to_numpy()).astype(float)
            return pd.Series(list(softmax(add_trees(np.zeros((len(values), classes)), values, held.value))))

        scored = dataset.withColumn(SHARES, array_to_vector(shares(vector_to_array(FEATURES))))
        p = vector_to_array(SHARES)
        return scored.withColumn(INDEX, (F.array_position(p, F.array_max(p)) - 1).cast("double"))

    def table(self, spark) -> DataFrame:
        """The trees as rows (round, class, node, feature, cut, value)."""
        rows = [
            (r, k, i, int(t.feature[i]), float(t.cut[i]), float(t.value[i]))
            for r, trees in enumerate(self.rounds) for k, t in enumerate(trees) for i in range(len(t.feature))
        ]
        return spark.createDataFrame(rows, "round int, class int, node int, feature int, cut double, value double")

    def write(self) -> MLWriter:
        return _BoosterWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BoosterReader()


class _BoosterWriter(MLWriter):
    def __init__(self, model: SoftmaxBoosterModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        more = {"n_features": self.model.n_features, "losses": self.model.losses}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=more)
        self.model.table(self.sparkSession).coalesce(1).write.parquet(f"{path}/trees")


class _BoosterReader(MLReader):
    def load(self, path: str) -> SoftmaxBoosterModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        frame = self.sparkSession.read.parquet(f"{path}/trees").toPandas().sort_values(["round", "class", "node"])
        rounds: list[list[Tree]] = []
        for (r, _), own in frame.groupby(["round", "class"]):
            if r == len(rounds):
                rounds.append([])
            rounds[r].append(Tree(own["feature"].to_numpy(np.int32), own["cut"].to_numpy(float), own["value"].to_numpy(float)))
        model = SoftmaxBoosterModel(rounds, meta["n_features"], meta["losses"])
        model._resetUid(meta["uid"])
        return model
