"""Exact k-nearest-neighbour join on Euclidean distance.

The join never forms all pairs. Following the published Voronoi scheme for kNN
joins on a shuffle engine (Lu et al., "Efficient Processing of k Nearest Neighbor
Joins using MapReduce", PVLDB 2012):

1. about sqrt(n) of n reference rows become pivots; every reference row belongs
   to the cell of its nearest pivot;
2. per cell the row count and the distance range to the pivot are kept on the driver,
   at most ``MAX_PIVOTS`` rows;
3. a query first searches its home cells, the nearest ones that hold twice as many rows as
   it wants, and so has a real k-th distance;
4. the triangle inequality then rules out every other cell that is too far for that
   distance, and only the remaining ones are searched;
5. where a bounded sample of queries shows that few cells are ruled out, as with vectors of
   many dimensions, neighbouring cells are searched as one group, so that a query is not
   copied to every cell.

Inside a block a matrix product, exact up to a known rounding error, picks the pairs that may
be among the nearest; only their distances are summed feature by feature.

Skew: equal query vectors are searched once; of equal reference vectors only the
first few keys can be neighbours, and the rest are dropped before the shuffle;
cells with many rows are cut into blocks of bounded size on both sides, so no
task ever holds a whole hot cell. Results are exact whatever the data look like;
only the number of visited cells varies.

A row without a complete vector is no reference; as a query it keeps one row
without a neighbour.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import key_hash
from ..session import stage

# the task functions below travel inside the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# pivots for some four thousand million references; beyond, cells hold more rows and have more blocks
MAX_PIVOTS = 65_536
BLOCK_REFS = 32_768
BLOCK_QUERIES = 32_768
# block pairs are heavy on processor time: up to so many tasks per shuffle partition
TASKS_PER_PARTITION = 4
PAIRS_PER_TASK = 2
# references compared at once in a block, and entries of a matrix of bounds held at once
STEP_REFS = 2048
ENTRIES = 250_000
# queries that show how many cells a query visits, and the groups made where that is all of them
SAMPLE = 512
GROUPS = 8
# visits are handed on in pieces of so many rows, since each repeats its vector
VISIT_ROWS = 16_384
# slack on the pruning bounds, relative to the distances involved and far above rounding error
SLACK = 1e-12


def _vector(features: Sequence[str] | str) -> Column:
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def _whole(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def _points(vectors: pa.Array) -> np.ndarray:
    """A column of vectors, all of one length, as a matrix."""
    lengths = pc.min_max(pc.list_value_length(vectors)).as_py() if len(vectors) else {"min": 0, "max": 0}
    if lengths["min"] != lengths["max"]:
        raise ValueError("vectors of different lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), lengths["min"])


def distances(queries: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed feature by feature in order."""
    total = np.zeros((len(queries), len(refs)))
    for j in range(queries.shape[1]):
        gap = queries[:, j, None] - refs[None, :, j]
        total += gap * gap
    return np.sqrt(total)


def _exact(queries: np.ndarray, refs: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """``distances`` of single pairs."""
    total = np.zeros(len(row))
    for j in range(queries.shape[1]):
        gap = queries[row, j] - refs[col, j]
        total += gap * gap
    return np.sqrt(total)


def nearest(queries: np.ndarray, refs: np.ndarray, k: int, chunk: int = 1024, apart: tuple | None = None,
            bounds: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, reference row, distance) of the k nearest; ties keep the earlier reference.

    ``apart`` has a group for each query and for each reference; equal groups are no neighbours.
    ``bounds`` has the largest distance wanted for each query.
    """
    used = np.flatnonzero(np.isfinite(refs).all(axis=1))
    refs, width = refs[used], queries.shape[1]
    if not len(refs):
        return
    codes = None
    if apart is not None:
        both = pd.factorize(np.concatenate([apart[0], apart[1]]))[0]
        codes = both[: len(queries)], both[len(queries) :][used]
    k = min(k, len(refs))
    centre = refs.mean(axis=0)
    moved = refs - centre
    square = (moved * moved).sum(axis=1)
    right = np.ascontiguousarray(np.column_stack([moved, square]).T)
    # of a squared distance: many times what rounding can do to it, here or in the sum feature by feature
    rounding = 16 * (width + 8) * np.finfo(float).eps
    for start in range(0, len(queries), chunk):
        q = queries[start : start + chunk]
        own = q - centre
        size = (own * own).sum(axis=1)
        left = np.column_stack([-2 * own, np.ones(len(q))])
        slack = rounding * (size + square.max())
        kth = np.full(len(q), np.inf) if bounds is None else bounds[start : start + chunk]
        wanted = kth.copy()
        row, col, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(refs), STEP_REFS):
            part = slice(at, at + STEP_REFS)
            # a row with an infinite component is compared feature by feature, and is no neighbour
            with np.errstate(invalid="ignore", over="ignore"):
                gaps = left @ right[:, part]
                limit = kth * kth * (1 + rounding) + slack - size
                if codes is not None:
                    gaps[codes[0][start : start + chunk, None] == codes[1][part]] = np.inf
                if not at and gaps.shape[1] >= k:
                    limit = np.fmin(limit, np.partition(gaps, k - 1, axis=1)[:, k - 1] + 2 * slack)
                new_row, new_col = np.nonzero(~(gaps > limit[:, None]))
                new_dist = _exact(q, refs, new_row, new_col + at)
            good = (new_dist <= wanted[new_row]) & np.isfinite(new_dist)
            if codes is not None:
                good &= codes[0][start + new_row] != codes[1][new_col + at]
            if not good.any():
                continue
            row, col, dist = (np.concatenate(p) for p in ((row, new_row[good]), (col, new_col[good] + at), (dist, new_dist[good])))
            order = np.lexsort((col, dist, row))
            row, col, dist = row[order], col[order], dist[order]
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row]
            taken = place < k
            row, col, dist, place = row[taken], col[taken], dist[taken], place[taken]
            last = place == k - 1
            kth = wanted.copy()
            kth[row[last]] = dist[last]
        yield row + start, used[col], dist


def _in_order(points: np.ndarray) -> np.ndarray:
    """The rows in an order that keeps near ones together: halves along the widest feature, again and again."""
    parts = [np.arange(len(points))]
    while max(map(len, parts), default=0) > 1:
        halves = []
        for p in parts:
            if len(p) > 1:
                own = points[p]
                p = p[np.argsort(own[:, np.ptp(own, axis=0).argmax()], kind="stable")]
            halves += [h for h in (p[: len(p) // 2], p[len(p) // 2 :]) if len(h)]
        parts = halves
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@dataclass
class Cells:
    """Bounded description of the reference table: pivots and per-cell statistics."""

    pivots: np.ndarray
    rows: np.ndarray
    nearest_row: np.ndarray
    furthest_row: np.ndarray

    def _chunk(self) -> int:
        return max(1, ENTRIES // max(1, len(self.pivots)))

    def locate(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, near = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        for start in range(0, len(vectors), self._chunk()):
            d = distances(vectors[start : start + self._chunk()], self.pivots)
            own = d.argmin(axis=1)
            cell[start : start + len(d)], near[start : start + len(d)] = own, d[np.arange(len(d)), own]
        return cell, near

    def _home(self, d: np.ndarray, wanted: int) -> np.ndarray:
        """Which cells are searched first: the nearest ones up to twice the wanted rows."""
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        first = (held - self.rows[order]) < 2 * wanted
        home = np.zeros(d.shape, bool)
        np.put_along_axis(home, order, first, axis=1)
        return home & (self.rows > 0)

    def home(self, vectors: np.ndarray, wanted: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query row, cell) of the home cells."""
        for start in range(0, len(vectors) if len(self.pivots) else 0, self._chunk()):
            row, cell = np.nonzero(self._home(distances(vectors[start : start + self._chunk()], self.pivots), wanted))
            yield row + start, cell

    def others(self, vectors: np.ndarray, bound: np.ndarray, wanted: int, groups: np.ndarray | None = None
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query row, cell) of every other cell that may hold a row within ``bound``.

        With ``groups``, the group of each cell: (query row, group) of every group with such a cell or a home cell.
        """
        if groups is not None and len(groups):
            line = np.argsort(groups, kind="stable")
            names, starts = np.unique(groups[line], return_index=True)
        for start in range(0, len(vectors) if len(self.pivots) else 0, self._chunk()):
            d = distances(vectors[start : start + self._chunk()], self.pivots)
            closest = np.maximum(np.maximum(d - self.furthest_row, self.nearest_row - d), 0.0)
            # a cell's rows are nearer to its own pivot: hyperplane bound against the query's nearest pivot
            home = d.argmin(axis=1)
            gap = distances(self.pivots[home], self.pivots)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d**2 - d[np.arange(len(d)), home, None] ** 2) / (2 * gap) - SLACK * d**2 / gap
            closest = np.maximum(closest, np.where(gap > 0, plane, 0.0))
            own = bound[start : start + len(d), None]
            limit = own + SLACK * (np.where(np.isfinite(own), own, 0.0) + d + self.furthest_row)
            may = (closest <= limit) & (self.rows > 0)
            if groups is None:
                row, cell = np.nonzero(may & ~self._home(d, wanted))
            else:
                row, cell = np.nonzero(np.logical_or.reduceat((may | self._home(d, wanted))[:, line], starts, axis=1))
                cell = names[cell]
            yield row + start, cell

    def grouped(self, vectors: np.ndarray, bound: np.ndarray, wanted: int) -> np.ndarray | None:
        """A group for each cell, if the sampled queries visit so many cells that groups are worth it.

        A group has one cell where few are visited, and an eighth of all where all are.
        """
        cells = len(self.pivots)
        visits = sum(len(row) for row, _ in self.others(vectors, bound, wanted)) / max(1, len(vectors))
        together = int(visits * visits / (GROUPS * max(1, cells)))
        if together < 2:
            return None
        groups = np.zeros(cells, np.int64)
        groups[_in_order(self.pivots)] = np.arange(cells) // together
        return groups


class NeighbourIndex:
    """``fit`` describes a reference table; ``join`` finds neighbours of query rows in it.

    ``apart`` names a column of both tables: rows with equal values are no neighbours, so one
    index serves all folds of a cross-validation.
    """

    def __init__(self, key: str, features: Sequence[str] | str, k: int, payload: Sequence[str] = (),
                 exclude_self: bool = False, pivots: int | None = None,
                 block_refs: int = BLOCK_REFS, block_queries: int = BLOCK_QUERIES, apart: str | None = None):
        self.key, self.features, self.k = key, features, k
        self.payload, self.exclude_self, self.apart = list(payload), exclude_self, apart
        self.n_pivots, self.block_refs, self.block_queries = pivots, block_refs, block_queries
        self.wanted = k + 1 if exclude_self else k

    def _group(self) -> Column:
        return (F.col(self.apart) if self.apart else F.lit(None)).cast("string").alias("__g")

    def fit(self, ref: DataFrame) -> NeighbourIndex:
        """Picks pivots, assigns the rows to cells and stores them."""
        rows = ref.select(F.col(self.key).alias("__key"), _vector(self.features).alias("__v"), self._group(), *self.payload)
        rows = rows.filter(_whole("__v"))
        wanted = self.n_pivots or min(MAX_PIVOTS, int(np.ceil(np.sqrt(rows.count()))))
        # the rows with the smallest key hashes: a random choice that is the same on every run
        picked = rows.select(key_hash("__key").alias("h"), "__key", "__v").orderBy("h", "__key").limit(wanted).collect()
        pivots = np.unique(np.array([r["__v"] for r in picked], dtype=float), axis=0) if picked else np.zeros((0, 1))
        empty = np.zeros(len(pivots))
        index = Cells(pivots, empty, empty, empty)

        # of equal vectors only the first `wanted` keys of a group can be among the nearest
        copies = W.partitionBy("__v", "__g").orderBy("__key")
        distinct = rows.withColumn("__copy", F.row_number().over(copies)).filter(F.col("__copy") <= self.wanted)

        schema = T.StructType(
            [f for f in distinct.drop("__copy").schema]
            + [T.StructField("__cell", T.IntegerType()), T.StructField("__d", T.DoubleType())]
        )

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, d = index.locate(_points(batch.column("__v")))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d)], [*batch.schema.names, "__cell", "__d"])

        self.refs = stage(distinct.drop("__copy").mapInArrow(assign, schema), "neighbours")
        per_cell = self.refs.groupBy("__cell").agg(
            F.count("*").alias("n"), F.min("__d").alias("lo"), F.max("__d").alias("hi")
        ).toPandas()
        rows_, lo, hi = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots))
        rows_[per_cell["__cell"]], lo[per_cell["__cell"]], hi[per_cell["__cell"]] = (
            per_cell["n"], per_cell["lo"], per_cell["hi"],
        )
        self.cells = Cells(pivots, rows_, lo, hi)
        return self

    def state(self) -> dict:
        """The settings, the cells as a table, and the stored reference rows."""
        cells = [
            (i, p.tolist(), float(n), float(lo), float(hi))
            for i, (p, n, lo, hi) in enumerate(zip(self.cells.pivots, self.cells.rows, self.cells.nearest_row, self.cells.furthest_row))
        ]
        table = self.refs.sparkSession.createDataFrame(cells, "cell int, pivot array<double>, n double, lo double, hi double")
        settings = ("key", "features", "k", "payload", "exclude_self", "n_pivots", "block_refs", "block_queries", "apart")
        return {**{c: getattr(self, c) for c in settings}, "cells": table, "refs": self.refs}

    @classmethod
    def restored(cls, state: dict) -> NeighbourIndex:
        settings = {c: state[c] for c in ("key", "features", "k", "payload", "exclude_self", "block_refs", "block_queries", "apart")}
        index = cls(**settings, pivots=state["n_pivots"])
        rows = state["cells"].orderBy("cell").collect()
        column = lambda c: np.array([r[c] for r in rows], float)
        index.cells = Cells(np.array([r["pivot"] for r in rows], float).reshape(len(rows), -1), column("n"), column("lo"), column("hi"))
        index.refs = state["refs"]
        return index

    def _visits(self, vectors: DataFrame, first: bool, groups: np.ndarray | None) -> DataFrame:
        cells, wanted = self.cells, self.wanted
        schema = T.StructType([*vectors.schema, T.StructField("__group", T.IntegerType())])

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = _points(batch.column("__v"))
                found = cells.home(points, wanted) if first else cells.others(points, batch.column("__bound").to_numpy(zero_copy_only=False), wanted, groups)
                for row, cell in found:
                    for at in range(0, len(row), VISIT_ROWS):
                        piece = slice(at, at + VISIT_ROWS)
                        columns = batch.take(pa.array(row[piece])).columns
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(cell[piece], pa.int32())], [*batch.schema.names, "__group"])

        return vectors.mapInArrow(spread, schema)

    def _search(self, vectors: DataFrame, first: bool, groups: np.ndarray | None = None) -> DataFrame:
        """(__id, __dist, __key, payload): the best rows of each visited block, at most ``wanted`` each.

        Without ``groups`` each cell is visited by itself.
        """
        spark = vectors.sparkSession
        visits = stage(self._visits(vectors, first, groups), "visits")
        load = {r[0]: r[1] for r in visits.groupBy("__group").count().collect()}
        of_cell = np.arange(len(self.cells.rows)) if groups is None else groups
        rows = np.bincount(of_cell, self.cells.rows)
        shape = [(g, int(-(-rows[g] // self.block_refs)), int(-(-n // self.block_queries))) for g, n in load.items()]
        members = [(c, int(g)) for c, g in enumerate(of_cell) if int(g) in load]

        def layout() -> DataFrame:
            # one row per visited group: at most MAX_PIVOTS rows
            return spark.createDataFrame(shape, "__group int, __rb int, __qb int")

        def every(count: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

        # a block pair is (group, reference block, query block); both sides are bounded
        left = (
            visits.join(layout(), "__group")
            .withColumn("__qblock", F.pmod(F.xxhash64("__v"), F.col("__qb")).cast("int"))
            .withColumn("__rblock", every("__rb"))
        )
        right = (
            self.refs.drop("__d").join(spark.createDataFrame(members, "__cell int, __group int"), "__cell").join(layout(), "__group")
            .withColumn("__rblock", F.pmod(F.xxhash64("__key"), F.col("__rb")).cast("int"))
            .withColumn("__qblock", every("__qb"))
        )
        block = ["__group", "__rblock", "__qblock"]
        pairs = sum(r * q for _, r, q in shape)
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(partitions, min(pairs // PAIRS_PER_TASK, TASKS_PER_PARTITION * partitions))
        left, right = left.repartition(tasks, *block), right.repartition(tasks, *block)
        payload, k, grouped = self.payload, self.wanted, self.apart is not None
        fields = {f.name: f for f in self.refs.schema}
        schema = T.StructType(
            [T.StructField("__id", vectors.schema["__id"].dataType), T.StructField("__dist", T.DoubleType()),
             fields["__key"], *[fields[p] for p in payload]]
        )

        def search(qs: pa.Table, rs: pa.Table) -> pa.Table:
            rs = rs.sort_by("__key")
            parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            if qs.num_rows and rs.num_rows:
                q, r = (_points(t["__v"].combine_chunks()) for t in (qs, rs))
                apart = tuple(np.array(t["__g"].to_pylist(), object) for t in (qs, rs)) if grouped else None
                for found in nearest(q, r, k, apart=apart, bounds=qs["__bound"].to_numpy()):
                    for part, values in zip(parts, found):
                        part.append(values)
            row, col, dist = (np.concatenate(p) for p in parts)
            near = rs.select(["__key", *payload]).take(pa.array(col))
            return pa.table({"__id": qs["__id"].take(pa.array(row)), "__dist": pa.array(dist), **{c: near[c] for c in near.column_names}})

        return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(search, schema)

    def _best(self, found: DataFrame) -> DataFrame:
        order = W.partitionBy("__id").orderBy("__dist", "__key")
        return found.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= self.wanted)

    def _lists(self, vectors: DataFrame) -> DataFrame:
        """(__id, __near): the entries nearest to each stored vector, at most ``wanted``."""
        endless = F.lit(float("inf"))
        first = stage(self._search(vectors.withColumn("__bound", endless), True), "near")
        kth = self._best(first).filter(F.col("__rank") == self.wanted).select("__id", F.col("__dist").alias("__kth"))
        bounded = stage(vectors.join(kth, "__id", "left").withColumn("__bound", F.coalesce("__kth", endless)).drop("__kth"), "bounded")
        drawn = bounded.select("__v", "__bound").limit(SAMPLE).collect()
        groups = self.cells.grouped(np.array([r[0] for r in drawn], float), np.array([r[1] for r in drawn], float), self.wanted) if drawn else None
        second = self._search(bounded, False, groups)
        # the groups hold the home cells too
        found = first.unionByName(second) if groups is None else second
        # at most k (+1) entries per distinct query vector
        entry = F.struct("__rank", "__dist", "__key", *self.payload)
        return self._best(found).groupBy("__id").agg(F.array_sort(F.collect_list(entry)).alias("__near"))

    def _distinct(self, queries: DataFrame, key: str, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
        """The queries as points, and their distinct vectors, each under the smallest of its keys."""
        points = queries.select(F.col(key).alias("__q"), _vector(self.features).alias("__v"), self._group(), *keep)
        vectors = points.filter(_whole("__v")).groupBy("__v", "__g").agg(F.min("__q").alias("__id"))
        return points, stage(vectors, "vectors")

    def _spread(self, points: DataFrame, vectors: DataFrame, found: DataFrame) -> DataFrame:
        """The points with what was found (by __id) for their vector."""
        known = vectors.join(found, "__id").withColumnsRenamed({"__v": "__w", "__g": "__h"}).drop("__id")
        same = (points["__v"] == known["__w"]) & points["__g"].eqNullSafe(known["__h"])
        return points.join(known, same, "left").drop("__w", "__h")

    def classify(self, queries: DataFrame, key: str, label: str, output: str = "prediction", keep: Sequence[str] = ()) -> DataFrame:
        """(key, keep..., output): the ``vote`` of the neighbours, taken once for equal query vectors.

        ``label`` is one of the payload columns. A query without a neighbour has no prediction.
        """
        if self.exclude_self:
            raise ValueError("equal vectors have different neighbours where a row is none of its own")
        points, vectors = self._distinct(queries, key, keep)
        entry = self._lists(vectors).select("__id", F.explode("__near").alias("e"))
        votes = vote(entry.select("__id", F.col(f"e.{label}").alias("__label"), F.col("e.__dist").alias("distance")), "__id", "__label", "__vote")
        return self._spread(points, vectors, votes).select(F.col("__q").alias(key), *keep, F.col("__vote").alias(output))

    def join(self, queries: DataFrame, key: str) -> DataFrame:
        """(query key, ref_key, rank, distance, payload...): the k nearest reference rows,
        ordered by distance, then reference key. A query that has none keeps a row of nulls."""
        points, vectors = self._distinct(queries, key)
        result = self._spread(points, vectors, self._lists(vectors))
        near = F.col("__near")
        if self.exclude_self:
            near = F.filter(near, lambda e: e["__key"] != F.col("__q"))
        return (
            result.select("__q", F.posexplode_outer(F.slice(near, 1, self.k)).alias("pos", "e"))
            .select(
                F.col("__q").alias(key),
                F.col("e.__key").alias("ref_key"),
                (F.col("pos") + 1).alias("rank"),
                F.col("e.__dist").alias("distance"),
                *[F.col(f"e.{p}").alias(p) for p in self.payload],
            )
        )


def knn_join(queries: DataFrame, ref: DataFrame, key: str, features: Sequence[str] | str, k: int,
             ref_key: str | None = None, payload: Sequence[str] = (), exclude_self: bool = False,
             **options) -> DataFrame:
    """The k nearest rows of ``ref`` for every row of ``queries``."""
    index = NeighbourIndex(ref_key or key, features, k, payload, exclude_self, **options)
    return index.fit(ref).join(queries, key)


def vote(neighbours: DataFrame, key: str, label: str, output: str = "prediction") -> DataFrame:
    """Majority label per query; a tie goes to the smaller summed distance, then the label.

    A query without a neighbour has no prediction.
    """
    counts = neighbours.groupBy(key, label).agg(F.count("*").alias("n"), F.sum("distance").alias("d"))
    ranking = F.struct(-F.col("n"), F.round("d", 9), F.col(label))
    return counts.groupBy(key).agg(F.min_by(label, ranking).alias(output))


def knn_classify(train: DataFrame, queries: DataFrame, key: str, features: Sequence[str] | str,
                 label: str, k: int = 7, output: str = "prediction", **options) -> DataFrame:
    """(key, prediction) by majority of the k nearest training rows."""
    near = knn_join(queries, train, key, features, k, payload=[label], **options)
    return vote(near, key, label, output)
