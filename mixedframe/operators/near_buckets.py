"""Approximate k-nearest-neighbour join by bucketed random projections.

A row's bucket in one of ``tables`` hash tables is the cell of ``projections`` random
projections, each cut into strips of one width; near rows share a bucket in some table with a
probability that falls with their distance (the family that Spark's own
``BucketedRandomProjectionLSH`` draws from). The strip width is set by measurement: a bounded
sample of the reference rows is compared with all of them, and the width grows until the
sample finds ``recall`` of its true neighbours through shared buckets.

Equal query vectors are searched once, and of equal reference vectors only the first few keys
can be neighbours; the rest are dropped before the buckets. Buckets are joined in blocks of
bounded size on both sides, so one that holds most rows is many tasks, and each block keeps
only the k best of each of its queries. A row without a
complete vector is no reference and, as a query, keeps one row without a neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import key_hash
from ..session import stage
from .neighbours import _vector, _whole, distances, nearest

SAMPLE = 256
BLOCK = 8192
WIDEST = 40


def _cells(x: np.ndarray, ways: np.ndarray, shifts: np.ndarray, width: float) -> np.ndarray:
    """One 64-bit bucket for each row and table."""
    strips = np.floor((np.einsum("nd,tpd->ntp", x, ways) / width) + shifts).astype(np.int64).view(np.uint64)
    mixed = np.zeros(strips.shape[:2], np.uint64)
    for p in range(strips.shape[2]):
        mixed = (mixed ^ strips[:, :, p]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def _vectors(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class BucketIndex:
    """``fit`` chooses the strips for a reference table; ``join`` finds neighbours of query rows in it."""

    def __init__(self, key: str, features: Sequence[str] | str, k: int, exclude_self: bool = False, recall: float = 0.95,
                 tables: int = 8, projections: int = 3, seed: int = 1, block: int = BLOCK):
        self.key, self.features, self.k, self.exclude_self, self.recall = key, features, k, exclude_self, recall
        self.tables, self.projections, self.seed, self.block = tables, projections, seed, block
        self.wanted = k + 1 if exclude_self else k

    def _points(self, df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(F.col(key).alias(name), _vector(self.features).alias("v")).where(_whole("v"))

    def fit(self, ref: DataFrame) -> BucketIndex:
        copies = W.partitionBy("v").orderBy("ref_key")
        rows = self._points(ref, self.key, "ref_key").withColumn("copy", F.row_number().over(copies))
        rows = stage(rows.where(F.col("copy") <= self.wanted).drop("copy"), "points")
        drawn = rows.select(key_hash("ref_key").alias("h"), "ref_key", "v").orderBy("h", "ref_key").limit(SAMPLE).collect()
        x = np.array([r.v for r in drawn], float).reshape(len(drawn), -1) if drawn else np.zeros((0, 0))
        rng = np.random.default_rng(self.seed)
        ways = rng.standard_normal((self.tables, self.projections, x.shape[1]))
        self.ways, self.shifts = ways / np.sqrt(self.projections), rng.random((self.tables, self.projections))
        self.width, self.measured = self._fitted_width(rows, x)
        self.refs = stage(self._bucketed(rows, "ref_key"), "buckets")
        return self

    def _true_neighbours(self, rows: DataFrame, x: np.ndarray) -> dict[int, np.ndarray]:
        """The vectors of the ``wanted`` rows nearest to each sampled one, among all rows."""
        held = rows.sparkSession.sparkContext.broadcast(x)
        k = self.wanted

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best_d, best_v = np.full((len(held.value), 0), np.inf), None
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = _vectors(batch)
                for at in range(0, len(own), 4096):
                    part = own[at : at + 4096]
                    d = np.concatenate([best_d, distances(held.value, part)], axis=1)
                    take = np.argsort(d, axis=1, kind="stable")[:, :k]
                    both = np.broadcast_to(part, (len(d), *part.shape)) if best_v is None else np.concatenate([best_v, np.broadcast_to(part, (len(d), *part.shape))], axis=1)
                    best_d = np.take_along_axis(d, take, axis=1)
                    best_v = np.take_along_axis(both, take[:, :, None], axis=1)
            if best_v is not None:
                q = np.repeat(np.arange(len(best_d)), best_d.shape[1])
                lists = pa.array(list(best_v.reshape(len(q), -1)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(best_d.ravel()), lists], ["q", "d", "v"])

        found = rows.select("v").mapInArrow(compare, "q int, d double, v array<double>")
        top = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("d"))).where(F.col("n") <= k).collect()
        return {q: np.array([r.v for r in top if r.q == q], float) for q in {r.q for r in top}}

    def _fitted_width(self, rows: DataFrame, x: np.ndarray) -> tuple[float, float]:
        """The least width (of a doubling in four steps) that finds ``recall`` of the sample's true neighbours, two
        standard errors to spare, and the share found."""
        true = self._true_neighbours(rows, x) if len(x) else {}
        gaps = [np.sqrt(((v - x[q]) ** 2).sum(axis=1)).max() for q, v in true.items()]
        positive = [g for g in gaps if g > 0]
        if not positive:
            # all true neighbours are copies, which share every bucket whatever the width: the narrowest strips compare least
            apart = distances(x, x) if len(x) else np.zeros(0)
            positive = [apart[apart > 0].min()] if (apart > 0).any() else []
        width, share = float(np.median(positive)) if positive else 1.0, 1.0
        for _ in range(4 * WIDEST if true else 0):
            own = _cells(x, self.ways, self.shifts, width)
            each = np.array([(_cells(v, self.ways, self.shifts, width) == own[q]).any(axis=1).mean() for q, v in true.items()])
            share = float(each.mean())
            if share - 2 * each.std() / np.sqrt(len(each)) >= self.recall:
                break
            width *= 2**0.25
        return width, share

    def _bucketed(self, rows: DataFrame, id_: str) -> DataFrame:
        """Each row once per table, with its bucket."""
        ways, shifts, width, tables = self.ways, self.shifts, self.width, self.tables

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not ways.shape[2]:  # nothing to be near to
                    continue
                cells = _cells(_vectors(batch), ways, shifts, width)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(cells[:, t]), batch.column(id_), batch.column("v")], ["table", "bucket", id_, "v"])

        kind = rows.schema[id_].dataType.simpleString()
        return rows.mapInArrow(place, f"table int, bucket long, {id_} {kind}, v array<double>")

    def _asked(self, queries: DataFrame, key: str) -> DataFrame:
        """Each distinct query vector once, under the smallest of its keys: (v, query_key)."""
        return self._points(queries, key, "query_key").groupBy("v").agg(F.min("query_key").alias("query_key"))

    def join(self, queries: DataFrame, key: str) -> DataFrame:
        """(query key, ref_key, rank, distance): the k nearest reference rows found, ordered by distance, then reference key."""
        vectors = stage(self._asked(queries, key), "vectors")
        asked = stage(self._bucketed(vectors, "query_key"), "asked")
        cell = ["table", "bucket"]
        sizes = self.refs.groupBy(*cell).agg(F.ceil(F.count("*") / self.block).cast("int").alias("__rb"))
        sizes = stage(sizes.join(asked.groupBy(*cell).agg(F.ceil(F.count("*") / self.block).cast("int").alias("__qb")), cell), "sizes")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        block_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = asked.join(sizes, cell).withColumn("__q", block_of("query_key", "__qb")).withColumn("__r", every("__rb")).drop("__qb", "__rb")
        right = self.refs.join(sizes, cell).withColumn("__r", block_of("ref_key", "__rb")).withColumn("__q", every("__qb")).drop("__qb", "__rb")
        k = self.wanted
        schema = f"query_key {asked.schema['query_key'].dataType.simpleString()}, ref_key {self.refs.schema['ref_key'].dataType.simpleString()}, distance double"

        def search(qs: pa.Table, rs: pa.Table) -> pa.Table:
            rows, cols, found = [], [], []
            if qs.num_rows and rs.num_rows:
                rs = rs.sort_by("ref_key")
                x, y = (np.array(t["v"].combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (qs, rs))
                for row, col, distance in nearest(x, y, k):
                    rows.append(row)
                    cols.append(col)
                    found.append(distance)
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            at = lambda t, c, i: t[c].take(pa.array(join(i, np.int64)))
            return pa.table({"query_key": at(qs, "query_key", rows), "ref_key": at(rs, "ref_key", cols), "distance": pa.array(join(found, float))})

        keys = [*cell, "__q", "__r"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema).distinct()
        order = W.partitionBy("query_key").orderBy("distance", "ref_key")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        lists = best.groupBy("query_key").agg(F.array_sort(F.collect_list(F.struct("rank", "distance", "ref_key"))).alias("near"))
        known = vectors.join(lists, "query_key").select(F.col("v").alias("known"), "near")
        points = queries.select(F.col(key).alias("__key"), _vector(self.features).alias("v"))
        result = points.join(known, F.col("v") == F.col("known"), "left")
        near = F.col("near")
        if self.exclude_self:
            near = F.filter(near, lambda e: e["ref_key"] != F.col("__key"))
        return result.select("__key", F.posexplode_outer(F.slice(near, 1, self.k)).alias("pos", "e")).select(
            F.col("__key").alias(key), F.col("e.ref_key").alias("ref_key"), (F.col("pos") + 1).alias("rank"), F.col("e.distance").alias("distance")
        )

    def visited_share(self, queries: DataFrame, key: str) -> float:
        """Compared pairs over all pairs of a distinct query vector and a reference row that is kept."""
        cell = ["table", "bucket"]
        asked = self._bucketed(self._asked(queries, key), "query_key")
        pairs = asked.groupBy(*cell).agg(F.count("*").alias("q")).join(self.refs.groupBy(*cell).agg(F.count("*").alias("r")), cell)
        n = (asked.count() // self.tables) * (self.refs.count() // self.tables)
        return (pairs.agg(F.sum(F.col("q").cast("double") * F.col("r"))).first()[0] or 0.0) / max(1, n)


def approximate_knn_join(queries: DataFrame, ref: DataFrame, key: str, features: Sequence[str] | str, k: int,
                         ref_key: str | None = None, exclude_self: bool = False, **options) -> DataFrame:
    """About the k nearest rows of ``ref`` for every row of ``queries``."""
    return BucketIndex(ref_key or key, features, k, exclude_self, **options).fit(ref).join(queries, key)
