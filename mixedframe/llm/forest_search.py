"""Approximate nearest neighbours by a forest of random-projection trees.

A node's direction is the difference of two random sample points below it, its threshold the
sample's median. Trees are fitted on a bounded sample of the vectors, and every vector is
dealt to one leaf of each tree. For inner products of vectors of unequal length, indexed
vectors get one more component that makes their lengths equal, queries a zero.

A query opens leaves of all trees in the order of one shared priority queue, whose key is the
largest margin by which the query lies on the other side of a split. It works in two rounds:
the first opens each tree's home leaf and gives the distance r of the k-th best so far; the
second goes on while the key is at most ``reach`` times the usual projection of a vector of
length r. A query in a dense spot stops early, one whose neighbours are hardly nearer than
anything else opens much. ``reach`` is set from the table at hand: a bounded sample of the
queries is compared with every row, the key at which each true neighbour's leaf would open is
read off the trees, and the reach is raised until the sample finds ``recall`` of them. Candidates are scored exactly, in double precision, inside the leaf
block, and leave it only if they reach the k-th best of the first round.

Vectors are compared with vectors of their own length: each length that fills more than one
leaf has a forest of its own, the vectors of all rarer lengths are compared with each other in
blocks.

Defined cases: null or all-zero vectors, such with null or non-finite components and rows with
a null vec_id take no part; of rows that share a vec_id the greatest vector counts; a query
with fewer than k candidates of its length gets all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .vectors import against_blocks, best_of, fewest_copies, matrix, one_per_id, usable

TREES = 8
SAMPLE = 20_000
LEAF_ROWS = 2048
#: sample points a leaf must have, which bounds the depth: 2**10 leaves for SAMPLE points
LEAF_SAMPLE = 16
#: least reach, and the share of true neighbours for which it is raised as far as it takes
REACH, RECALL = 0.45, 0.95
RECALL_QUERIES = 256
QUERY_BLOCK, ROW_BLOCK = 8192, 16_384
AT_ONCE = 1 << 20


@dataclass
class Forest:
    """Complete binary trees: directions and thresholds of the nodes in heap order."""

    depth: int
    directions: np.ndarray  # trees x nodes x components
    thresholds: np.ndarray  # trees x nodes
    longest: float
    spread: float

    @classmethod
    def fit(cls, sample: np.ndarray, n_rows: int, longest: float, trees: int = TREES, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        points = _lengthened(sample, longest)
        room = max(1, len(points) // LEAF_SAMPLE)
        depth = max(0, min(int(np.ceil(np.log2(max(1, n_rows) / LEAF_ROWS))), int(np.log2(room))))
        nodes = (1 << depth) - 1
        directions, thresholds = np.zeros((trees, nodes, points.shape[1])), np.zeros((trees, nodes))
        for t in range(trees):
            below = {0: np.arange(len(points))}
            for node in range(nodes):
                own = below.pop(node)
                pair = points[rng.choice(own, 2, replace=False)] if len(own) > 1 else np.zeros((2, points.shape[1]))
                way = pair[0] - pair[1]
                length = np.linalg.norm(way)
                if length == 0:
                    way, length = rng.standard_normal(len(way)), 1.0
                    length = np.linalg.norm(way)
                way = way / length
                along = points[own] @ way
                middle = np.median(along) if len(own) else 0.0
                directions[t, node], thresholds[t, node] = way, middle
                below[2 * node + 1], below[2 * node + 2] = own[along <= middle], own[along > middle]
        return cls(depth, directions, thresholds, longest, _usual_projection(points, directions, rng))

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point in each tree."""
        points = _lengthened(points, self.longest)
        out = np.zeros((len(points), len(self.directions)), np.int32)
        for t in range(len(self.directions)):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", points, self.directions[t, node])
                node = 2 * node + 1 + (along > self.thresholds[t, node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def keys(self, query: np.ndarray) -> np.ndarray:
        """Key at which ``query`` opens each leaf of each tree."""
        margins = self.directions @ np.append(query, 0.0) - self.thresholds
        out = np.zeros((len(margins), 1))
        for level in range(self.depth):
            m = margins[:, (1 << level) - 1 : (2 << level) - 1]
            sides = np.maximum(out, np.maximum(m, 0)), np.maximum(out, np.maximum(-m, 0))
            out = np.stack(sides, axis=2).reshape(len(margins), -1)
        return out

    def opened(self, query: np.ndarray, limit: float) -> Iterator[tuple[int, int, float]]:
        """(tree, leaf, key) in the order of the shared priority queue, while the key is at most ``limit``."""
        margins = self.directions @ np.append(query, 0.0) - self.thresholds
        inner = (1 << self.depth) - 1
        queue = [(0.0, t, 0) for t in range(len(margins))]
        while queue and queue[0][0] <= limit:
            key, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t, node]
                near = 2 * node + 1 + (m > 0)
                heapq.heappush(queue, (max(key, abs(m)), t, 4 * node + 3 - near))
                node = near
            yield t, node - inner, key


def _lengthened(points: np.ndarray, longest: float) -> np.ndarray:
    missing = np.sqrt(np.maximum(longest**2 - (points**2).sum(axis=1), 0))
    return np.column_stack([points, missing])


def _usual_projection(points: np.ndarray, directions: np.ndarray, rng: np.random.Generator, take: int = 500) -> float:
    """Root mean square projection, on the split directions, of unit vectors between near sample points."""
    d = points.shape[1]
    if len(points) < 8 or not directions.shape[1]:
        return 1 / np.sqrt(d)
    some = points[rng.choice(len(points), min(take, len(points)), replace=False)]
    others = points[:2000]
    apart = (some**2).sum(axis=1)[:, None] + (others**2).sum(axis=1) - 2 * some @ others.T
    near = np.argsort(apart, axis=1)[:, 1:6]
    gaps = (some[:, None, :] - others[near]).reshape(-1, d)
    size = np.linalg.norm(gaps, axis=1)
    gaps = gaps[size > 1e-12] / size[size > 1e-12, None]
    ways = directions.reshape(-1, d)[:256]
    return float(np.sqrt(((gaps @ ways.T) ** 2).mean())) if len(gaps) else 1 / np.sqrt(d)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the same order wherever a row stands."""
    return (rows * query).sum(axis=1)


def search_block(ids, rows, query_ids, queries, floors, k):
    """(query position, row position, score) of the k best rows of a block for each query, at least at its floor."""
    out_q, out_r, out_s = [], [], []
    n, step = len(ids), max(1, AT_ONCE // len(ids))
    longest = np.sqrt((rows**2).sum(axis=1).max())
    for at in range(0, len(queries), step):
        own = queries[at : at + step]
        rough = own @ rows.T
        rough[query_ids[at : at + step, None] == ids] = -np.inf
        slack = 1e-12 * np.linalg.norm(own, axis=1) * longest
        least = np.partition(rough, n - k, axis=1)[:, n - k] if n > k else np.full(len(own), -np.inf)
        least = np.maximum(least, floors[at : at + step]) - slack
        q, r = np.nonzero(rough >= np.maximum(least, np.finfo(float).min)[:, None])
        score = exact_scores(rows[r], own[q])
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        use = (place < k) & (score >= floors[at : at + step][q])
        out_q.append(q[use] + at)
        out_r.append(r[use])
        out_s.append(score[use])
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def _dealt(rows: DataFrame, forest) -> DataFrame:
    """Each row once per tree, with its leaf."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = forest.value
        for batch in batches:
            leaves = own.leaves(matrix(batch.column("v"))) if batch.num_rows else np.zeros((0, 0), np.int32)
            for t in range(leaves.shape[1]):
                columns = [pa.array(np.full(len(leaves), t, np.int32)), pa.array(leaves[:, t]), batch.column("vec_id"), batch.column("v")]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "vec_id", "v"])

    return rows.select("vec_id", "v").mapInArrow(deal, f"tree int, leaf int, vec_id long, v {rows.schema['v'].dataType.simpleString()}")


def _probes(queries: DataFrame, forest, home: bool) -> DataFrame:
    """The leaves each query opens: its home leaves, or the others up to its limit."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = forest.value
        for batch in batches:
            if not batch.num_rows:
                continue
            limits = np.zeros(batch.num_rows) if home else batch.column("limit").to_numpy()
            tree, leaf, at = [], [], []
            for i, (query, limit) in enumerate(zip(matrix(batch.column("v")), limits)):
                for t, x, key in own.opened(query, limit):
                    if home == (key == 0):
                        tree.append(t)
                        leaf.append(x)
                        at.append(i)
            take = lambda c: batch.column(c).take(pa.array(at, pa.int32()))
            columns = [pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), take("query_id"), take("v"), take("floor")]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "query_id", "q", "floor"])

    kind = queries.schema["v"].dataType.simpleString()
    return queries.mapInArrow(probe, f"tree int, leaf int, query_id long, q {kind}, floor double")


def least_reach(ratios: list[np.ndarray], reach: float, recall: float) -> float:
    """The least value from ``reach`` on that finds ``recall`` of the true neighbours, two standard errors to spare.

    ``ratios`` has, for each sampled query, the reach at which each of its true neighbours is found.
    """
    for at in np.append(reach, np.unique(np.concatenate(ratios))):
        if at >= reach:
            found = np.array([np.mean(r <= at) for r in ratios])
            if found.mean() - 2 * found.std() / np.sqrt(len(found)) >= recall:
                break
    return float(max(at, reach))


def _fitted_reach(asked: DataFrame, indexed: DataFrame, forest, k: int, reach: float, recall: float) -> float:
    """``reach``, raised until a sample of the queries finds ``recall`` of its true neighbours among all rows."""
    fitted = forest.value
    drawn = asked.orderBy(F.xxhash64(F.lit("recall"), "query_id"), "query_id").limit(RECALL_QUERIES).collect()
    if not fitted.depth or not drawn:
        return reach
    sampled, queries = np.array([r.query_id for r in drawn], np.int64), np.array([r.v for r in drawn], float)
    floors, far = np.array([r.floor for r in drawn]), np.array([r.far for r in drawn])
    held = asked.sparkSession.sparkContext.broadcast((sampled, queries, floors))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (query_ids, vectors, least) = forest.value, held.value
        keys = np.stack([own.keys(v) for v in vectors])
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, rows = batch.column("vec_id").to_numpy(), matrix(batch.column("v"))
            q, r, score = search_block(ids, rows, query_ids, vectors, least, k)
            used, place = np.unique(r, return_inverse=True)
            leaves = own.leaves(rows[used])[place]
            need = keys[q[:, None], np.arange(leaves.shape[1]), leaves].min(axis=1, initial=np.inf)
            best = [np.concatenate(x) for x in zip(best, (q, ids[r], score, need))]
            order = np.lexsort((best[1], -best[2], best[0]))
            best = [x[order] for x in best]
            use = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
            best = [x[use] for x in best]
        columns = [pa.array(query_ids[best[0]]), *map(pa.array, best[1:])]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "need"])

    found = indexed.select("vec_id", "v").mapInArrow(compare, "query_id long, vec_id long, score double, need double")
    needs = best_of(found, k, "need").toPandas().groupby("query_id")["need"]
    usual = dict(zip(sampled, fitted.spread * np.maximum(far, 1e-9 * fitted.longest)))
    # the last digits of a limit must not decide whether a leaf is opened
    return least_reach([x.to_numpy() / usual[q] * (1 + 1e-9) for q, x in needs] or [np.zeros(1)], reach, recall)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, reach: float = REACH, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows found for each query.

    ``rows`` has vec_id and embedding; ``is_query`` is a condition on vec_id. ``reach`` is raised
    where the table needs it for ``recall``.
    """
    vector = F.col("embedding")
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v"))
    vectors = vectors.where(usable(F.col("v")) & F.exists("v", lambda x: x != 0))
    vectors = stage(one_per_id(vectors).withColumn("dim", F.size("v")), "vectors")
    lengths = vectors.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > LEAF_ROWS).orderBy("dim").collect()
    rare = vectors.where(~F.col("dim").isin([r.dim for r in lengths]))
    asked = rare.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("dim").alias("dim"), F.col("v").alias("q"), F.lit(float("-inf")).alias("floor"))
    search = lambda left, right: _search(left, right, k)
    found = against_blocks(asked, fewest_copies(rare, k + 1), ["dim"], search, FOUND, QUERY_BLOCK, ROW_BLOCK)
    for r in lengths:
        own = vectors.where(F.col("dim") == r.dim).drop("dim")
        found = found.union(_through_forest(own, is_query, k, r.dim, trees, reach, recall))
    return best_of(found, k)


FOUND = "query_id long, vec_id long, score double"


def _search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    q, r, s = (np.zeros(0, np.int64),) * 3
    if left.num_rows and right.num_rows:
        ids, query_ids = right["vec_id"].to_numpy(), left["query_id"].to_numpy()
        q, r, s = search_block(ids, matrix(right["v"]), query_ids, matrix(left["q"]), left["floor"].to_numpy(), k)
    return pa.table({"query_id": left["query_id"].take(pa.array(q)), "vec_id": right["vec_id"].take(pa.array(r)), "score": pa.array(s, pa.float64())})


def _through_forest(vectors: DataFrame, is_query: Column, k: int, dim: int, trees: int, reach: float, recall: float) -> DataFrame:
    """query_id, vec_id, score found among vectors of one length, the k best of each query among them."""
    spark = vectors.sparkSession
    indexed = stage(fewest_copies(vectors, k + 1), "indexed")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, longest = indexed.agg(F.count("*"), F.sqrt(F.max(square))).first()
    share = min(1.0, SAMPLE / n)
    drawn = indexed.where(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("vec_id").select("v").limit(2 * SAMPLE)
    sample = np.array([r.v for r in drawn.collect()], float).reshape(-1, dim)
    fitted = Forest.fit(sample, n, longest, trees)
    forest = spark.sparkContext.broadcast(fitted)
    search = lambda left, right: _search(left, right, k)

    def opened(asked: DataFrame, home: bool) -> DataFrame:
        probes = stage(_probes(asked, forest, home), "probes")
        return stage(against_blocks(probes, dealt, ["tree", "leaf"], search, FOUND, QUERY_BLOCK, ROW_BLOCK).distinct(), "found")

    dealt = stage(_dealt(indexed, forest), "dealt")
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    first = opened(queries.withColumn("floor", F.lit(float("-inf"))), True)
    # the k-th best so far bounds what can still matter; a query with fewer opens everything
    kth = best_of(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    far = F.sqrt(F.greatest(square + float(longest) ** 2 - 2 * F.col("floor"), F.lit(0.0)))
    asked = queries.join(kth, "query_id", "left").withColumn("far", F.coalesce(far, F.lit(float("inf"))))
    asked = stage(asked.withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "asked")
    reach = _fitted_reach(asked, indexed, forest, k, reach, recall)
    limit = F.when(F.col("far") < float("inf"), F.col("far") * float(reach * fitted.spread)).otherwise(float("inf"))
    second = opened(asked.withColumn("limit", limit), False)
    return first.union(second).distinct()
