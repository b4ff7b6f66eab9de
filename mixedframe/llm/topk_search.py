"""Exact top-k search by inner product with vector approximations.

Every component is an integer, floor(256 x). A dimension's range over all rows is cut into
``CELLS`` cells of equal integer width, and a row's approximation is its cell in each
dimension (one byte). For a query, the product with the lower corners of a row's cells plus
a constant of the query bounds the row's score from above and from below. A block of rows is
scanned by these bounds alone; then exact vectors are read in the order of the best possible
score, until the k-th exact score is above every bound left. Blocks are merged by score.

A vector is wide when a component is beyond 2**30 or its square sum beyond 2**61: a product of
two others fits 64 bits, one with a wide vector may not. Wide vectors are searched, and
search, in blocks of their own: products of doubles bound the score, and the rows that may be
among the k best are scored in integers of any size.

Defined cases: null vectors, empty ones, and such with null or non-finite components (256 x
must be finite too) take no part, nor do rows with a null vec_id; of rows that share a vec_id
the one with the greatest vector counts; vectors are compared with vectors of their own
length; a query with fewer than k candidates gets all of them; a score beyond a long is
ranked by its true value and shown as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .vectors import against_blocks, fewest_copies, matrix, one_per_id, usable

SCALE = 256
#: largest component and square sum of vectors whose products fit 64 bits
LARGEST, SQUARES = float(1 << 30), float(1 << 61)
LONG = (1 << 63) - 1
CELLS = 64
QUERY_BLOCK, ROW_BLOCK = 16_384, 65_536
AT_ONCE = 1 << 21


def integers(vector: Column) -> Column:
    """floor(256 x) of each component, as a double, which holds it exactly: from 2**53 on every double is whole."""
    scaled = F.transform(vector, lambda x: x * float(SCALE))
    return F.transform(scaled, lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y))


def is_wide(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    return F.exists(vector, lambda x: F.abs(x) > LARGEST) | (squares > SQUARES)


def _ranges(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and greatest component of each dimension, for each length of vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                own = matrix(batch.column("v").filter(pa.array(sizes == dim)), np.int64)
                n = pa.array([int(dim)] * dim, pa.int32())
                yield pa.RecordBatch.from_arrays([n, pa.array(np.arange(dim)), pa.array(own.min(axis=0)), pa.array(own.max(axis=0))], ["dim", "at", "lo", "hi"])

    found = rows.select("dim", "v").mapInArrow(partial, "dim int, at long, lo long, hi long")
    found = found.groupBy("dim", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim", "at").toPandas()
    return {int(d): (g["lo"].to_numpy(), g["hi"].to_numpy()) for d, g in found.groupby("dim")}


def _approximate(rows: DataFrame, grid: dict) -> DataFrame:
    """Rows with ``code``, the cell in each dimension."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                own = batch.filter(pa.array(sizes == dim))
                low, width = grid[int(dim)]
                codes = (matrix(own.column("v"), np.int64) - low) // width
                lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.astype(np.int8).ravel()), int(dim)).cast(pa.list_(pa.int8()))
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("dim"), lists, own.column("v")], ["vec_id", "dim", "code", "v"])

    return rows.select("vec_id", "dim", "v").mapInArrow(encode, "vec_id long, dim int, code array<byte>, v array<int>")


def search_block(ids, codes, exact, low, width, query_ids, queries, k):
    """(query position, row position, score) of the k best rows of a block for each query."""
    out_q, out_r, out_s = [], [], []
    corner = (low + codes.astype(np.int64) * width).astype(np.float64)
    reach = (width - 1).astype(np.float64)
    largest = np.abs(corner).max(axis=0) + reach
    error = (corner.shape[1] + 4) * 2.3e-16
    n = len(ids)
    for at in range(0, len(queries), max(1, AT_ONCE // n)):
        own = queries[at : at + max(1, AT_ONCE // n)]
        wanted = own.astype(np.float64)
        base = wanted @ corner.T
        up, down = np.maximum(wanted, 0) @ reach, np.minimum(wanted, 0) @ reach
        slack = error * (np.abs(wanted) @ largest) + 1e-9
        others = query_ids[at : at + len(own), None] != ids
        base[~others] = -np.inf
        floor = np.partition(base, n - k, axis=1)[:, n - k] + down - 2 * slack if n > k else np.full(len(own), -np.inf)
        for i in range(len(own)):
            rows = np.flatnonzero(others[i] & (base[i] + up[i] >= floor[i]))
            best_possible = base[i, rows] + up[i] + slack[i]
            rows = rows[np.argsort(-best_possible, kind="stable")]
            best_possible = base[i, rows] + up[i] + slack[i]
            score, read = np.zeros(0, np.int64), 0
            while read < len(rows):
                if read >= k and np.partition(score, read - k)[read - k] > best_possible[read]:
                    break
                part = rows[read : read + max(k, 32)]
                score = np.concatenate((score, exact[part] @ own[i]))
                read += len(part)
            top = np.lexsort((ids[rows[:read]], -score))[:k]
            out_q.append(np.full(len(top), at + i))
            out_r.append(rows[top])
            out_s.append(score[top])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(out_q), join(out_r), join(out_s)


def beyond(score: int) -> str:
    """For a score that a long cannot hold, a text that sorts like the score among those of its sign."""
    if -LONG - 1 <= score <= LONG:
        return ""
    whole = f"{len(str(abs(score))):06d}{abs(score)}"
    return whole if score > 0 else "".join(chr(105 - ord(c)) for c in whole)


def search_wide_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """(query position, row position, score) of the k best rows of a block for each query, in integers of any size.

    Components are divided by a power of two, so that no product leaves a double; what that
    and the rounding may change is the width of the bounds.
    """
    down = max(0, int(np.frexp(max(np.abs(rows).max(), np.abs(queries).max()))[1]) - 30)
    scaled = np.ldexp(rows, -down)
    out_q, out_r, out_s = [], [], []
    for at, query in enumerate(queries):
        own = np.ldexp(query, -down)
        rough = scaled @ own
        slack = (len(own) + 4) * 2.3e-16 * (np.abs(scaled) @ np.abs(own)) + 1e-290
        others = np.flatnonzero(ids != query_ids[at])
        low, high = (rough - slack)[others], (rough + slack)[others]
        floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
        whole = [int(x) for x in query]
        scored = [(sum(a * int(x) for a, x in zip(whole, rows[r])), r) for r in others[high >= floor]]
        for score, r in sorted(scored, key=lambda found: (-found[0], ids[found[1]]))[:k]:
            out_q.append(at)
            out_r.append(int(r))
            out_s.append(score)
    return out_q, out_r, out_s


FOUND = "query_id long, vec_id long, score long, beyond string"


def _found(left: pa.Table, right: pa.Table, q, r, scores, more=None) -> pa.Table:
    take = lambda column, at: column.take(pa.array(at, pa.int64()))
    more = pa.array([""] * len(q) if more is None else more, pa.string())
    return pa.table({"query_id": take(left["query_id"], q), "vec_id": take(right["vec_id"], r), "score": pa.array(scores, pa.int64()), "beyond": more})


def _wide_search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return _found(left, right, [], [], [])
    q, r, scores = search_wide_block(right["vec_id"].to_numpy(), matrix(right["v"]), left["query_id"].to_numpy(), matrix(left["q"]), k)
    shown = [max(-LONG - 1, min(LONG, x)) for x in scores]
    return _found(left, right, q, r, shown, [beyond(x) for x in scores])


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score (integer inner product) of the k best rows of each query.

    ``rows`` has vec_id and embedding; ``is_query`` is a condition on vec_id.
    """
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    vectors = vectors.where(usable(F.col("x"))).select("vec_id", integers(F.col("x")).alias("v")).where(usable(F.col("v")))
    vectors = stage(one_per_id(vectors).withColumn("wide", is_wide(F.col("v"))), "vectors")
    kept = stage(fewest_copies(vectors, k + 1).withColumn("dim", F.size("v")), "kept")
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), F.size("v").alias("dim"), F.col("v").alias("q"), "wide")
    spread = 2 * rows.sparkSession.sparkContext.defaultParallelism
    ints = lambda df, c: df.where("NOT wide").withColumn(c, F.col(c).cast("array<int>")).drop("wide")
    narrow = ints(kept, "v")
    grid = {d: (lo, np.maximum(1, -(-(hi - lo + 1) // CELLS))) for d, (lo, hi) in _ranges(narrow).items()}

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found(left, right, [], [], [])
        low, width = grid[right["dim"][0].as_py()]
        codes, exact = matrix(right["code"], np.int8), matrix(right["v"], np.int64)
        return _found(left, right, *search_block(right["vec_id"].to_numpy(), codes, exact, low, width, left["query_id"].to_numpy(), matrix(left["q"], np.int64), k))

    found = against_blocks(ints(queries, "q"), _approximate(narrow, grid), ["dim"], search, FOUND, QUERY_BLOCK, ROW_BLOCK, spread)
    if not vectors.where("wide").isEmpty():
        wide_search = lambda left, right: _wide_search(left, right, k)
        for asked, searched in ((queries, kept.where("wide")), (queries.where("wide"), kept.where("NOT wide"))):
            found = found.union(against_blocks(asked.drop("wide"), searched.drop("wide"), ["dim"], wide_search, FOUND, QUERY_BLOCK, ROW_BLOCK, spread))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
