"""Shared by the vector searches: clean vectors, and a stated query set against all rows in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def one_per_id(rows: DataFrame) -> DataFrame:
    """(vec_id, v) with ids unique: of rows that share an id the greatest vector counts, a null id counts for nothing."""
    return rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.max("v").alias("v"))


def fewest_copies(rows: DataFrame, copies: int) -> DataFrame:
    """Of equal vectors only the ``copies`` smallest ids.

    Ties go to smaller ids, so no other can be among the best copies - 1 of any query; the
    limit per vector is applied before the shuffle, so a common vector is no hot key.
    """
    same = W.partitionBy("__hash", "v").orderBy("vec_id")
    ranked = rows.withColumn("__hash", F.xxhash64("v")).withColumn("__nth", F.row_number().over(same))
    return ranked.where(F.col("__nth") <= copies).drop("__hash", "__nth")


def matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    """A list column with lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def against_blocks(
    queries: DataFrame,
    rows: DataFrame,
    keys: list[str],
    search: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    query_block: int,
    row_block: int,
    spread: int = 1,
) -> DataFrame:
    """``search`` on every block of queries with every block of rows of the same key.

    Both sides are cut into blocks by a hash of their id, so a key that holds most rows or
    most queries is many cells of bounded size. ``keys`` must take a bounded number of
    values (cells of a fitted index, lengths of vectors): their counts are broadcast. A key
    is cut into ``spread`` row blocks at least, down to blocks of 1,024 rows, to keep all
    cores busy.
    """
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    n_rows = rows.groupBy(*keys).agg(F.count("*").alias("__r"))
    n_queries = queries.groupBy(*keys).agg(F.count("*").alias("__q"))
    counts = n_rows.join(n_queries, keys).collect()
    names = [f.name for f in n_rows.schema][: len(keys)]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    sizes = rows.sparkSession.createDataFrame([tuple(r) for r in counts], f"{kinds}, __r long, __q long").select(
        *keys,
        F.greatest(blocks(F.col("__r"), row_block), F.least(F.lit(spread), blocks(F.col("__r"), 1024))).alias("__rows"),
        blocks(F.col("__q"), query_block).alias("__queries"),
    )
    placed = lambda df, own, id_, n, other, m: (
        df.join(F.broadcast(sizes), keys)
        .withColumn(own, F.pmod(F.xxhash64(F.lit(own), id_), F.col(n)).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
        .drop(n, m)
    )
    left = placed(queries, "__qb", "query_id", "__queries", "__rb", "__rows")
    right = placed(rows, "__rb", "vec_id", "__rows", "__qb", "__queries")
    cell = [*keys, "__rb", "__qb"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, schema)


def best_of(found: DataFrame, k: int, *more: str) -> DataFrame:
    """The k highest scores of each query, ties to smaller vec_id: query_id, rank, vec_id, score and ``more``."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *more)
