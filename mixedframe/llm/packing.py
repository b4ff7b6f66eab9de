"""Packing documents into token-budget batches of optimal length buckets.

Every batch is padded to the upper bound of its bucket. Dynamic programming over the global
histogram of lengths finds the bounds with the least padding; batches of as many documents
as the token budget holds are then formed inside each bucket.

Lengths below ``EXACT`` keep a histogram cell of their own, longer ones share cells of a
2048th of their size, so the histogram that reaches the driver has at most some hundred
thousand cells however long the texts are. A cell that counts at its least length makes every
plan look no dearer than it is; the cells that the best plan ends a bucket in are then counted
length by length and the plan is made again, until all its bounds are single lengths, which
makes it the best of all. A bucket may hold most documents: its rows are dealt to slices by
hash, slices get their first rank from running counts, and only a slice is numbered in one task.

Defined cases: null and blank texts have length 0 and sit in the first bucket; a document
longer than the budget is a batch of its own; an empty table gives no rows; rows with a null
or a repeated doc_id are rows like any other, as the order in a bucket is that of a hash of
the place a row is read from.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage

EXACT = 4096
SLICE = 20_000


def word_count(text: Column) -> Column:
    """Number of words between blanks, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cell_top(length: Column) -> Column:
    """The histogram cell of a length: the length itself if short, else rounded up by at most a 2048th."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(length, F.lit(1)))) - 11))
    return F.when(length < EXACT, length).otherwise((F.ceil(length / step) * step).cast("long"))


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascend. The cost of a bucket from i to j is length[j] times its documents,
    so each round of the dynamic programme is a lower envelope of lines whose slopes and
    arguments are both ordered, and takes linear time.
    """
    n = len(lengths)
    if not n:
        return []
    ahead = [0]
    for c in counts:
        ahead.append(ahead[-1] + c)
    cost = [0] + [lengths[j] * ahead[j + 1] for j in range(n)]
    back = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        hull: deque[tuple[int, int, int]] = deque()
        new, came = [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            slope, base = -ahead[j - 1], cost[j - 1]
            while len(hull) > 1:
                (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                if (base - b1) * (m1 - m2) <= (b2 - b1) * (m1 - slope):
                    hull.pop()
                else:
                    break
            hull.append((slope, base, j - 1))
            x = lengths[j - 1]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            m, b, i = hull[0]
            new[j], came[j] = m * x + b + x * ahead[j], i
        cost = new
        back.append(came)
    bounds, j = [], n
    for came in reversed(back):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = came[j]
    return bounds[::-1]


@dataclass(frozen=True)
class Plan:
    """Bounds of the buckets, documents in each, and the token budget."""

    bounds: list[int]
    counts: list[int]
    budget: int

    @property
    def capacity(self) -> list[int]:
        return [max(1, self.budget // max(1, b)) for b in self.bounds]

    @property
    def slices(self) -> list[int]:
        return [-(-c // SLICE) for c in self.counts]


def plan_buckets(lengths: DataFrame, buckets: int, budget: int) -> Plan:
    """Optimal buckets for a table (n_tokens)."""
    n = F.col("n_tokens")
    found = lengths.groupBy(cell_top(n).alias("top")).agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.count("*").alias("n")).collect()
    cells = sorted((r.lo, r.hi, r.n) for r in found)
    while True:
        bounds = optimal_bounds([lo for lo, _, _ in cells], [c for _, _, c in cells], buckets)
        chosen = set(bounds)
        wide = [c for c in cells if c[0] < c[1] and c[0] in chosen]
        if not wide:
            break
        inside = reduce(or_, [n.between(lo, hi) for lo, hi, _ in wide])
        single = lengths.where(inside).groupBy("n_tokens").agg(F.count("*").alias("n")).collect()
        cells = sorted([c for c in cells if c not in wide] + [(r.n_tokens, r.n_tokens, r.n) for r in single])
    counts = [0] * len(bounds)
    at = 0
    for _, top, n_docs in cells:
        while top > bounds[at]:
            at += 1
        counts[at] += n_docs
    return Plan(bounds, counts, budget)


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, bucket, padded_to, batch (within the bucket) and slot, all from 0."""
    # written once: the histogram, the slices and the ranks all read the lengths, not the texts
    n_tokens = word_count(F.col("text")) if length is None else length
    rows = stage(docs.select("doc_id", n_tokens.alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "lengths")
    plan = plan_buckets(rows, buckets, budget)
    if not plan.bounds:
        none = F.lit(None).cast("long")
        return rows.select("doc_id", "n_tokens", *[none.alias(c) for c in ("bucket", "padded_to", "batch", "slot")])
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket").cast("int") + 1)
    bounds = F.array(*[F.lit(b).cast("long") for b in plan.bounds])
    spread = F.xxhash64(F.lit("slice"), "row")
    rows = rows.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("n_tokens"))).cast("long"))
    rows = rows.withColumn("slice", F.pmod(spread, pick(plan.slices)))
    before = W.partitionBy("bucket").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    firsts = (
        rows.groupBy("bucket", "slice")
        .agg(F.count("*").alias("n"))
        .select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    inside = W.partitionBy("bucket", "slice").orderBy(F.xxhash64(F.lit("rank"), "row"), "row")
    ranked = rows.withColumn("nth", F.row_number().over(inside) - 1).join(firsts, ["bucket", "slice"])
    rank, room = F.col("first") + F.col("nth"), pick(plan.capacity)
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket",
        pick(plan.bounds).alias("padded_to"),
        F.floor(rank / room).alias("batch"),
        F.pmod(rank, room).alias("slot"),
    )
