"""MinHash near-duplicates with min-max hashing.

Every document becomes the set of its distinct word shingles. Each of ``PERMUTATIONS``
permutations of the shingle hashes leaves two values, the minimum and the maximum, so 128
signature values cost 64 hash evaluations per shingle. They form 32 bands of four values
from four different permutations; a pair of similarity 0.75 shares no band with
probability (1 - 0.75**4)**32, about five in a million.

Links are confirmed on the full sets, without ever listing all pairs of a group:

1. documents with equal sets collapse into one class;
2. in each bucket the members are compared with the bucket's smallest member only, so the
   work is linear in the bucket, and confirmed links are joined into components;
3. a bucket whose members lie in one component is finished. Only the others go on: there
   the members outside the largest component are compared with all members that are in
   another component, in cells of bounded size, each pair in the first band it shares, and
   a pair whose components a cell has already joined is not compared again.

Defined cases: a null or blank text has the empty set and is linked with nothing; rows that
share a doc_id are one document, which the row with the most shingles stands for (ties by
fingerprint); rows with a null doc_id are returned with a null component
and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import components
from .text import mix, shingle_sets

PERMUTATIONS, BANDS, ROWS = 64, 32, 4
CELL = 256
#: a pair of similarity 0.75 agrees in 96 of 128 values on average; 56 is eight deviations below
AGREEING = 56


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return seeds[:PERMUTATIONS] | np.uint64(1), seeds[PERMUTATIONS:]


def min_max_signature(shingles: np.ndarray, block: int = 2048) -> np.ndarray:
    """128 values of 32 bits, band after band: two minima and two maxima of four permutations."""
    factor, shift = _permutations()
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), block):
        moved = shingles[at : at + block, None] * factor + shift
        np.minimum(low, moved.min(axis=0), out=low)
        np.maximum(high, moved.max(axis=0), out=high)
    bands = np.arange(BANDS)
    quarter, half = PERMUTATIONS // 4, PERMUTATIONS // 2
    values = [low[bands], low[bands + half], high[bands + quarter], high[(bands + half + quarter) % PERMUTATIONS]]
    return (np.stack(values, axis=1) >> np.uint64(32)).astype("<u4").ravel()


SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, sig binary"


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, f1, f2, sig = [], [], [], []
        for own in shingle_sets(batch.column("text"), shingle):
            n.append(len(own))
            for column, value in zip((f1, f2), _fingerprint(own)):
                column.append(value)
            sig.append(min_max_signature(own).tobytes() if len(own) else None)
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "f1", "f2", "sig"])


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Per row: size and fingerprint of the shingle set, and the signature (null if empty)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _sketches(it, shingle), SKETCH)


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    return tuple(int(mix(own ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (0, 0x5BD1E995C0FFEE11))


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = list(shingle_sets(batch.column("text"), shingle))
        prints = [_fingerprint(x) for x in own]
        ends = np.cumsum([0, *(len(x) for x in own)])
        values = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        columns = [batch.column("doc_id"), *(pa.array([f[k] for f in prints], pa.int64()) for k in (0, 1)), lists]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "f1", "f2", "members"])


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, band, doc_id) for the classes that share a band with another class, with the bucket's pivot."""
    width = 4 * ROWS
    keys = [F.struct(F.lit(j).alias("band"), F.xxhash64(F.lit(j), F.substring("sig", j * width + 1, width)).alias("key")) for j in range(BANDS)]
    banded = reps.select("doc_id", F.explode(F.array(*keys)).alias("b")).select("doc_id", "b.band", "b.key")
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    # a written table, as any other here that is joined to a hot key: adaptive execution splits joins of plain shuffles
    return banded.join(stage(shared.drop("n"), "shared"), "key")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    x, y = F.size("x"), F.size("y")
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * F.least(x, y) >= percent * F.greatest(x, y))
        .where(100 * common >= percent * (x + y - common))
        .select("a", "b")
    )


def _cell_links(table: pa.Table, percent: int) -> pa.Table:
    """Links between components, found among the members of one cell."""
    out_a, out_b = [], []
    band, side = table["band"][0].as_py(), table["side"].to_numpy()
    comp, doc = table["comp"].to_numpy(), table["doc_id"].to_numpy()
    order = np.lexsort((doc, side))
    across = len(set(side.tolist())) > 1
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u4").reshape(-1, BANDS, ROWS)
    sets = [np.asarray(x.values) for x in table["members"].combine_chunks()]
    size = np.array([len(x) for x in sets])
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while joined.get(c, c) != c:
            c = joined[c]
        return c

    for at, i in enumerate(order):
        rest = order[at + 1 :]
        rest = rest[(comp[rest] != comp[i]) & ((side[rest] != side[i]) | (not across))]
        rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
        if not len(rest):
            continue
        same = sig[rest] == sig[i]
        first_shared = same.all(axis=2).argmax(axis=1) == band
        for j in rest[first_shared & (same.sum(axis=(1, 2)) >= AGREEING)]:
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a != b:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (size[i] + size[j] - common):
                    joined[max(a, b)] = min(a, b)
                    out_a.append(int(comp[i]))
                    out_b.append(int(comp[j]))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _unfinished_links(buckets: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between components that share a bucket without being linked through its pivot."""
    members = buckets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    members = members.withColumn("comp", F.coalesce("label", "doc_id")).drop("label", "pivot")
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    split = (
        parts.groupBy("key")
        .agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"), F.count("*").alias("n_comps"))
        .where("n_comps > 1")
    )
    split = stage(split, "split")
    blocks = lambda n: F.ceil(n / CELL)
    open_members = stage(
        members.join(split, "key")
        .withColumn("is_main", F.col("comp") == F.col("main"))
        .withColumn("n_few", blocks(F.col("n_all") - F.col("n_main")))
        .withColumn("n_many", blocks(F.col("n_main")))
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("is_main"), F.col("n_many")).otherwise(F.col("n_few"))))
        .select("key", "band", "doc_id", "comp", "is_main", "n_few", "n_many", "block"),
        "open",
    )
    if open_members.isEmpty():
        return None
    few = F.sequence(F.lit(0), F.col("n_few") - 1)
    many = F.sequence(F.lit(0), F.col("n_many") - 1)
    block = F.col("block")
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    own_cells = F.concat(
        F.transform(few, lambda o: cell(0, F.least(block, o), F.greatest(block, o))), F.transform(many, lambda o: cell(1, block, o))
    )
    cells = F.when(F.col("is_main"), F.transform(few, lambda o: cell(1, o, block))).otherwise(own_cells)
    placed = (
        open_members.withColumn("cell", F.explode(cells))
        .withColumn("side", F.when(F.col("cell.kind") == 1, F.col("is_main").cast("long")).otherwise(F.col("block")))
        .select("key", "band", "doc_id", "comp", "side", "cell")
        .join(reps.select("doc_id", "sig"), "doc_id")
        .join(sets, "doc_id")
    )
    found = placed.groupBy("key", "cell").applyInArrow(lambda t: _cell_links(t, percent), "a long, b long")
    return found.distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links of similarity ``percent`` / 100
    or more, kept marks the document that has it.
    """
    drawn = stage(sketches(docs, shingle), "sketches")
    named = drawn.where("n_shingles > 0 AND doc_id IS NOT NULL")
    marks = ["n_shingles", "f1", "f2"]
    # one row for an id, before classes are made: what links any of its classes must link the id
    ids = stage(named.groupBy("doc_id").agg(F.max(F.struct(*marks)).alias("m")).select("doc_id", *[F.col(f"m.{c}").alias(c) for c in marks]), "ids")
    classes = ids.groupBy(*marks).agg(F.min("doc_id").alias("rep"))
    reps = stage(
        named.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *marks], "left_semi")
        .groupBy("doc_id")
        .agg(F.max_by("sig", F.struct(*marks)).alias("sig")),
        "classes",
    )
    buckets = stage(_buckets(reps), "buckets")
    wanted = buckets.select("doc_id").distinct()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    sets = stage(
        source.mapInArrow(lambda it: _sets(it, shingle), "doc_id long, f1 long, f2 long, members array<long>")
        .groupBy("doc_id")
        .agg(F.max_by("members", F.struct(F.size("members"), "f1", "f2")).alias("members")),
        "sets",
    )
    starred = buckets.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    labels = components(_confirmed(starred, sets, percent))
    more = _unfinished_links(buckets, labels, reps, sets, percent)
    if more is not None:
        links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b").union(more)
        labels = components(links)
    placed = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*marks, F.coalesce("label", "rep").alias("component"))
    placed = ids.join(stage(placed, "placed"), marks).select("doc_id", "component")
    rows = drawn.select("doc_id", "n_shingles")
    known = rows.where("doc_id IS NOT NULL").join(placed, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id")).drop("component")
    unnamed = rows.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long"))
    return known.union(unnamed).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
