"""How the sources of a language differ in their words, priced in whole numbers.

For each language the terms found in ``LEAST`` of its documents are kept. A group (language,
source) gives a kept term p = 1 + floor(10**9 (count + 1) / (N + V)), where N is the sum of
its counts and V the number of kept terms; so does the language as a whole. A term costs
f = floor((p - q)**2 / q), p being the group's value and q the one it is compared with.

Pairs: the kept terms of a language are dealt to blocks of about ``BLOCK`` terms and numbered
within, and a group is a sorted array (term number, count) per block. One task takes the two
arrays of an unordered pair of groups in one block: a galloping search finds the terms both
have, and overlaps, terms of one side and (from the number of terms in either) absent terms
are priced both ways. So a task holds two blocks, however many terms a group has.

Defined cases: null text, language or source counts as ''; every row is a document, repeated
rows too; a text of any length is read whole, in pieces; a group without kept terms still has
its pairs; a language without kept terms has pairs of value 0 and no term rows; a language
with one source has no pairs; an empty table gives no rows; other columns are not read. Counts
are exact up to 9 * 10**15 terms a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .terms import folding, term_lists, texts_of

LEAST = 3
TERM_RANKS = 200
BLOCK = 1 << 17
SHARE = 1_000_000_000
#: (group, term) counts a task holds before it passes them on
HELD = 400_000
SALTS = 32
LETTERS = folding(digits=False)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, summed per task."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def summed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in groups.items():
            if n:
                terms = list(n)
                names = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int32))) for x in (lang, source)]
                counts = [pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "df"])

    for batch in batches:
        for text, *group in zip(texts_of(batch.column("text")), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
            n, df = groups.setdefault(tuple(group), (Counter(), Counter()))
            before, distinct = len(n), set()
            for terms in term_lists(text, LETTERS):
                n.update(terms)
                distinct.update(terms)
            df.update(distinct)
            held += len(n) - before
            if held > HELD:
                yield from summed()
                groups.clear()
                held = 0
    yield from summed()


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """Inner join with a table of few rows a key, where a key may hold most of ``rows``.

    Each key is cut in ``SALTS`` by a hash of ``by`` and the few rows are repeated as often,
    so the join needs neither a broadcast of unknown size nor one task for a hot key.
    """
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"]).drop("__salt")


def per_billion(count: Column, total: Column) -> Column:
    """1 + floor(10**9 (count + 1) / total), exact for any long."""
    return (F.lit(1) + F.call_function("div", (count.cast("decimal(19,0)") + 1) * F.lit(SHARE).cast("decimal(10,0)"), total.cast("decimal(19,0)"))).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def price(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """``per_billion`` of an array, by three digits of the quotient at a time so that nothing leaves 64 bits."""
    out, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def prices(p: np.ndarray, q: np.ndarray) -> int:
    return int(((p - q) * (p - q) // q).sum())


def gallop(few: np.ndarray, many: np.ndarray, run: int = 1024) -> np.ndarray:
    """Where each of the sorted ``few`` would stand in the sorted ``many``.

    A run of needles starts where the run before ended and doubles its stride until it is
    past the last of them, then searches only that stretch: a short array skips through a
    long one without reading it.
    """
    out, low = np.zeros(len(few), np.int64), 0
    for at in range(0, len(few), run):
        own = few[at : at + run]
        stride = 1
        while low + stride < len(many) and many[low + stride] < own[-1]:
            stride *= 2
        out[at : at + len(own)] = low + np.searchsorted(many[low : low + stride + 1], own)
        low = int(out[at + len(own) - 1])
    return out


def pack_counts(slots: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted slots and their counts as compressed bytes."""
    order = np.argsort(slots)
    steps = np.diff(slots[order], prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.concatenate([steps.ravel(), counts[order].astype("<i8").view(np.uint8).reshape(-1, 8).T.ravel()]).tobytes(), "zstd", asbytes=True)


def unpack_counts(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, 12 * n, "zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<i4").ravel()
    return np.cumsum(steps), np.ascontiguousarray(raw[4 * n :].reshape(8, n).T).view("<i8").ravel()


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size_a: int, size_b: int) -> tuple[int, int, int]:
    """Price of b's shares for a, of a's for b, and the number of terms in either, for two sorted arrays (slot, count)."""
    if len(a[0]) > len(b[0]):
        back, there, union = merge(b, a, size_b, size_a)
        return there, back, union
    place = gallop(a[0], b[0])
    common = place < len(b[0])
    common[common] = b[0][place[common]] == a[0][common]
    theirs = np.zeros(len(a[0]), np.int64)
    theirs[common] = b[1][place[common]]
    alone = np.ones(len(b[0]), bool)
    alone[place[common]] = False
    rest = b[1][alone]
    p = np.concatenate([shares(a[1], size_a), shares(np.zeros(len(rest), np.int64), size_a)])
    q = np.concatenate([shares(theirs, size_b), shares(rest, size_b)])
    return prices(p, q), prices(q, p), len(p)


def _vector(key: tuple, table: pa.Table) -> pa.Table:
    data = pack_counts(table["slot"].to_numpy(), table["n"].to_numpy())
    names = ["lang", "source", "block"]
    return pa.table({**{c: pa.array([k.as_py()], t) for c, k, t in zip(names, key, (pa.string(), pa.string(), pa.int64()))}, "terms": pa.array([table.num_rows], pa.int64()), "data": pa.array([data], pa.binary())})


def _pair(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    def side(table: pa.Table) -> tuple[tuple[np.ndarray, np.ndarray], int] | None:
        if not table.num_rows:
            return None
        row = table.select(["terms", "data", "size"]).to_pylist()[0]
        return unpack_counts(row["data"], row["terms"]), row["size"]

    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = side(left), side(right)
    other = (left if left.num_rows else right)["other_size"][0].as_py()
    a, b = a or (none, other), b or (none, other)
    there, back, union = merge(a[0], b[0], a[1], b[1])
    lang, low, high = (k.as_py() for k in key[:3])
    return pa.table({"lang": pa.array([lang], pa.string()), "low": pa.array([low], pa.int32()), "high": pa.array([high], pa.int32()), "there": pa.array([there]), "back": pa.array([back]), "either": pa.array([union], pa.int64())})


def source_divergence(docs: DataFrame, least: int = LEAST, ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank.

    ``pair``: every other source of the language by the price of its shares. ``term``: the
    ``ranks`` terms that the group has most in excess of its language.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    group = ["lang", "source"]
    counts = stage(
        docs.mapInArrow(_counted, "lang string, source string, term string, n long, df long")
        .groupBy(*group, "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")),
        "counts",
    )
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= least).drop("df")
    kept = stage(kept, "kept")
    langs = stage(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "langs")
    numbered = spread_join(kept, langs, ["lang"], F.col("term")).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "term"), F.ceil(F.col("v") / BLOCK)))
    slot = F.row_number().over(W.partitionBy("lang", "block").orderBy("term"))
    entries = stage(counts.drop("df").join(numbered.withColumn("slot", slot), ["lang", "term"]), "entries")
    groups = _groups(docs, entries, langs)
    return _terms(entries, groups, ranks).union(_pairs(entries, groups))


def _groups(docs: DataFrame, entries: DataFrame, langs: DataFrame) -> DataFrame:
    """One row for each group: its number in the language, N + V, V, and the number of groups."""
    found = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    found = found.join(totals, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    in_lang = W.partitionBy("lang")
    v = F.coalesce("v", F.lit(0))
    return stage(
        found.select(
            "lang",
            "source",
            (F.row_number().over(in_lang.orderBy("source")) - 1).alias("at"),
            F.count("*").over(in_lang).cast("int").alias("n_groups"),
            v.alias("v"),
            (F.coalesce("n", F.lit(0)) + v).alias("size"),
        ),
        "groups",
    )


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    rows = rows.withColumn("rank", rank)
    rows = rows.where(F.col("rank") <= most) if most else rows
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _terms(entries: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    rows = spread_join(entries, groups.select("lang", "source", "size"), ["lang", "source"], F.col("term"))
    rows = rows.select("lang", "source", F.col("term").alias("item"), per_billion(F.col("n"), F.col("size")).alias("p"), per_billion(F.col("lang_n"), F.col("lang_total") + F.col("v")).alias("q"))
    return _ranked(rows.where("p > q").withColumn("value", price(F.col("p"), F.col("q"))), "term", ranks)


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    blocks = entries.select("lang", "source", "block", "slot", "n").groupBy("lang", "source", "block")
    vectors = stage(blocks.applyInArrow(_vector, "lang string, source string, block long, terms long, data binary"), "vectors")
    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("n_groups") - 1), lambda o: o != F.col("at"))).alias("other")
    sizes = groups.select("lang", F.col("at").alias("other"), F.col("size").alias("other_size"))
    # each group once for each other group of its language, as the pair's task needs it
    sides = groups.select("lang", "source", "at", "size", others).join(sizes, ["lang", "other"])
    low, high = F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high")
    placed = spread_join(vectors, sides, ["lang", "source"], F.col("block")).select("lang", low, high, "block", "terms", "data", "size", "other_size", (F.col("at") < F.col("other")).alias("is_low"))
    key = ["lang", "low", "high", "block"]
    # fresh columns, as both sides of the co-group come from one table
    left, right = (placed.where(side).select(*[F.col(c).alias(c) for c in [*key, "terms", "data", "size", "other_size"]]) for side in ("is_low", "NOT is_low"))
    merged = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_pair, "lang string, low int, high int, there long, back long, either long")
    merged = merged.groupBy("lang", "low", "high").agg(F.sum("there").alias("there"), F.sum("back").alias("back"), F.sum("either").alias("either"))
    names = groups.select("lang", F.col("at").alias("other"), F.col("source").alias("item"))
    pairs = groups.select("lang", "source", "at", "size", "v", others).join(names, ["lang", "other"]).join(sizes, ["lang", "other"])
    pairs = pairs.select("*", low, high).join(merged, ["lang", "low", "high"], "left")
    absent = F.col("v") - F.coalesce("either", F.lit(0))
    none, none_there = (per_billion(F.lit(0), F.greatest(F.col(c), F.lit(1))) for c in ("size", "other_size"))
    found = F.coalesce(F.when(F.col("at") < F.col("other"), F.col("there")).otherwise(F.col("back")), F.lit(0))
    return _ranked(pairs.select("lang", "source", "item", (found + absent * price(none, none_there)).alias("value")), "pair")
