"""Ranked lexical search by presence masks.

A stated set of items is searched in all documents. The documents are read once for a block
of items: a document leaves its number of terms and those it shares with the items. From
these follow the document frequencies and with them the weights. Then every task goes
through its documents in blocks. In a block each query term is a bitmap of the documents that
hold it; for an item the bitmaps are laid over each other, which gives each document a mask of
the item's terms it holds, and documents of one mask form a group. A group can score at most
the sum over its terms of the best that the term adds to any document of the block. Groups are
evaluated by descending bound, each document exactly, until the k-th best score of the item
so far is above every bound left; a tie is still read, since the smaller doc_id may be in it.
Tasks pass on k documents an item.

Items are taken in blocks of about ``BLOCK_TERMS`` terms, whose vocabulary goes to every task;
more items mean more passes. Masks have as many bits as the item has different terms.

Defined cases: null or blank texts have no term, do not count as documents and are never
found; an item without terms, or with none that a document holds, finds nothing; every row
is a document and every row of ``items`` an item, repeated ones too; documents without a
doc_id count and rank after others of equal score, repeated doc_ids in any order among
equal scores; a text of any length is read whole, in pieces; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .terms import folding, term_lists, texts_of

BLOCK_TERMS = 1 << 18
#: shared terms of the documents that are laid out at once
BLOCK_ENTRIES = 1 << 21
#: how much a document's length tells, in hundredths
LENGTH_SHARE = 75
ALNUM = folding(digits=True)


@dataclass
class Items:
    """The different terms of a block of items, and each item as term numbers with repeats counted."""

    vocabulary: dict[bytes, int]
    items: list[tuple[int, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list) -> Items:
        vocabulary: dict[bytes, int] = {}
        items = []
        for r in rows:
            numbers = [vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r.terms]
            items.append((r.item, np.array(numbers, np.int64), np.array(r.repeats, np.int64)))
        return cls(vocabulary, items)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for text in texts_of(batch.column("text")):
            own: Counter = Counter()
            for terms in term_lists(text, ALNUM):
                own.update(terms)
            counts.append(own)
        lists = [pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("item"), *lists], ["item", "terms", "repeats"])


def _matches(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Of each document with a term: its number of terms, and the query terms in it with their counts."""
    number = held.value.vocabulary.get
    for batch in batches:
        at, size, terms, counts = [], [], [], []
        for i, text in enumerate(texts_of(batch.column("text"))):
            n, own = 0, Counter()
            for found in term_lists(text, ALNUM):
                n += len(found)
                own.update(map(number, found))
            if n:
                own.pop(None, None)
                at.append(i)
                size.append(n)
                terms.append(list(own))
                counts.append(list(own.values()))
        columns = [batch.column("doc_id").take(pa.array(at, pa.int32())), pa.array(size, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])


def _frequencies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term, 0 for one that no document holds."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)


def length_terms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    share = LENGTH_SHARE * n_docs
    if len(n) and int(n.max()) * share >= 1 << 63:
        return np.array([100 - LENGTH_SHARE + share * int(x) // n_terms for x in n], np.int64)
    return 100 - LENGTH_SHARE + share * n // n_terms


class Block:
    """Documents laid out by query term: the rows that hold it, and what it adds to each of them."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, starts: np.ndarray, length: np.ndarray):
        self.n = len(starts) - 1
        rows = np.repeat(np.arange(self.n), np.diff(starts))
        order = np.argsort(terms, kind="stable")
        self.rows = rows[order]
        tf = counts[order]
        self.gain = SHARE * tf // (1000 * tf + 8 * length[self.rows])
        self.terms, first = np.unique(terms[order], return_index=True)
        self.ends = np.append(first, len(order))
        self.best = np.maximum.reduceat(self.gain, first) if len(first) else np.zeros(0, np.int64)

    def of(self, terms: np.ndarray) -> np.ndarray:
        """Position of each term in the block, -1 if no document holds it."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def masks(self, at: np.ndarray) -> np.ndarray:
        """For each document the bits of the terms at ``at`` it holds, 64 to a word."""
        words = np.zeros((self.n, -(-len(at) // 64)), np.uint64)
        for bit, t in enumerate(at):
            words[self.rows[self.ends[t] : self.ends[t + 1]], bit // 64] |= np.uint64(1 << (bit % 64))
        return words

    def scores(self, documents: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of documents that hold all terms at ``at``."""
        total = np.zeros(len(documents), np.int64)
        for t, w in zip(at, weight):
            a, b = self.ends[t], self.ends[t + 1]
            total += w * self.gain[a + np.searchsorted(self.rows[a:b], documents)]
        return total


SHARE = 1_000_000_000


def grouped(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents with a bit set, ordered by mask; where each group starts (one more entry than groups); the masks as bits."""
    documents = np.flatnonzero(words.any(axis=1))
    own = words[documents]
    order = np.lexsort(own.T)
    own, documents = own[order], documents[order]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]).any(axis=1)))) if len(own) else np.zeros(0, np.int64)
    bits = np.unpackbits(np.ascontiguousarray(own[first]).view(np.uint8), axis=1, bitorder="little")
    return documents, np.append(first, len(documents)), bits


def search_block(block: Block, doc_ids: np.ndarray, terms: np.ndarray, weight: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (doc_id, score) of ``best`` and the block's documents for one item.

    ``doc_ids`` must not hold a null: a document without an id has the largest long.
    """
    at = block.of(terms)
    use = (at >= 0) & (weight > 0)
    at, weight = at[use], weight[use]
    if not len(at):
        return best
    documents, ends, bits = grouped(block.masks(at))
    bound = bits[:, : len(at)].astype(np.int64) @ (weight * block.best[at])
    for g in np.argsort(-bound, kind="stable"):
        if len(best[1]) == k and bound[g] < best[1][-1]:
            break
        own = np.sort(documents[ends[g] : ends[g + 1]])
        has = np.flatnonzero(bits[g, : len(at)])
        score = block.scores(own, at[has], weight[has])
        ids, score = np.concatenate([best[0], doc_ids[own[score > 0]]]), np.concatenate([best[1], score[score > 0]])
        order = np.lexsort((ids, -score))[:k]
        best = ids[order], score[order]
    return best


NO_ID = np.iinfo(np.int64).max


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """doc_id, n, terms, counts and starts of documents that share about BLOCK_ENTRIES terms with the items."""
    for batch in batches:
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
        sizes = batch.column("terms").value_lengths().to_numpy()
        starts = np.concatenate(([0], np.cumsum(sizes)))
        terms, counts = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
        n, a = batch.column("n").to_numpy(), 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + BLOCK_ENTRIES, "right")) - 1)
            s = slice(starts[a], starts[b])
            yield ids[a:b], n[a:b], terms[s], counts[s], starts[a : b + 1] - starts[a]
            a = b


def _search(batches: Iterator[pa.RecordBatch], held, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    items = held.value.items
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
    for ids, n, terms, counts, starts in _blocks(batches):
        block = Block(terms, counts, starts, length_terms(n, n_docs, n_terms))
        best = [search_block(block, ids, own, weight[own] * repeats, b, k) for (_, own, repeats), b in zip(items, best)]
    number = np.repeat(np.array([i for i, _, _ in items], np.int64), [len(b[0]) for b in best])
    ids, scores = (np.concatenate([b[x] for b in best]) if best else np.zeros(0, np.int64) for x in (0, 1))
    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], ["item", "doc_id", "score"])


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item with a score above 0.

    ``docs`` has doc_id and text, ``items`` has item_id and text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered = stage(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")), "items")
    asked = stage(numbered.mapInArrow(_item_terms, "item long, terms array<binary>, repeats array<long>").where(F.size("terms") > 0), "asked")
    n_blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for part in range(n_blocks):
        own = Items.of(asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == part).orderBy("item").collect())
        if not own.items:
            continue
        held = spark.sparkContext.broadcast(own)
        matched = stage(docs.mapInArrow(lambda it, h=held: _matches(it, h), "doc_id long, n long, terms array<int>, counts array<long>"), "matched")
        n_docs, n_terms = matched.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        size = len(own.vocabulary)
        df = np.zeros(size, np.int64)
        for r in matched.select("terms").mapInArrow(lambda it, n=size: _frequencies(it, n), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        weight = weights(df, n_docs)
        search = lambda it, h=held, w=weight, n=n_docs, m=n_terms: _search(it, h, w, n, m, k)
        found = found.union(matched.mapInArrow(search, "item long, doc_id long, score long"))
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
