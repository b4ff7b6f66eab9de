"""Exact duplicates through an extendible-hash index in the shared folder.

A document's key is the start of its digest, its address in the index the key's leading bits.
The directory has 2**depth slots, each naming a bucket; while a bucket holds more bytes of
different texts than it has room for it is split by one more bit of the key, and where it is
as deep as the directory the directory doubles. The directory is built from a histogram of
key prefixes, ten bits ahead at a time, before any text moves.

Then every task folds the equal texts it meets (so that a text which a third of all rows
share is one record a task), and records go to the owner of their bucket. An owner reads its
buckets, which are ranges of keys, in the order of the keys; texts of one key form a chain in
which they are told apart by their bytes. The entries (bucket, key, place in the chain, group
size, largest doc_id, digest) are the index, written to the shared folder. Documents find
their entry by key and digest: the few groups that hold more than a ``HEAVY``-th of all rows
(fewer than ``HEAVY`` of them) by a broadcast, all others by a shuffle.

Bounds: a directory has at most 2**20 slots, as buckets get more room in a table too large
for ``BUCKETS`` of them; a task holds ``HELD`` bytes of folded texts, an owner one chain.

Defined cases: a null text counts as empty; a text of any length is compared whole; a row
with a null doc_id takes part and counts in its group, and is kept only where no row of the
group has a doc_id (keep_id is null then); rows that repeat the largest doc_id with an equal
text all stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .terms import texts_of

ROOM = 8 << 20
BUCKETS = 1 << 18
AHEAD, DEEPEST = 10, 20
HELD = 32 << 20
HEAVY = 4096
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class Directory:
    """Slots of an extendible-hash directory; the slots of a bucket stand side by side."""

    def __init__(self) -> None:
        self.depth = 0
        self.slots = np.zeros(1, np.int32)
        self.start, self.local = [0], [0]  # of each bucket: first key prefix (in DEEPEST bits), bits it is told by

    def _double(self) -> None:
        self.slots = np.repeat(self.slots, 2)
        self.depth += 1

    def split(self, bucket: int) -> int:
        """Move the upper half of a bucket's range to a new bucket."""
        if self.local[bucket] == self.depth:
            self._double()
        self.local[bucket] += 1
        half = self.start[bucket] + (1 << (DEEPEST - self.local[bucket]))
        new = len(self.local)
        self.start.append(half)
        self.local.append(self.local[bucket])
        at = half >> (DEEPEST - self.depth)
        self.slots[at : at + (1 << (self.depth - self.local[new]))] = new
        return new

    def split_overfull(self, weights: np.ndarray, bits: int, room: int) -> list[int]:
        """Split while a bucket weighs more than ``room``, by weights of all prefixes of ``bits`` bits.

        Returns the buckets for which more bits are needed.
        """
        sums = np.concatenate(([0], np.cumsum(weights)))
        stuck, todo = [], list(range(len(self.local)))
        while todo:
            bucket = todo.pop()
            first = self.start[bucket] >> (DEEPEST - bits)
            if sums[first + (1 << (bits - self.local[bucket]))] - sums[first] <= room:
                continue
            if self.local[bucket] == bits:
                stuck.append(bucket)
            else:
                todo += [bucket, self.split(bucket)]
        return stuck

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(keys), np.int32)
        return self.slots[keys.view(np.uint64) >> np.uint64(64 - self.depth)]


def build_directory(rows: DataFrame, room: int = ROOM) -> Directory:
    """The directory for a table (key, n_bytes), in which a key that occurs often counts once."""
    keys = rows.groupBy("key").agg(F.max("n_bytes").alias("n_bytes"))
    directory, bits = Directory(), 0
    while bits < DEEPEST:
        bits += AHEAD
        slot = F.shiftrightunsigned("key", 64 - bits)
        found = keys.groupBy(slot.alias("slot")).agg(F.sum("n_bytes").alias("n")).collect()
        weights = np.zeros(1 << bits, np.int64)
        weights[[r.slot for r in found]] = [r.n for r in found]
        if not directory.split_overfull(weights, bits, max(room, int(weights.sum()) // BUCKETS)):
            break
    return directory


def _digest(text: bytes, key_bits: int) -> tuple[int, bytes]:
    whole = hashlib.sha256(text).digest()
    key = int.from_bytes(whole[:8], "big") >> (64 - key_bits) << (64 - key_bits)
    return key - (1 << 64) if key >> 63 else key, whole


def _keyed(batches: Iterator[pa.RecordBatch], key_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.translate(FOLD) for t in texts_of(batch.column("text"))]
        found = [_digest(t, key_bits) for t in texts]
        columns = [batch.column("doc_id"), pa.array([k for k, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "digest", "n_bytes"])


RECORD = "bucket int, key long, digest binary, text binary, n long, last long"


def _fold(batches: Iterator[pa.RecordBatch], directory, key_bits: int) -> Iterator[pa.RecordBatch]:
    """Equal texts of a task as one record with their number and largest doc_id."""
    own = directory.value
    seen: dict[bytes, list] = {}
    held = 0

    def folded() -> pa.RecordBatch:
        keys, digests, n, last = ([x[i] for x in seen.values()] for i in range(4))
        keys = np.array(keys, np.int64)
        columns = [pa.array(own.bucket_of(keys)), pa.array(keys), pa.array(digests, pa.binary()), pa.array(list(seen), pa.binary()), pa.array(n, pa.int64()), pa.array(last, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "key", "digest", "text", "n", "last"])

    for batch in batches:
        for text, doc_id in zip(texts_of(batch.column("text")), batch.column("doc_id").to_pylist()):
            text = text.translate(FOLD)
            entry = seen.get(text)
            if entry is None:
                seen[text] = [*_digest(text, key_bits), 1, doc_id]
                held += len(text) + 300
                if held > HELD:
                    yield folded()
                    seen.clear()
                    held = 0
            else:
                entry[2] += 1
                entry[3] = _later(entry[3], doc_id)
    if seen:
        yield folded()


def _later(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


ENTRY = "bucket int, key long, place int, digest binary, n_bytes long, group_size long, keep_id long"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries from records in the order of their keys: one for each different text of a key."""
    names = [f.split()[0] for f in ENTRY.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    out: list[tuple] = []
    at, chain = None, []

    def close() -> None:
        out.extend((*at, place, digest, len(text), n, last) for place, (text, digest, n, last) in enumerate(chain))

    def batch_of() -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    for batch in batches:
        for bucket, key, digest, text, n, last in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "digest", "text", "n", "last"))):
            if at != (bucket, key):
                close()
                at, chain = (bucket, key), []
                if len(out) > 10_000:
                    yield batch_of()
                    out.clear()
            for entry in chain:
                if entry[0] == text:
                    entry[2] += n
                    entry[3] = _later(entry[3], last)
                    break
            else:
                chain.append([text, digest, n, last])
    close()
    yield batch_of()


def build_index(docs: DataFrame, rows: DataFrame, room: int = ROOM, key_bits: int = 64) -> DataFrame:
    """The entries of the index, read from the shared folder, for ``docs`` with the keys in ``rows``."""
    directory = docs.sparkSession.sparkContext.broadcast(build_directory(rows, room))
    records = docs.mapInArrow(lambda it: _fold(it, directory, key_bits), RECORD)
    owned = records.repartition("bucket").sortWithinPartitions("bucket", "key")
    return stage(owned.mapInArrow(_chained, ENTRY), "index")


def exact_duplicates(docs: DataFrame, room: int = ROOM, key_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of a group the row with the
    largest doc_id stays. ``key_bits`` below 64 leaves shorter keys and longer chains.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stage(docs.mapInArrow(lambda it: _keyed(it, key_bits), "doc_id long, key long, digest binary, n_bytes long"), "keys")
    index = build_index(docs, rows, room, key_bits).select("key", "digest", "group_size", "keep_id")
    total = rows.count()
    rows, on = rows.drop("n_bytes"), ["key", "digest"]
    is_heavy = F.col("group_size") * HEAVY > total
    heavy = F.broadcast(index.where(is_heavy))
    rest = rows.join(heavy.select(*on), on, "left_anti").join(index.where(~is_heavy), on)
    found = rows.join(heavy, on).select(*rest.columns).union(rest)
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
