"""Exact duplicates: the directory, collision chains, heavy groups and odd rows against plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from mixedframe.llm import exact_dedup
from mixedframe.llm.exact_dedup import DEEPEST, Directory, exact_duplicates

SCHEMA = "doc_id long, text string, keep_id string, bucket string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(FOLD)].append(doc_id)
    out = []
    for doc_id, text in rows:
        folded = (text or "").translate(FOLD)
        keep = max((i for i in groups[folded] if i is not None), default=None)
        out.append((doc_id, keep, len(groups[folded]), doc_id == keep, hashlib.sha256(folded.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "k", "b") for i, t in rows], SCHEMA).repartition(parts)


def odd_rows():
    rows = [(i, f"Text Number {i % 40}") for i in range(300)]
    rows += [(1000 + i, "the same everywhere") for i in range(400)]
    rows += [(2000, None), (2001, ""), (2002, "ÄÖ É"), (2003, "äö é"), (2004, "ABC ä"), (2005, "abc ä"), (2006, " "), (2007, "a\x00b"), (2008, "A\x00B")]
    rows += [(None, "Text number 7"), (None, "only without id"), (None, "ONLY without id"), (1399, "the same everywhere"), (3000, "x" * 300_000), (3001, "X" * 300_000), (3002, "x" * 299_999 + "y")]
    return rows


@pytest.mark.parametrize("key_bits,room", [(64, exact_dedup.ROOM), (64, 200), (3, 200), (1, 1 << 30)])
def test_groups_are_those_of_equal_texts(spark, key_bits, room):
    """Short keys put different texts in one chain; small buckets are split many times."""
    rows = odd_rows()
    assert rows_of(exact_duplicates(table(spark, rows), room, key_bits)) == brute(rows)


def test_heavy_groups_and_the_rest_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY", 3)
    rows = odd_rows()
    assert rows_of(exact_duplicates(table(spark, rows))) == brute(rows)


def test_texts_that_outgrow_a_task_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD", 2000)
    rows = odd_rows()
    assert rows_of(exact_duplicates(table(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert rows_of(exact_duplicates(table(spark, []))) == []


def test_index_entries_chain_texts_of_one_key(spark):
    rows = table(spark, [(i, f"t{i % 9}") for i in range(30)]).select("doc_id", "text")
    keyed = rows.mapInArrow(lambda it: exact_dedup._keyed(it, 1), "doc_id long, key long, digest binary, n_bytes long")
    index = exact_dedup.build_index(rows, keyed, key_bits=1).collect()
    assert len(index) == 9 and len({r.key for r in index}) == 2
    for key in {r.key for r in index}:
        own = sorted(r.place for r in index if r.key == key)
        assert own == list(range(len(own)))
    assert sum(r.group_size for r in index) == 30


def test_directory_doubles_and_splits_only_overfull_buckets():
    weights = np.zeros(1024, np.int64)
    weights[:8] = 100  # all weight in one corner
    weights[700] = 50
    d = Directory()
    assert d.split_overfull(weights, 10, 250) == []
    assert d.depth == 9 and len(d.slots) == 512
    keys = (np.arange(1024, dtype=np.uint64) << np.uint64(54)).view(np.int64)
    held = np.bincount(d.bucket_of(keys), weights, minlength=len(d.local))
    assert held.max() <= 250 and held.sum() == weights.sum()
    # slots of one bucket stand side by side, as many as its bits say
    for bucket, (start, local) in enumerate(zip(d.start, d.local)):
        own = np.flatnonzero(d.slots == bucket)
        assert len(own) == 1 << (d.depth - local) and own[0] == start >> (DEEPEST - d.depth) and np.all(np.diff(own) == 1)


def test_directory_asks_for_more_bits_where_a_bucket_stays_overfull():
    weights = np.zeros(1024, np.int64)
    weights[5] = 1000
    d = Directory()
    stuck = d.split_overfull(weights, 10, 100)
    assert len(stuck) == 1 and d.local[stuck[0]] == 10
    finer = np.zeros(1 << 20, np.int64)
    finer[5 << 10 : 6 << 10] = 1000 / 1024
    finer[5 << 10] += 1000 - finer.sum()
    d.split_overfull(finer, 20, 100)
    assert d.depth > 10
