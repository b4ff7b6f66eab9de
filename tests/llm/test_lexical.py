"""Ranked lexical search against plain Python, and what the masks leave unread."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from mixedframe.llm import lexical_search
from mixedframe.llm.lexical_search import Block, grouped, length_terms, ranked_documents, search_block

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(4),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int").repartition(2),
    )


def corpus(n=400):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)] + ["Été", "naïve", "x9", "THE"]
    pick = lambda m: " ".join(words[int(x)] for x in rng.random(m) ** 2 * len(words))
    docs = [(i, pick(int(rng.integers(0, 80))) + (" the" if i % 5 else "")) for i in range(n)]
    docs += [(1000, None), (1001, " .,!"), (None, pick(30)), (None, docs[3][1]), (1002, docs[3][1]), (1003, docs[3][1]), (5, docs[9][1]), (1004, "w5 " * 5000)]
    items = [(i, pick(int(rng.integers(1, 30)))) for i in range(25)]
    items += [(100, None), (101, "unknown words"), (102, "the The THE"), (103, " ".join(words) + " " + " ".join(words[:40])), (104, docs[3][1]), (105, "w5 w5")]
    return docs, items


@pytest.mark.parametrize("terms,entries", [(lexical_search.BLOCK_TERMS, lexical_search.BLOCK_ENTRIES), (90, 40)])
def test_best_documents_of_all_items(spark, monkeypatch, terms, entries):
    """Also with several passes over the documents and small blocks."""
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", terms)
    monkeypatch.setattr(lexical_search, "BLOCK_ENTRIES", entries)
    docs, items = corpus()
    assert rows_of(ranked_documents(*tables(spark, docs, items))) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(20)
    assert rows_of(ranked_documents(*tables(spark, [], items))) == []
    assert rows_of(ranked_documents(*tables(spark, docs, []))) == []
    assert rows_of(ranked_documents(*tables(spark, [(1, None), (2, "")], items))) == []


def test_repeated_items_and_a_common_word(spark):
    docs = [(i, "a b" if i else "a") for i in range(30)]
    items = [(1, "a b"), (1, "a b"), (2, "a")]
    assert rows_of(ranked_documents(*tables(spark, docs, items))) == brute(docs, items)


def block_of(rng, n=5000, terms=40):
    dense = (rng.random((n, terms)) < rng.random(terms) * 0.3) * rng.integers(1, 6, (n, terms))
    rows, cols = np.nonzero(dense)
    starts = np.searchsorted(rows, np.arange(n + 1))
    return dense, Block(cols, dense[rows, cols], starts, rng.integers(25, 300, n))


def test_groups_share_a_mask_and_cover_all_documents_found():
    dense, block = block_of(np.random.default_rng(3), 500, 70)
    at = block.of(np.arange(70))
    documents, ends, bits = grouped(block.masks(at))
    assert sorted(documents) == np.flatnonzero(dense.any(axis=1)).tolist()
    for g in range(len(ends) - 1):
        for d in documents[ends[g] : ends[g + 1]]:
            assert (dense[d] > 0).tolist() == bits[g, :70].astype(bool).tolist()


def test_masks_are_read_by_descending_bound_and_the_rest_stays_unread():
    rng = np.random.default_rng(5)
    dense, block = block_of(rng)
    weight = rng.integers(1, 4000, 40)
    read = []
    scores = Block.scores

    def counting(self, documents, at, w):
        read.append(len(documents))
        return scores(self, documents, at, w)

    Block.scores = counting
    try:
        none = np.zeros(0, np.int64)
        ids, found = search_block(block, np.arange(5000), np.arange(40), weight, (none, none), 10)
    finally:
        Block.scores = scores
    gain = np.zeros((5000, 40), np.int64)
    for i, t in enumerate(block.terms):
        a, b = block.ends[i], block.ends[i + 1]
        gain[block.rows[a:b], t] = block.gain[a:b]
    want = gain @ weight
    order = np.lexsort((np.arange(5000), -want))[:10]
    assert ids.tolist() == order.tolist() and found.tolist() == want[order].tolist()
    assert sum(read) < 0.5 * np.count_nonzero(dense.any(axis=1))


def test_length_beyond_64_bits():
    n = np.array([3, 10**9])
    assert length_terms(n, 10**11, 7 * 10**13).tolist() == [25 + 75 * int(x) * 10**11 // (7 * 10**13) for x in n]
