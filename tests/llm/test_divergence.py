"""Source divergence against plain Python, and the sparse merge against dense arrays."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mixedframe.llm import divergence
from mixedframe.llm.divergence import gallop, merge, pack_counts, shares, source_divergence, unpack_counts

SCHEMA = "doc_id long, text string, lang string, source string, block string, value double"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows):
    docs = [(TERM.findall((text or "").translate(FOLD)), lang or "", source or "") for text, lang, source in rows]
    df, counts, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for terms, lang, source in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
        langs[lang].update(terms)
    out = []
    for lang, source in sorted(counts):
        kept = sorted((t for t, n in df[lang].items() if n >= 3), key=lambda t: t.encode())

        def p(held, kept=kept):
            total = sum(held[t] for t in kept)
            return {t: 1 + 10**9 * (held[t] + 1) // (total + len(kept)) for t in kept}

        own, f = p(counts[lang, source]), lambda x, y: (x - y) ** 2 // y
        pairs = []
        for other in (s for x, s in counts if x == lang and s != source):
            q = p(counts[lang, other])
            pairs.append((sum(f(own[t], q[t]) for t in kept), other))
        q = p(langs[lang])
        terms = [(f(own[t], q[t]), t) for t in kept if counts[lang, source][t] and own[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, n + 1) for n, (value, item) in enumerate(found[:most])]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "b", 1.0) for i, r in enumerate(rows)], SCHEMA).repartition(4)


def corpus():
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["été", "Straße", "naïve", "ÀB", "Zz"]
    rows = []
    for i in range(200):
        lang = ["en", "fr", None, "tiny"][i % 4 if i < 190 else 3]
        source = f"s{int(rng.integers(0, 5))}" if i % 7 else None
        n = int(rng.integers(0, 60)) if lang != "tiny" else 1
        rows.append((" ".join(words[int(x)] for x in (rng.random(n) ** 2 * len(words))) + (", Wab1wAB" if i % 3 else ""), lang, source))
    rows += [(None, "en", "empty"), ("", "fr", "s1"), ("12 34 !", "en", "digits"), ("rare words here", "lonely", "one"), (None, None, None)]
    return rows + rows[:10]


@pytest.mark.parametrize("block,held", [(divergence.BLOCK, divergence.HELD), (16, 20)])
def test_all_groups_against_plain_python(spark, monkeypatch, block, held):
    """Also with small blocks of terms, some of which a group lacks altogether, and counts passed on early."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = corpus()
    assert rows_of(source_divergence(table(spark, rows))) == brute(rows)


def test_only_the_best_ranks_of_terms(spark):
    rows = [(f"{'aa ' * 3} {chr(97 + i % 8)}x {chr(97 + i % 5)}y", "en", f"s{i % 3}") for i in range(60)]
    got = rows_of(source_divergence(table(spark, rows), ranks=2))
    assert got == [r for r in brute(rows) if r[2] == "pair" or r[5] <= 2]


def test_long_text_and_empty_table(spark, monkeypatch):
    assert rows_of(source_divergence(table(spark, []))) == []
    from mixedframe.llm import terms

    monkeypatch.setattr(terms, "PIECE", 50)
    long = "word " * 1000 + "x" * 500 + " tail" * 100
    assert list(terms.term_lists(long.encode(), divergence.LETTERS))[0][0] == b"word"
    assert [t for part in terms.term_lists(long.encode(), divergence.LETTERS) for t in part] == [t.encode() for t in long.split()]
    rows = [(long, "en", s) for s in ("a", "b", "b")] + [("tail other", "en", "c")] * 3
    assert rows_of(source_divergence(table(spark, rows))) == brute(rows)


def test_merge_prices_overlaps_single_sides_and_both_ways():
    rng = np.random.default_rng(1)
    for size in (1, 5, 300, 5000):
        a, b = (np.sort(rng.choice(6000, n, replace=False)) for n in (size, 2000))
        na, nb = rng.integers(1, 50, len(a)), rng.integers(1, 50, len(b))
        dense_a, dense_b = np.zeros(6000, np.int64), np.zeros(6000, np.int64)
        dense_a[a], dense_b[b] = na, nb
        either = (dense_a + dense_b) > 0
        p, q = shares(dense_a[either], 90_000), shares(dense_b[either], 40_000)
        want = (int(((p - q) ** 2 // q).sum()), int(((p - q) ** 2 // p).sum()), int(either.sum()))
        assert merge((a, na), (b, nb), 90_000, 40_000) == want
        there, back, union = merge((b, nb), (a, na), 40_000, 90_000)
        assert (back, there, union) == want


def test_gallop_is_a_search():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (5, 0), (1, 10_000), (3000, 10_000), (10_000, 3)):
        few, many = np.sort(rng.integers(0, 50_000, n)), np.unique(rng.integers(0, 50_000, m))
        assert gallop(few, many, 100).tolist() == np.searchsorted(many, few).tolist()


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([0, 1, 10**12, 5 * 10**15], np.int64)
    total = 7 * 10**15 + 3
    assert shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_packed_counts_come_back():
    slots, counts = np.array([70_000, 3, 9]), np.array([1, 10**12, 255])
    got = unpack_counts(pack_counts(slots, counts), 3)
    assert got[0].tolist() == [3, 9, 70_000] and got[1].tolist() == [10**12, 255, 1]
