"""Near-duplicates against all pairs of word-shingle sets."""

import random
import re
import string

import pyarrow as pa
import pytest

from mixedframe.llm import text
from mixedframe.llm.components import components
from mixedframe.llm.neardup import near_duplicates

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def split(body):
    return re.findall(r"[^\x20\x09-\x0D]+", (body or "").translate(FOLD))


def shingles(body, size=5):
    words = split(body)
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def brute(rows):
    """doc_id -> (set size, smallest reachable id)."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def edited(words, rng, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, base = [], fresh(150)
    rows += [(i, " ".join(edited(base, rng, rng.randrange(0, 9)))) for i in range(100, 240)]  # a chain of near copies
    rows += [(i, " ".join(base).upper()) for i in range(300, 360)]  # exact copies but for case
    shared = fresh(40)
    rows += [(i, " ".join(fresh(20) + shared + fresh(20))) for i in range(400, 460)]  # a common passage
    short = ["a b c", "A B  C", "a b", "one two three four five", "one two three four five six", "x"]
    rows += [(500 + i, t) for i, t in enumerate(short)]
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, "é è"), (604, "É è")]
    rows += [(700 + i, " ".join(edited(fresh(60), rng, 0))) for i in range(30)]
    rng.shuffle(rows)
    return rows


def test_components_match_all_pairs(spark, corpus):
    docs = spark.createDataFrame([(i, t, "z", True, -1) for i, t in corpus], "doc_id long, text string, key string, kept boolean, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == brute(corpus)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    body = "one two three four five six seven"
    rows = [(None, body), (5, body), (5, body), (9, body), (3, "other words entirely in this one here")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [
        (-1, 3, -1, True), (3, 3, 3, True), (5, 3, 5, True), (5, 3, 5, True), (9, 3, 5, False),
    ]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1000, 1040)] + [(7, i) for i in range(8, 200)] + [(None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1000 for i in range(1000, 1041)}, **{i: 7 for i in range(7, 200)}}


@pytest.mark.parametrize("run", [16, 64, 1 << 20])
def test_words_do_not_depend_on_where_runs_are_cut(monkeypatch, run):
    rng = random.Random(2)
    texts = ["", None, "x" * 500, " ", "é ü", "a b"] + [" ".join(rng.choice(["Ab", "c", "é", "long" * 9]) for _ in range(rng.randrange(60))) for _ in range(50)]
    monkeypatch.setattr(text, "RUN", run)
    hashes, starts = text.words(pa.array(texts))
    known = {}
    for i, body in enumerate(texts):
        words = split(body)
        assert len(words) == starts[i + 1] - starts[i]
        for word, value in zip(words, hashes[starts[i] : starts[i + 1], 0]):
            assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)
    assert [len(s) for s in text.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


def test_an_id_with_two_texts_is_linked_through_the_one_that_counts(spark):
    """Of the rows of an id the longest counts: id 5 stands for A, so B and its near copy are linked without it."""
    words = [f"w{i}" for i in range(60)]
    a, b, more = " ".join(f"a{i}" for i in range(80)), " ".join(words[:40]), " ".join(words[:41])
    rows = [(5, a), (5, b), (9, b), (12, more), (20, a), (21, None), (21, ""), (None, b), (None, a)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {
        (5, 5, True), (9, 9, True), (12, 9, False), (20, 5, False), (21, 21, True), (None, None, True),
    }
    assert sorted(r.n_shingles for r in got if r.doc_id == 5) == [36, 76]
