"""Vector searches against brute force on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixedframe.llm import forest_search
from mixedframe.llm.forest_search import Forest, nearest
from mixedframe.llm.topk_search import search_block, top_k

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, is_query, k, measure):
    out = []
    for q, x in rows:
        if is_query(q):
            scored = sorted((-measure(x, y), i) for i, y in rows if i != q and len(y) == len(x))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def odd_rows():
    """Copies, ties, nulls and broken vectors."""
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(300)]
    good += [(1000 + i, good[7][1]) for i in range(40)] + [(2000 + i, [0.5] * 8) for i in range(12)]
    bad = [(5000, None), (5001, [0.1] * 7 + [None]), (5002, [float("nan")] * 8), (5003, [float("inf")] + [0.0] * 7), (5004, []), (None, [0.1] * 8)]
    return good, bad


def integer_product(x, y):
    scale = lambda v: np.floor(256 * np.array(v, np.float64)).astype(np.int64)
    return int(scale(x) @ scale(y))


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)


def test_top_k_is_exact_with_copies_and_broken_vectors(spark):
    good, bad = odd_rows()
    other = [(7000, [0.3, 0.1]), (7050, [0.2, 0.4]), (7051, [0.1, 0.1])]
    got = rows_of(top_k(table(spark, good + bad + other + good[:5]), F.col("vec_id") % 50 == 0, 5))
    assert got == brute(good + other, lambda i: i % 50 == 0, 5, integer_product)


def test_top_k_keeps_large_components(spark):
    """Scores that leave 53 bits, 64 bits, and a long altogether; ties between wide vectors."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 0.2, 4).tolist()) for i in range(120)]
    rows += [(200 + i, (rng.normal(0, 1, 4) * 10.0 ** int(e)).tolist()) for i, e in enumerate(rng.integers(3, 14, 80))]
    rows += [(300, [70000.0, 1.0, 0.0, 0.0]), (350, [-1e300, 1e300, 1.0, 2.0]), (351, [1e300, 1e-3, 5.0, 0.5]), (352, [1e300, 1e-3, 5.0, 0.5]), (353, [1e308, 0.0, 0.0, 0.0])]
    rows += [(400, [70000.0, 1.0]), (401, [0.5, 2.0]), (402, [-3e9, 0.25])]
    usable = [r for r in rows if max(abs(x) for x in r[1]) * 256 < float("inf")]
    whole = lambda v: [int(np.floor(256 * x)) for x in v]
    exact = brute(usable, lambda i: i % 50 == 0, 5, lambda x, y: sum(a * b for a, b in zip(whole(x), whole(y))))
    shown = [(q, n, i, max(-(2**63), min(2**63 - 1, s))) for q, n, i, s in exact]
    got = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(top_k(got, F.col("vec_id") % 50 == 0, 5)) == shown
    assert (300, 1) in {r[:2] for r in shown} and len({r[0] for r in shown}) == 8


def test_top_k_of_few_rows_and_of_none(spark):
    two = [(0, [0.5, 0.5]), (50, [0.5, -0.5])]
    assert rows_of(top_k(table(spark, two), F.col("vec_id") % 50 == 0, 5)) == brute(two, lambda i: True, 5, integer_product)
    assert rows_of(top_k(table(spark, []), F.col("vec_id") % 50 == 0, 5)) == []


def test_exact_vectors_are_read_in_order_of_their_bound():
    rng = np.random.default_rng(1)
    exact = rng.integers(-100, 100, (4000, 16))
    low, width = exact.min(axis=0), np.full(16, 4)
    read = []

    class Counting(np.ndarray):
        def __getitem__(self, rows):
            read.append(len(rows))
            return np.asarray(self)[rows]

    queries = exact[:5]
    q, r, s = search_block(np.arange(4000), (exact - low) // 4, exact.view(Counting), low, width, np.arange(5), queries, 3)
    assert sum(read) < 0.2 * 5 * 4000
    for i in range(5):
        order = np.lexsort((np.arange(4000), -(exact @ exact[i])))
        assert r[q == i].tolist() == [j for j in order if j != i][:3]


def test_nearest_reads_everything_when_the_table_is_small(spark):
    good, bad = odd_rows()
    got = rows_of(nearest(table(spark, good + bad + [(6000, [0.0] * 8)]), F.col("vec_id") % 20 == 0, 20))
    want = brute(good, lambda i: i % 20 == 0, 20, lambda x, y: float((np.array(y) * np.array(x)).sum()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_nearest_serves_every_length(spark, monkeypatch):
    """A length with a forest of its own, another one, and two rare ones."""
    monkeypatch.setattr(forest_search, "LEAF_ROWS", 100)
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(300)] + [(i, rng.normal(0, 1, 5).tolist()) for i in range(300, 500)]
    rows += [(i, rng.normal(0, 1, 3).tolist()) for i in range(500, 530)] + [(540, [1.0]), (541, [2.0]), (560, [1.0] * 7)]
    got = rows_of(nearest(table(spark, rows), F.col("vec_id") % 20 == 0, 20))
    near = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    want = brute(near, lambda i: i % 20 == 0, 20, lambda x, y: float((np.array(y) * np.array(x)).sum()))
    assert len(got) == len(want) and {g[0] for g in got} == {w[0] for w in want} and 540 in {g[0] for g in got}
    assert [g[:3] for g in got if g[0] >= 500] == [w[:3] for w in want if w[0] >= 500]
    found = {g[:1] + g[2:3] for g in got}
    assert np.mean([w[:1] + w[2:3] in found for w in want]) >= 0.9


def test_nearest_of_an_empty_table(spark):
    assert rows_of(nearest(table(spark, []), F.col("vec_id") % 20 == 0)) == []


def test_nearest_finds_most_true_neighbours_beyond_one_leaf(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (40, 16))
    points = (centres[rng.integers(0, 40, 9000)] + rng.normal(0, 0.3, (9000, 16))).astype(np.float32)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    got = nearest(table(spark, rows), F.col("vec_id") % 180 == 0, 20).toPandas()
    exact = points.astype(float)
    hits = []
    for q, found in got.groupby("query_id")["vec_id"]:
        scores = exact @ exact[q]
        scores[q] = -np.inf
        hits.append(len(set(np.argsort(-scores)[:20]) & set(found)) / 20)
    assert len(hits) == 50 and np.mean(hits) >= 0.9


def test_nearest_keeps_its_recall_in_deep_trees_of_even_vectors(spark, monkeypatch):
    monkeypatch.setattr(forest_search, "LEAF_ROWS", 12)
    monkeypatch.setattr(forest_search, "LEAF_SAMPLE", 6)
    rng = np.random.default_rng(11)
    points = rng.normal(0, 1, (6000, 24))
    points = (points / np.linalg.norm(points, axis=1)[:, None]).astype(np.float32)
    assert Forest.fit(points.astype(float), 6000, 1.0, trees=1).depth == 9
    got = nearest(table(spark, [(i, p.tolist()) for i, p in enumerate(points)]), F.col("vec_id") % 100 == 0, 20).toPandas()
    exact = points.astype(float)
    hits = []
    for q, found in got.groupby("query_id")["vec_id"]:
        scores = exact @ exact[q]
        scores[q] = -np.inf
        hits.append(len(set(np.argsort(-scores)[:20]) & set(found)) / 20)
    assert len(hits) == 60 and np.mean(hits) >= 0.95


def test_keys_of_leaves_are_those_at_which_they_open():
    points = np.random.default_rng(4).normal(0, 1, (1000, 5))
    forest = Forest.fit(points, 20_000, float(np.linalg.norm(points, axis=1).max()), trees=3)
    keys = forest.keys(points[3])
    assert keys.shape == (3, 1 << forest.depth)
    assert all(keys[t, leaf] == key for t, leaf, key in forest.opened(points[3], np.inf))


def test_shared_queue_opens_leaves_in_order_of_their_margin():
    rng = np.random.default_rng(2)
    points = rng.normal(0, 1, (2000, 6))
    forest = Forest.fit(points, 40_000, float(np.linalg.norm(points, axis=1).max()), trees=3)
    assert forest.depth == 5
    keys = [(t, leaf, key) for t, leaf, key in forest.opened(points[0], np.inf)]
    assert len({k[:2] for k in keys}) == 3 * 32
    assert [k[2] for k in keys] == sorted(k[2] for k in keys)
    home = {(t, leaf) for t, leaf, key in keys if key == 0}
    own = np.append(points[0], 0.0)
    for t in range(3):
        node = 0
        while node < 31:
            node = 2 * node + 1 + (forest.directions[t, node] @ own > forest.thresholds[t, node])
        assert (t, node - 31) in home


@pytest.mark.parametrize("n", [0, 1, 5])
def test_forest_of_hardly_any_points(n):
    forest = Forest.fit(np.zeros((n, 3)), n, 1.0)
    assert forest.depth == 0 and list(forest.opened(np.ones(3), 0.0)) == [(t, 0, 0.0) for t in range(8)]
