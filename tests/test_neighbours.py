"""The neighbour join against brute force, on data with copies, clusters and small blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mixedframe.operators.impute import knn_impute, knn_impute_cv
from mixedframe.operators.neighbours import Cells, NeighbourIndex, knn_classify, knn_join, nearest, vote
from mixedframe.models.evaluate import regression_metrics


def brute(queries, refs, k, same=False):
    d = np.sqrt(((queries[:, None] - refs[None]) ** 2).sum(-1))
    if same:
        np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


def cloud(n, dims, seed, copies=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + 8 * rng.integers(0, 3, size=(n, 1))
    x = np.round(x, 1 if dims <= 2 else 3)
    if copies:
        x[: n // 3] = x[0]
    return x


def frame(spark, x, **extra):
    cols = {f"f{i}": x[:, i] for i in range(x.shape[1])}
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), **cols, **extra}))


@pytest.mark.parametrize("dims,pivots,blocks", [(2, None, (8192, 16384)), (2, 40, (30, 50)), (6, 25, (64, 64))])
def test_self_join_is_exact(spark, dims, pivots, blocks):
    x = cloud(700, dims, dims)
    df = frame(spark, x)
    out = knn_join(df, df, "id", [f"f{i}" for i in range(dims)], 5, exclude_self=True, pivots=pivots,
                   block_refs=blocks[0], block_queries=blocks[1]).toPandas().sort_values(["id", "rank"])
    want, d = brute(x, x, 5, same=True)
    assert out["ref_key"].to_numpy().reshape(-1, 5).tolist() == want.tolist()
    assert out["distance"].to_numpy() == pytest.approx(np.take_along_axis(d, want, 1).ravel())


def test_exact_far_from_the_origin(spark):
    # large coordinates and tiny gaps: pruning bounds must allow for rounding
    rng = np.random.default_rng(5)
    x = 1e6 + np.round(rng.normal(size=(500, 2)), 3)
    df = frame(spark, x)
    out = knn_join(df, df, "id", ["f0", "f1"], 3, exclude_self=True, pivots=60, block_refs=50).toPandas()
    want, _ = brute(x, x, 3, same=True)
    assert out.sort_values(["id", "rank"])["ref_key"].to_numpy().reshape(-1, 3).tolist() == want.tolist()


def test_two_tables_and_payload(spark):
    refs, queries = cloud(400, 3, 1), cloud(150, 3, 2, copies=False)
    r = frame(spark, refs, y=np.arange(400) * 2.0)
    out = knn_join(frame(spark, queries), r, "id", ["f0", "f1", "f2"], 4, payload=["y"], pivots=15, block_refs=40)
    out = out.toPandas().sort_values(["id", "rank"])
    want, _ = brute(queries, refs, 4)
    assert out["ref_key"].to_numpy().reshape(-1, 4).tolist() == want.tolist()
    assert (out["y"] == out["ref_key"] * 2.0).all()


def test_fewer_references_than_k_and_incomplete_rows(spark):
    refs = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None)], "id long, f double")
    queries = spark.createDataFrame([(9, 0.2), (8, None)], "id long, f double")
    got = knn_join(queries, refs, "id", ["f"], 5).orderBy("id", "rank").collect()
    # a query without a complete vector stays, without a neighbour
    assert [(r.id, r.ref_key, r["rank"]) for r in got] == [(8, None, None), (9, 1, 1), (9, 2, 2)]
    labelled = refs.withColumn("l", F.lit("x"))
    assert {r.id: r.prediction for r in knn_classify(labelled, queries, "id", ["f"], "l", 2).collect()} == {8: None, 9: "x"}
    assert [r.ref_key for r in knn_join(queries, refs.where("false"), "id", ["f"], 5).collect()] == [None, None]


def test_visited_share_falls_with_the_table(spark):
    share = {}
    for n in (500, 8000):
        x = cloud(n, 3, 4, copies=False)
        index = NeighbourIndex("id", ["f0", "f1", "f2"], 5).fit(frame(spark, x))
        d = np.sort(np.sqrt(((x[:100, None] - x[None]) ** 2).sum(-1)), axis=1)[:, 4]
        seen = sum(len(c) for _, c in index.cells.others(x[:100], d, 5)) + sum(len(c) for _, c in index.cells.home(x[:100], 5))
        share[n] = seen / 100 / len(index.cells.pivots)
    assert share[8000] < 0.5 * share[500]


def test_even_vectors_of_many_dimensions_visit_groups_of_cells(spark):
    x = np.random.default_rng(8).normal(size=(1500, 24))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>").repartition(4)
    index = NeighbourIndex("id", "v", 5, exclude_self=True, block_refs=200, block_queries=300).fit(df)
    want, d = brute(x, x, 5, same=True)
    got = index.join(df, "id").toPandas().sort_values(["id", "rank"])
    assert got["ref_key"].to_numpy().reshape(-1, 5).tolist() == want.tolist()
    bound = np.sort(d, axis=1)[:100, 4]
    groups = index.cells.grouped(x[:100], bound, 6)
    visits = lambda g: sum(len(row) for row, _ in index.cells.others(x[:100], bound, 6, g)) / 100
    assert visits(None) > 30 and visits(groups) <= 16
    flat = NeighbourIndex("id", ["a", "b"], 5).fit(frame(spark, x[:, :2]).toDF("id", "a", "b"))
    assert flat.cells.grouped(x[:100, :2], np.full(100, 0.1), 5) is None


def test_nearest_equals_brute_force_far_out_in_groups_and_within_bounds():
    rng = np.random.default_rng(9)
    x = 1e7 + np.round(rng.normal(size=(5000, 3)), 2)
    x[7] = np.inf
    fold = np.array([str(i % 3) for i in range(len(x))], object)
    with np.errstate(invalid="ignore"):
        d = np.sqrt(((x[:300, None] - x[None]) ** 2).sum(-1))
    d[(fold[:300, None] == fold[None]) | ~np.isfinite(d)] = np.inf
    bounds = np.sort(d, axis=1)[:, 2]
    row, col, dist = (np.concatenate(p) for p in zip(*nearest(x[:300], x, 6, apart=(fold[:300], fold), bounds=bounds)))
    order = np.argsort(d, axis=1, kind="stable")[:, :6]
    want = [(i, int(j)) for i in range(300) for j in order[i] if d[i, j] <= bounds[i] and np.isfinite(d[i, j])]
    assert list(zip(row.tolist(), col.tolist())) == want and dist == pytest.approx([d[w] for w in want])


@pytest.mark.parametrize("cells", [1, 700, 65_536])
def test_matrices_of_bounds_are_small(cells):
    index = Cells(np.zeros((cells, 2)), *np.zeros((3, cells)))
    assert 1 <= index._chunk() and index._chunk() * cells <= 262_144


def test_rows_of_one_fold_are_no_neighbours(spark):
    x = cloud(300, 2, 3)
    fold = np.arange(300) % 5
    df = frame(spark, x, fold=fold)
    index = NeighbourIndex("id", ["f0", "f1"], 4, apart="fold", pivots=12, block_refs=40, block_queries=60).fit(df)
    got = index.join(df, "id").toPandas().sort_values(["id", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d[fold[:, None] == fold[None]] = np.inf
    assert got["ref_key"].to_numpy().reshape(-1, 4).tolist() == np.argsort(d, axis=1, kind="stable")[:, :4].tolist()


def test_vote_tie_breaks(spark):
    refs = spark.createDataFrame([(1, 1.0, "far"), (2, -0.5, "near"), (3, 1.1, "far"), (4, -0.6, "near")], "id long, f double, l string")
    queries = spark.createDataFrame([(9, 0.0)], "id long, f double")
    assert knn_classify(refs, queries, "id", ["f"], "l", 4).first().prediction == "near"


def test_vote_is_taken_once_for_equal_queries(spark):
    df = frame(spark, np.repeat(cloud(60, 2, 5, copies=False), 4, axis=0), y=np.array(list("abc") * 80), fold=np.arange(240) % 2)
    index = NeighbourIndex("id", ["f0", "f1"], 5, ["y"], apart="fold").fit(df)
    want = {(r.id, r.p) for r in vote(index.join(df, "id"), "id", "y", "p").collect()}
    got = index.classify(df, "id", "y", "p", ["fold"]).collect()
    assert {(r.id, r.p) for r in got} == want and len(got) == 240 and all(r.fold == r.id % 2 for r in got)


def test_nearest_prefers_earlier_reference_on_ties():
    refs = np.zeros((6, 2))
    row, col, dist = (np.concatenate(p) for p in zip(*nearest(np.zeros((2, 2)), refs, 3)))
    assert row.tolist() == [0, 0, 0, 1, 1, 1] and col.tolist() == [0, 1, 2, 0, 1, 2] and not dist.any()


def test_impute_uses_each_rows_own_place(spark):
    x = cloud(300, 2, 7)
    y = np.where(np.arange(300) % 4 == 0, 0.0, x[:, 0] + 20)
    df = frame(spark, x, y=y)
    got = knn_impute(df, "id", ["f0", "f1"], "y", 5).orderBy("id").toPandas()
    known = np.flatnonzero(y != 0)
    want, _ = brute(x[y == 0], x[known], 5)
    assert got["imputed"].to_numpy()[y == 0] == pytest.approx(y[known][want].mean(axis=1))
    assert (got["imputed"].to_numpy()[known] == y[known]).all() and len(got) == 300


def test_impute_cross_validation(spark):
    x = cloud(240, 2, 9, copies=False)
    df = frame(spark, x, y=x[:, 0] + x[:, 1])
    held_out = knn_impute_cv(df, "id", ["f0", "f1"], "y", ks=(3, 5), folds=2)
    quality = {r.k: r for r in regression_metrics(held_out, "pred", "obs", ["k"]).collect()}
    assert set(quality) == {3, 5} and all(r.n == 240 and r.r2 > 0.9 for r in quality.values())
