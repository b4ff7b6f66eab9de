"""Softmax boosting against a plain numpy restatement, and its stored form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors

from mixedframe.models import boosting, features, scoring
from mixedframe.models.boosting import SoftmaxBooster, Tree, add_trees, grow_level, level_histogram
from mixedframe.models.features import FEATURES, INDEX, LABEL, SHARES
from mixedframe.sources import load_model, save_model


def data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    x = np.column_stack([rng.normal(size=n) + label, rng.normal(size=n) - 2 * (label == 1), np.round(rng.normal(size=n), 1), rng.integers(0, 2, n)])
    return x, label


@pytest.fixture(scope="module")
def vectors(spark):
    x, label = data()
    return spark.createDataFrame([(float(y), Vectors.dense(v)) for v, y in zip(x.tolist(), label.tolist())], [LABEL, FEATURES]).repartition(3).cache()


def restated(x, label, rounds, depth, eta, least=1.0, ridge=1.0):
    """Every split tried on every value by plain loops, all rows and columns in each round: log loss before each round, margins."""
    margins = np.zeros((len(x), label.max() + 1))
    losses = []
    for _ in range(rounds):
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(x)), label]).mean())
        add = np.zeros_like(margins)
        for k in range(margins.shape[1]):
            g, h = p[:, k] - (label == k), 2 * p[:, k] * (1 - p[:, k])

            def grow(rows, level):
                worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)  # noqa: B023, E731
                best = (1e-6, None)
                if level < depth:
                    for j in range(x.shape[1]):
                        for cut in np.unique(x[:, j])[:-1]:
                            left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                            if len(left) and len(right) and h[left].sum() >= least and h[right].sum() >= least:  # noqa: B023
                                gain = worth(left) + worth(right) - worth(rows)
                                if gain > best[0] + 1e-6:
                                    best = (gain, (left, right))
                if best[1] is None:
                    if level:
                        add[rows, k] = -g[rows].sum() / (h[rows].sum() + ridge) * eta  # noqa: B023
                    return
                for part in best[1]:
                    grow(part, level + 1)

            grow(np.arange(len(x)), 0)
        margins += add
    return np.array(losses), margins


def test_losses_and_shares_equal_a_restatement(spark):
    x, label = data(120, 5)
    x = np.round(x, 1)  # few values, so that each is a bin of its own
    df = spark.createDataFrame([(float(y), Vectors.dense(v)) for v, y in zip(x.tolist(), label.tolist())], [LABEL, FEATURES]).repartition(4)
    model = SoftmaxBooster(nrounds=10, max_depth=3, eta=0.3, colsample=1.0, subsample=1.0, bins=256).fit(df)
    losses, margins = restated(x, label, 10, 3, 0.3)
    assert model.losses == pytest.approx(losses, abs=1e-5)
    got = add_trees(np.zeros(margins.shape), x, model.rounds)
    assert got == pytest.approx(margins, abs=1e-3)
    assert all(a > b for a, b in zip(model.losses, model.losses[1:]))


def test_log_loss_falls_each_round_with_samples_of_rows_and_columns(vectors):
    model = SoftmaxBooster(nrounds=12, max_depth=3, eta=0.3).fit(vectors)
    assert len(model.losses) == 12 and all(a > b for a, b in zip(model.losses, model.losses[1:]))
    scored = model.transform(vectors).select(LABEL, INDEX, SHARES).toPandas()
    assert (scored[LABEL] == scored[INDEX]).mean() > 0.75
    assert np.stack([s.toArray() for s in scored[SHARES]]).sum(axis=1) == pytest.approx(1)
    assert model.featureImportances.toArray()[:2].sum() > 0.6


def test_partitions_and_margins_kept_do_not_change_the_trees(vectors, monkeypatch):
    make = lambda: SoftmaxBooster(nrounds=5, max_depth=2, subsample=1.0)
    want = make().fit(vectors)
    monkeypatch.setattr(boosting, "KEEP", 2)
    monkeypatch.setattr(boosting, "FAN_IN", 2)
    got = make().fit(vectors.repartition(9))
    for a, b in zip(want.rounds, got.rounds):
        for s, t in zip(a, b):
            assert s.feature.tolist() == t.feature.tolist() and s.cut.tolist() == t.cut.tolist()
            assert s.value == pytest.approx(t.value, abs=1e-6)


def test_columns_are_sampled_per_tree(vectors):
    model = SoftmaxBooster(nrounds=6, max_depth=3, colsample=0.25).fit(vectors)
    for trees in model.rounds:
        for tree in trees:
            assert len(set(tree.feature[tree.feature >= 0])) <= 1


def test_first_rounds_are_the_model_as_it_was(vectors):
    short, long = SoftmaxBooster(nrounds=3, max_depth=2).fit(vectors), SoftmaxBooster(nrounds=6, max_depth=2).fit(vectors)
    shares = lambda m: np.stack(m.transform(vectors).select(SHARES).toPandas()[SHARES].map(lambda s: s.toArray()))
    assert shares(long.first(3)) == pytest.approx(shares(short))


def test_saved_pipeline_scores_the_same(spark, tmp_path):
    x, label = data()
    frame = pd.DataFrame({"id": range(len(x)), "x": x[:, 0], "y": x[:, 1], "c": np.array(["u", "v"])[x[:, 3].astype(int)], "status": np.array(["p", "q", "r"])[label]})
    df = spark.createDataFrame(frame)
    model = features.fit_classifier(SoftmaxBooster(nrounds=4, max_depth=3), df, "status", ["x", "y", "c"], onehot=True)
    save_model(model, str(tmp_path / "m"))
    both = scoring.score_many({"a": model, "b": load_model(str(tmp_path / "m"))}, df, "id")
    assert both.count() == len(x) and both.filter("a <> b").count() == 0
    assert scoring.importance_table(spark, model).count() == 3


def test_histograms_are_exact_sums():
    rng = np.random.default_rng(0)
    bins, g = rng.integers(0, 8, (500, 3)).astype(np.uint8), rng.integers(-(1 << 24), 1 << 24, (500, 2))
    h = np.abs(g) + 1
    trees = [Tree.empty(2), Tree.empty(2)]
    trees[0].feature[0], trees[0].cut[0] = 1, 3
    got = level_histogram(bins, g, h, trees, 1, 8)
    side = (bins[:, 1] > 3).astype(int)
    for node in range(2):
        for j in range(3):
            for b in range(8):
                rows = (side == node) & (bins[:, j] == b)
                assert got[0, node, j, b].tolist() == [g[rows, 0].sum(), h[rows, 0].sum()]
    assert not got[1].any()


def test_no_gain_no_split():
    tree = Tree.empty(1)
    grow_level(tree, np.zeros((1, 2, 4, 2), np.int64), 0, np.array([0, 1]), 0.3, 0.0, 1.0)
    assert tree.feature[0] == -1 and not tree.value.any()


def test_nothing_to_learn_from(vectors):
    with pytest.raises(ValueError):
        SoftmaxBooster(nrounds=1).fit(vectors.where("1 = 0"))
