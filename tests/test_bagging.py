"""Trees one by one: stored nodes, prefixes of a forest, bags and out-of-bag importance."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mixedframe.models import validate
from mixedframe.models.bagging import BaggedForest, times_drawn
from mixedframe.models.estimators import forest
from mixedframe.models.features import FEATURES, INDEX, LABEL, feature_pipeline
from mixedframe.models.trees import staged_predictions, trees_of

NAMES = ["x", "cat", "noise"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 500
    c = rng.integers(0, 3, n)
    frame = pd.DataFrame({"id": range(n), "status": np.array(["f", "r", "n"])[c], "x": rng.normal(size=n) + 1.5 * c, "cat": np.where(rng.random(n) < 0.7, np.array(["p", "q", "s"])[c], "t"), "noise": rng.normal(size=n)})
    return spark.createDataFrame(frame).repartition(3, "id").cache()


@pytest.fixture(scope="module")
def vectors(table):
    fitted = feature_pipeline(table, "status", NAMES).fit(table)
    return fitted.transform(table).select("id", LABEL, FEATURES).cache()


def test_stored_trees_predict_what_the_forest_predicts(spark, vectors):
    model = forest(15, 2, 6).fit(vectors)
    trees = trees_of(spark, model)
    assert len(trees) == 15 and any((t.category >= 0).any() for t in trees)
    got = staged_predictions(model, model.transform(vectors), [15])
    assert got.where(F.col("staged")[15] != F.col(INDEX)).count() == 0


def test_prefixes_equal_forests_of_the_first_trees(spark, vectors):
    model = forest(12, 2, 5).fit(vectors)
    counts = [1, 3, 5, 8, 12]
    staged = staged_predictions(model, vectors, counts).select("id", "staged").toPandas().set_index("id")["staged"]
    def shares(tree):
        scored = tree.transform(vectors.select("id", FEATURES))
        name = next(c for c in scored.columns if "probability" in c.lower())
        return scored.select("id", name).toPandas().set_index("id")[name]

    singles = [shares(t) for t in model.trees]
    for n in counts:
        votes = sum(s.map(lambda p: p.toArray()) for s in singles[:n])
        assert (votes.map(np.argmax) == staged.map(lambda m: m[n])).all()
    with pytest.raises(ValueError):
        staged_predictions(model, vectors, [13])


def test_tree_counts_need_one_fit_per_fold(table, monkeypatch):
    fits = []
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, *a: fits.append(self.getNumTrees()) or fit(self, *a))
    held_out = validate.tune_tree_counts(lambda n: forest(n, 2, 5), table, "id", "status", NAMES, [1, 4, 9], k=2)
    results = {r.setting: r for r in validate.summarize_folds(validate.fold_accuracy(held_out)).collect()}
    assert fits == [9, 9] and set(results) == {"ntree=1", "ntree=4", "ntree=9"}
    assert held_out.count() == 1500 and results["ntree=9"].accuracy > 0.7


def test_bags_follow_a_poisson_law_and_the_key(spark):
    drawn = spark.range(20_000).select("id", times_drawn("id", 3).alias("a"), times_drawn("id", 4).alias("b"))
    shares = {r.a: r.n / 20_000 for r in drawn.groupBy("a").agg(F.count("*").alias("n")).collect()}
    assert shares[0] == pytest.approx(np.exp(-1), abs=0.02) and shares[1] == pytest.approx(np.exp(-1), abs=0.02)
    assert abs(drawn.select(F.corr("a", "b")).first()[0]) < 0.03
    again = spark.range(20_000).repartition(7).select("id", times_drawn("id", 3).alias("c"))
    assert drawn.join(again, "id").where("a <> c").count() == 0


@pytest.fixture(scope="module")
def bag(vectors):
    return BaggedForest.fit(vectors, "id", ntree=15, mtry=2, max_depth=12)


def test_noise_costs_nothing_out_of_bag_though_the_trees_have_learned_it(vectors, bag, spark):
    """Deep trees split on the noise; in the bag its shuffle costs much, out of the bag nothing."""
    noise_splits = sum((t.feature == 2).sum() for t in bag.trees)
    assert noise_splits > 50
    got = {r.feature: r.accuracy_drop for r in bag.importance(vectors, [[0], [1], [2]], NAMES).collect()}
    assert got["x"] > 0.1 and got["cat"] > 0.1 and abs(got["noise"]) < 0.03
    rng, rows = np.random.default_rng(0), vectors.toPandas()
    x, y = np.stack(rows[FEATURES].map(lambda v: v.toArray())), rows[LABEL].to_numpy()
    moved = x.copy()
    moved[:, 2] = rng.permutation(x[:, 2])
    vote = lambda m: sum(t.shares[t.leaves(m)] for t in bag.trees).argmax(axis=1)
    assert (vote(x) == y).mean() - (vote(moved) == y).mean() > 0.03


def test_importance_equals_its_definition(vectors, bag, spark):
    from mixedframe.models.scoring import permuted
    from pyspark.ml.functions import vector_to_array

    rows = permuted(vectors.select("id", F.col(LABEL).alias("label"), vector_to_array(FEATURES).alias("x")), "id", ["x"], str(bag.seed))
    rows = rows.select("*", *[(times_drawn("id", t, bag.seed) > 0).alias(f"b{t}") for t in range(len(bag.trees))]).toPandas()
    x, z, y = np.stack(rows["x"]), np.stack(rows["x__moved"]), rows["label"].to_numpy()
    assert sorted(map(tuple, x)) == sorted(map(tuple, z))
    drops = []
    for t, tree in enumerate(bag.trees):
        out = ~rows[f"b{t}"].to_numpy()
        right = lambda m: (tree.shares[tree.leaves(m)].argmax(axis=1) == y[out]).mean()  # noqa: B023, E731
        changed = x[out].copy()
        changed[:, 0] = z[out][:, 0]
        drops.append(right(x[out]) - right(changed))
    got = {r.feature: r for r in bag.importance(vectors, [[0], [1], [2]], NAMES).collect()}
    assert got["x"].accuracy_drop == pytest.approx(np.mean(drops)) and got["x"].sd == pytest.approx(np.std(drops, ddof=1))


def test_out_of_bag_votes(vectors, bag):
    got = bag.out_of_bag(vectors).toPandas()
    assert len(got) == 500 and got["prediction"].notna().mean() > 0.99
    assert 0.6 < (got["prediction"] == got["label"]).mean() < 0.95


def test_elimination_drops_noise_by_out_of_bag_rank(table):
    rank = validate.rank_features(table, "id", "status", NAMES, ntree=7, mtry=2, depth=10)
    assert validate._order(rank)[-1] == "noise"
    held_out = validate.rfe(lambda n: forest(5, min(2, n), 6), table, "id", "status", NAMES, sizes=(1, 2), k=2, ranking={"ntree": 5, "mtry": 2})
    results = {r["size"]: r.accuracy for r in validate.summarize_folds(validate.fold_accuracy(held_out, ["size"]), ["size"]).collect()}
    assert set(results) == {1, 2, 3} and results[2] > 0.7


def test_pipeline_vectors_without_categories(spark):
    rows = [(i, float(i % 2), Vectors.dense([float(i % 2), float(i)])) for i in range(40)]
    df = spark.createDataFrame(rows, ["id", LABEL, FEATURES])
    small = BaggedForest.fit(df, "id", ntree=2, mtry=2, max_depth=2)
    assert all((t.category < 0).all() for t in small.trees)
