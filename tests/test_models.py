"""Models, validation and evaluation on separable data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mixedframe.models import ensemble, evaluate, features, scoring, validate
from mixedframe.models.estimators import boosted, forest, logistic
from mixedframe.sources import load_model, save_model

FEATURES = ["x", "y", "cat", "noise"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 600
    c = rng.integers(0, 3, n)
    names = np.array(["functional", "needs repair", "non functional"])
    frame = pd.DataFrame({
        "id": np.arange(n),
        "status": names[c],
        "x": rng.normal(size=n) + np.array([0, 4, 8])[c],
        "y": rng.normal(size=n) - np.array([0, 5, 0])[c],
        "cat": np.where(rng.random(n) < 0.9, np.array(["f", "r", "n"])[c], "other"),
        "noise": rng.normal(size=n),
    })
    return spark.createDataFrame(frame).repartition(4, "id").cache()


@pytest.fixture(scope="module")
def rf(table):
    return features.fit_classifier(forest(11, 2, 5), table, "status", FEATURES)


def accuracy(df, pred=features.PREDICTION):
    return df.agg(F.avg((F.col(pred) == F.col("status")).cast("double"))).first()[0]


@pytest.mark.parametrize("make,onehot", [
    (lambda: forest(11, 2, 5), False), (lambda: forest(11, 2, 5), True),
    (lambda: boosted(nrounds=3, max_depth=3), False), (lambda: logistic(max_iter=30), True),
])
def test_classifiers_learn(table, make, onehot):
    model = features.fit_classifier(make(), table, "status", FEATURES, onehot)
    assert accuracy(model.transform(table)) > 0.95


def test_binary_logistic(table):
    two = table.withColumn("status", F.when(F.col("status") == "functional", "ok").otherwise("bad"))
    model = features.fit_classifier(logistic("binomial", max_iter=30), two, "status", FEATURES, True)
    assert accuracy(model.transform(two)) > 0.95


def test_same_seed_same_forest(table, rf):
    again = features.fit_classifier(forest(11, 2, 5), table, "status", FEATURES)
    both = scoring.score_many({"a": rf, "b": again}, table, "id")
    assert both.filter("a <> b").count() == 0


def test_unseen_level_is_scored(table, rf):
    odd = table.withColumn("cat", F.lit("never seen")).drop("status")
    assert scoring.score(rf, odd, "id").count() == 600


@pytest.mark.parametrize("make", [lambda: boosted(nrounds=1, max_depth=2), lambda: logistic(max_iter=5)])
def test_unseen_level_is_scored_as_the_reference(table, make):
    model = features.fit_classifier(make(), table, "status", FEATURES, True)
    as_level = lambda v: scoring.score(model, table.withColumn("cat", F.lit(v)), "id")
    both = as_level("never seen").join(as_level("f").withColumnRenamed("prediction", "reference"), "id")
    assert both.count() == 600 and both.filter("prediction <> reference").count() == 0


def test_reserved_sounding_columns(table):
    odd = table.withColumnsRenamed({"status": "label", "x": "features", "y": "prediction", "cat": "probability"})
    model = features.fit_classifier(forest(5, 2, 4), odd, "label", ["features", "prediction", "probability"])
    assert scoring.score(model, odd, "id", "guess").join(odd, "id").filter("guess = label").count() > 500
    held_out = validate.cross_validate(forest(3, 2, 4), odd, "id", "label", ["features", "probability"], k=2)
    assert validate.fold_accuracy(held_out).agg(F.avg("accuracy")).first()[0] > 0.8


def test_too_many_levels_are_refused(table, monkeypatch):
    monkeypatch.setattr(features, "MAX_LEVELS", 50)
    with pytest.raises(ValueError, match="more than 50 levels"):
        features.feature_stages(table.withColumn("k", F.col("id").cast("string")), ["k"])


def test_missing_predictions_count_as_wrong(spark):
    df = spark.createDataFrame([("a", "a", None), ("b", "b", "b"), ("b", "a", "b"), ("a", None, "b")], "target string, m string, n string")
    assert {r.model: r.accuracy for r in evaluate.accuracy_by_model(df, ["m", "n"], "target").collect()} == {"m": 0.5, "n": 0.5}
    held = df.select(F.lit(0).alias("fold"), F.col("target").alias("obs"), F.col("m").alias("pred"))
    assert validate.fold_accuracy(held).first().accuracy == 0.5


def test_metrics_of_no_rows(spark):
    none = spark.createDataFrame([], "p string, o string, s double")
    assert evaluate.class_metrics(none, "p", "o").collect() == []
    assert evaluate.overall_metrics(none, "p", "o").first().accuracy is None
    assert evaluate.roc_curve(none, "s", F.col("o") == "a").collect() == []


def test_partial_dependence_on_a_category(table, rf):
    pdp = scoring.partial_dependence(rf, table, "cat").toPandas()
    assert set(pdp["value"]) == {"f", "r", "n", "other"} and len(pdp) == 12
    own = pdp[pdp["class"] == "non functional"].set_index("value")["effect"]
    assert own.idxmax() == "n"


def test_tuning_is_one_scan(table):
    held_out = validate.tune(lambda depth: forest(3, 2, depth), table, "id", "status", ["x", "y"], [{"depth": 1}, {"depth": 2}], k=2)
    assert held_out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_bins_cover_wide_categories(table):
    wide = table.withColumn("many", F.concat(F.lit("v"), (F.col("id") % 90).cast("string")))
    assert features.fit_classifier(forest(3, 2, 3), wide, "status", ["x", "many"]) is not None
    assert features.fit_classifier(boosted(nrounds=1, max_depth=2), wide, "status", ["x", "many"]) is not None


def test_one_hot_drops_first_level(spark, table):
    model = features.feature_pipeline(table, "status", ["cat"], onehot=True).fit(table)
    assert scoring._slots(model) == ["cat"] * 3
    row = model.transform(table.filter("cat = 'f'")).first()
    assert row[features.FEATURES].toArray().tolist() == [0.0, 0.0, 0.0]


def test_standardizer(spark):
    train = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    model = features.Standardizer(["a", "b"]).fit(train)
    out = model.transform(spark.createDataFrame([(4.0, 9.0), (None, None)], "a double, b double")).collect()
    assert [tuple(r) for r in out] == [(2.0, 0.0), (None, None)]


def test_save_and_load(spark, table, rf, tmp_path):
    save_model(rf, str(tmp_path / "m"))
    both = scoring.score_many({"a": rf, "b": load_model(str(tmp_path / "m"))}, table, "id")
    assert both.filter("a <> b").count() == 0


def test_importance(spark, table, rf):
    rows = {r.feature: r.importance for r in scoring.importance_table(spark, rf).collect()}
    assert set(rows) == set(FEATURES) and min(rows, key=rows.get) == "noise"
    for estimator in (boosted(nrounds=2, max_depth=2), logistic(max_iter=10)):
        model = features.fit_classifier(estimator, table, "status", FEATURES, True)
        assert {r.feature for r in scoring.importance_table(spark, model).collect()} == set(FEATURES)


def test_permutation_keeps_values_and_importance_ranks(table, rf):
    moved = scoring.permuted(table, "id", ["x", "cat"], block_rows=150).toPandas()
    for c in ("x", "cat"):
        assert sorted(moved[c]) == sorted(moved[f"{c}__moved"])
    assert (moved["x"] != moved["x__moved"]).mean() > 0.99
    drops = {r.feature: r.accuracy_drop for r in scoring.permutation_importance(rf, table, "id", "status", FEATURES, 150).collect()}
    assert drops["x"] > 0.05 and abs(drops["noise"]) < 0.02


def test_what_if_and_partial_dependence(table, rf):
    same = scoring.what_if(rf, table, "id", {"x": F.col("x")})
    assert same.filter("before <> after").count() == 0 and same.count() == 600
    pdp = scoring.partial_dependence(rf, table, "x", points=3).toPandas()
    assert len(pdp) == 9
    # centred log shares add to zero over the classes
    assert pdp.groupby("value")["effect"].sum().abs().max() < 1e-9
    top = pdp[pdp["class"] == "non functional"].sort_values("value")["effect"].to_numpy()
    assert top[0] < top[-1]


def test_cross_validation_covers_every_row(table):
    held_out = validate.cross_validate(forest(5, 2, 4), table, "id", "status", FEATURES, k=3)
    assert held_out.select("key").distinct().count() == held_out.count() == 600
    summary = validate.summarize_folds(validate.fold_accuracy(held_out)).first()
    assert summary.k == 3 and summary.accuracy > 0.9
    auc = evaluate.roc_auc(held_out, F.col("probability")["non functional"], F.col("obs") == "non functional").first()
    assert auc.auc > 0.97 and auc.n_positive + auc.n_negative == 600
    assert summary.ci == pytest.approx(1.96 * summary.accuracy_sd / 3**0.5)


def test_tuning_and_selection(table):
    held_out = validate.tune(lambda depth: forest(5, 2, depth), table, "id", "status", FEATURES, [{"depth": 1}, {"depth": 5}], k=2)
    results = validate.summarize_folds(validate.fold_accuracy(held_out))
    assert validate.best_config(results).first().setting == "depth=5"
    sizes = results.withColumn("size", F.regexp_extract("setting", r"(\d+)", 1).cast("int"))
    assert validate.one_se_rule(sizes, "size").first()["size"] == 5


def test_one_se_rule_prefers_simple(spark):
    rows = [(4, 0.70, 0.02, 4), (8, 0.795, 0.02, 4), (10, 0.80, 0.02, 4)]
    df = spark.createDataFrame(rows, "size int, accuracy double, accuracy_sd double, k int")
    assert validate.one_se_rule(df, "size").first()["size"] == 8


def test_feature_elimination(table):
    held_out = validate.rfe(lambda n: forest(5, min(2, n), 4), table, "id", "status", FEATURES, sizes=(1, 2), k=2, ranking={"ntree": 5, "mtry": 2, "depth": 6})
    results = {r["size"]: r.accuracy for r in validate.summarize_folds(validate.fold_accuracy(held_out, ["size"]), ["size"]).collect()}
    assert set(results) == {1, 2, 4} and results[2] > 0.9


def test_ablation_with_leak(table):
    leaky = table.withColumn("leak", F.col("status"))
    held_out = validate.ablate(forest(5, 2, 4), leaky, "id", "status", ["noise", "y"], {"leak": ([], ["leak"]), "swap": (["y"], ["x"])}, k=2)
    r = {r.setting: r.accuracy for r in validate.summarize_folds(validate.fold_accuracy(held_out)).collect()}
    assert set(r) == {"baseline", "leak", "swap"} and r["leak"] > r["baseline"]


def test_knn_cross_validation_and_stack(table):
    held_out = {
        "rf": validate.cross_validate(forest(5, 2, 4), table, "id", "status", FEATURES, k=2),
        "knn": validate.cross_validate_knn(table, "id", "status", ["x", "y"], 5, k=2),
    }
    predictions = ensemble.prediction_table(held_out)
    assert predictions.count() == 600
    model = ensemble.stack(predictions, ["rf", "knn"], ntree=5)
    assert model.transform(predictions).filter(f"{features.PREDICTION} = target").count() > 560


def test_dissent_vote(spark):
    df = spark.createDataFrame([("a", "a", "a", "a"), ("a", "b", "b", "b"), ("a", "b", "b", "c")], "rf string, xgb string, log string, knn string")
    assert [r.v for r in df.select(ensemble.dissent_vote("rf", ["xgb", "log", "knn"]).alias("v")).collect()] == ["a", "b", "a"]


def test_metrics_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a"), ("a", "a")], "p string, o string")
    m = {r["class"]: r for r in evaluate.class_metrics(df, "p", "o").collect()}
    assert m["a"].sensitivity == pytest.approx(2 / 3) and m["a"].specificity == 0.0
    assert m["b"].sensitivity == 0.0 and m["b"].ppv is None and m["c"].sensitivity is None
    o = evaluate.overall_metrics(df, "p", "o").first()
    assert (o.n, o.accuracy, o.no_information_rate) == (4, 0.5, 0.75)
    pe = (3 * 3 + 0 * 1 + 1 * 0) / 16
    assert o.kappa == pytest.approx((0.5 - pe) / (1 - pe))


def test_auc_of_reversed_score(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(v), bool(b)) for v, b in zip(np.round(rng.normal(size=300), 1), rng.random(300) < 0.4)], "s double, y boolean")
    up = evaluate.roc_auc(df, "s", F.col("y")).first().auc
    down = evaluate.roc_auc(df, -F.col("s"), F.col("y")).first().auc
    assert up == pytest.approx(1 - down)
    curve = evaluate.roc_curve(df, "s", F.col("y")).orderBy("threshold").collect()
    assert curve[0].sensitivity == 1.0 and curve[0].specificity == 0.0
    assert (curve[-1].threshold, curve[-1].sensitivity, curve[-1].specificity) == (float("inf"), 0.0, 1.0)
    x = [1 - r.specificity for r in reversed(curve)]
    y = [r.sensitivity for r in reversed(curve)]
    assert np.trapezoid(y, x) == pytest.approx(up)
