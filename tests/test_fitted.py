"""Folds, shuffled columns, standard errors, and the stored form of what was fitted."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mixedframe.models import features, scoring
from mixedframe.models.estimators import boosted, forest, logistic
from mixedframe.models.features import Standardizer
from mixedframe.models.folds import stratified_folds
from mixedframe.models.statistics import logistic_terms, statistic_importance
from mixedframe.operators.cleaning import ServiceYears, TopKLumper
from mixedframe.operators.neighbours import NeighbourIndex
from mixedframe.sources import load_fitted, save_fitted


def test_folds_are_balanced_within_each_class(spark):
    rng = np.random.default_rng(1)
    rows = [(i, str(c) if c else None) for i, c in enumerate(rng.choice(4, 1003, p=[0.05, 0.6, 0.3, 0.05]))]
    df = spark.createDataFrame(rows, "id long, c string").repartition(5)
    for bin_rows in (1_000_000, 50):
        got = stratified_folds(df, "id", "c", 7, bin_rows=bin_rows).toPandas()
        assert len(got) == 1003 and set(got["fold"]) == set(range(7))
        sizes = got.fillna("null").groupby(["c", "fold"]).size().unstack(fill_value=0)
        assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()
    again = stratified_folds(df.repartition(2), "id", "c", 7).toPandas().set_index("id")["fold"]
    assert (again == got.set_index("id")["fold"]).all()


def test_folds_with_ties_of_the_hash_and_without_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, "a")] * 4 + [(None, "b")] * 3, "id long, c string")
    got = stratified_folds(df, "id", "c", 3).toPandas()
    assert got.groupby("c").size().to_dict() == {"a": 9, "b": 3}
    assert got[got.c == "a"].groupby("fold").size().tolist() == [3, 3, 3]
    assert stratified_folds(df.where("1 = 0"), "id", "c", 3).collect() == []


@pytest.mark.parametrize("block_rows", [100_000, 37, 1])
def test_shuffled_columns_are_one_permutation(spark, block_rows):
    df = spark.range(400).select("id", (F.col("id") * 3).alias("a"), F.col("id").cast("string").alias("b")).repartition(6)
    got = scoring.permuted(df, "id", ["a", "b"], block_rows=block_rows).toPandas()
    assert len(got) == 400 and list(got.columns) == ["id", "a", "b", "a__moved", "b__moved"]
    assert sorted(got["a__moved"]) == sorted(got["a"]) and (got["a__moved"] == got["b__moved"].astype(int) * 3).all()
    assert (got["a"] != got["a__moved"]).all()
    # one cycle through all rows, whatever the blocks
    step, at, seen = dict(zip(got["a"], got["a__moved"])), 0, 0
    while True:
        at, seen = step[at], seen + 1
        if at == 0:
            break
    assert seen == 400


def test_shuffle_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(1, 5.0)], "id long, a double")
    assert [tuple(r) for r in scoring.permuted(df, "id", ["a"]).collect()] == [(1, 5.0, 5.0)]
    assert scoring.permuted(df.where("1 = 0"), "id", ["a"]).collect() == []


@pytest.fixture(scope="module")
def two_classes(spark):
    rng = np.random.default_rng(4)
    n = 900
    x, c = rng.normal(size=n), np.array(["u", "v", "w"])[rng.integers(0, 3, n)]
    p = 1 / (1 + np.exp(-(0.3 + 0.8 * x - 1.1 * (c == "w"))))
    frame = pd.DataFrame({"id": range(n), "x": x, "far": rng.normal(size=n) * 1000, "c": c, "status": np.where(rng.random(n) < p, "yes", "no")})
    return spark.createDataFrame(frame).repartition(4).cache(), frame


def test_standard_errors_equal_a_plain_fit(two_classes):
    df, frame = two_classes
    model = features.fit_classifier(logistic("binomial", tol=1e-12), df, "status", ["x", "far", "c"], onehot=True)
    got = {r.term: r for r in logistic_terms(model, df).collect()}
    m = np.column_stack([frame["x"], frame["far"], frame["c"] == "w", frame["c"] == "v", np.ones(len(frame))]).astype(float)
    y, b = (frame["status"] == "yes").to_numpy(float), np.zeros(5)
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-m @ b))
        info = m.T @ (m * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(info, m.T @ (y - p))
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    for term, estimate, error in zip(["x", "far", "c=w", "c=v", "(intercept)"], b, se):
        assert got[term].estimate == pytest.approx(estimate, rel=1e-4, abs=1e-7)
        assert got[term].std_error == pytest.approx(error, rel=1e-4) and got[term].z == pytest.approx(estimate / error, rel=1e-3, abs=1e-4)
    rank = [r.feature for r in statistic_importance(model, df).collect()]
    assert rank == ["x", "c", "far"] and {r.feature for r in scoring.importance_table(df.sparkSession, model, df).collect()} == {"x", "c", "far"}


def test_a_column_without_information_has_no_error(two_classes):
    df, _ = two_classes
    odd = df.withColumn("one", F.lit(1.0)).withColumn("twice", 2 * F.col("x"))
    model = features.fit_classifier(logistic("binomial"), odd, "status", ["x", "twice", "one"], onehot=True)
    got = {r.term: r.std_error for r in logistic_terms(model, odd).collect()}
    assert got["one"] is None and got["x"] is None and got["twice"] is None


def test_only_two_class_models_have_a_statistic(two_classes):
    df, _ = two_classes
    with pytest.raises(ValueError):
        logistic_terms(features.fit_classifier(forest(2, 1, 2), df, "status", ["x"]), df)


LOADED = """
import sys
sys.path.insert(0, {root!r})
from mixedframe.session import local_session
from mixedframe.sources import load_fitted
spark = local_session(2, "1g")
rows = spark.read.parquet({path!r} + "/rows")
near = load_fitted(spark, {path!r} + "/index").join(rows, "id")
scaled = load_fitted(spark, {path!r} + "/scaler").transform(rows)
lumped = load_fitted(spark, {path!r} + "/lumper").transform(rows, "top")
both = load_fitted(spark, {path!r} + "/models")
scores = both["xgb"].transform(rows).select("id", "__predicted")
for name, df in (("near", near), ("scaled", scaled), ("lumped", lumped), ("scores", scores)):
    df.write.parquet({path!r} + "/out/" + name)
"""


def test_fitted_things_score_the_same_in_another_process(spark, two_classes, tmp_path):
    df, _ = two_classes
    rows = df.select("id", "x", "far", "c", "status")
    path = str(tmp_path)
    rows.write.parquet(f"{path}/rows")
    index = NeighbourIndex("id", ["x", "far"], 3, ["status"], exclude_self=True).fit(rows)
    scaler, lumper = Standardizer(["x", "far"]).fit(rows), TopKLumper("c", 2).fit(rows)
    models = {"xgb": features.fit_classifier(boosted(nrounds=2, max_depth=2), rows, "status", ["x", "c"], onehot=True), "k": 3}
    for name, fitted in (("index", index), ("scaler", scaler), ("lumper", lumper), ("models", models)):
        save_fitted(spark, fitted, f"{path}/{name}")
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", LOADED.format(root=root, path=path)], check=True, timeout=300)
    want = {"near": index.join(rows, "id"), "scaled": scaler.transform(rows), "lumped": lumper.transform(rows, "top"), "scores": models["xgb"].transform(rows).select("id", "__predicted")}
    for name, mine in want.items():
        theirs = spark.read.parquet(f"{path}/out/{name}")
        assert mine.count() == theirs.count() and mine.exceptAll(theirs.select(*mine.columns)).isEmpty()


def test_a_folder_is_not_overwritten_unless_told(spark, tmp_path):
    years = ServiceYears("a", "b").fit(spark.createDataFrame([(2000, 1990)], "a int, b int"))
    save_fitted(spark, years, str(tmp_path / "y"))
    assert load_fitted(spark, str(tmp_path / "y")) == years
    with pytest.raises(Exception, match="exist"):
        save_fitted(spark, years, str(tmp_path / "y"))
    save_fitted(spark, years, str(tmp_path / "y"), overwrite=True)
    assert load_fitted(spark, str(tmp_path / "y")) == years


def test_foreign_or_newer_forms_are_refused(spark, tmp_path):
    import json

    for i, what in enumerate(({"format": 1, "what": {"fitted": "os:system", "values": {}}}, {"format": 99, "what": {"value": 1}})):
        spark.createDataFrame([(json.dumps(what),)], "d string").write.text(str(tmp_path / f"{i}/description"))
        with pytest.raises(ValueError):
            load_fitted(spark, str(tmp_path / str(i)))
