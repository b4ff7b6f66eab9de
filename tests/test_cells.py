"""Forests fitted on counted cells, and what follows from them."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from mixedframe.models import features, scoring
from mixedframe.models.cells import RowCells
from mixedframe.models.estimators import forest
from mixedframe.session import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, str("abc"[i % 3]), float(x), float(i % 5), "low" if x < 0.4 else "c" if i % 3 == 2 else "rest") for i, x in enumerate(rng.random(4000))]
    return spark.createDataFrame(data, "id long, cat string, x double, step double, status string").repartition(4, "id").cache()


def test_cells_do_not_grow_with_the_rows(rows):
    prepared = features.feature_pipeline(rows, "status", ["cat", "x", "step"]).fit(rows)
    vectors = prepared.transform(rows).select(features.LABEL, features.FEATURES)
    many = vectors.crossJoin(vectors.sparkSession.range(5)).drop("id")
    one, five = RowCells(vectors, 32), RowCells(many, 32)
    assert one.table.count() == five.table.count() <= 3 * 32 * 5 * 2
    assert [c.table.agg(F.sum("__w0")).first()[0] for c in (one, five)] == [4000, 20000]
    assert one.table.select("__c1").distinct().count() == 32 and one.table.select("__c2").distinct().count() == 5


def test_a_forest_on_cells_scores_the_rows_as_they_are(rows):
    model = features.fit_classifier(forest(9, 3, 6), rows, "status", ["cat", "x", "step"])
    right = model.transform(rows).agg(F.avg((F.col(features.PREDICTION) == F.col("status")).cast("double"))).first()[0]
    assert right > 0.97


def test_trees_draw_single_rows_of_a_large_table(spark):
    many = spark.range(1_300_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("status"), (F.col("id") % 2).cast("double").alias("x"))
    model = features.fit_classifier(forest(5, 1, 2), many, "status", ["x"])
    path = scratch_path(spark, "forest")
    model.stages[-2].write().save(path)
    roots = spark.read.parquet(f"{path}/data").where("nodeData.id = 0").select("nodeData.impurityStats").collect()
    drawn = np.array([list(r[0]) for r in roots])
    assert drawn.shape == (5, 2) and (drawn == np.round(drawn)).all()
    # Poisson counts: a deviation of sqrt(650,000) = 806
    assert (abs(drawn - 650_000) < 5 * 806).all() and len(np.unique(drawn)) > 1


def test_a_cell_of_many_rows_is_dealt_to_several_tasks(spark):
    many = spark.range(400_001).select(F.lit("a").alias("status"), F.lit(1.0).alias("x"))
    prepared = features.feature_pipeline(many, "status", ["x"]).fit(many)
    cells = RowCells(prepared.transform(many).select(features.LABEL, features.FEATURES), 32)
    tasks = cells.each_row().groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert cells.table.count() == 1 and sum(r["count"] for r in tasks) == 400_001
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 200_000
    cells.discard()


def test_partial_dependence_counts_rows_the_model_cannot_tell_apart(rows):
    model = features.fit_classifier(forest(5, 3, 5), rows, "status", ["cat", "x", "step"])
    assert scoring._told_apart(model, rows, "step").count() <= 3 * 33
    got = {(r["class"], r.value): r.effect for r in scoring.partial_dependence(model, rows, "step", values=[0.0, 3.0]).collect()}
    for value in (0.0, 3.0):
        p = np.array([r[0] for r in model.transform(rows.withColumn("step", F.lit(value))).select(vector_to_array(features.SHARES)).collect()])
        logs = np.log(np.maximum(p, scoring.EPSILON))
        want = (logs - logs.mean(axis=1, keepdims=True)).mean(axis=0)
        assert [got[c, value] for c in features.class_labels(model)] == pytest.approx(want.tolist())
