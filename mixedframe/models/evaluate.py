"""Evaluation of class and number predictions as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running_sums


def confusion(df: DataFrame, pred: str, obs: str) -> DataFrame:
    """Counts per (predicted, observed)."""
    return df.groupBy(F.col(pred).alias("predicted"), F.col(obs).alias("observed")).agg(F.count("*").alias("n"))


def _class_counts(cells: DataFrame) -> DataFrame:
    right = F.col("predicted") == F.col("observed")
    hit, miss, none = F.when(right, F.col("n")).otherwise(0), F.when(~right, F.col("n")).otherwise(0), F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("observed").alias("class"), hit.alias("tp"), miss.alias("fn"), none.alias("fp")),
        F.struct(F.col("predicted").alias("class"), none.alias("tp"), none.alias("fn"), miss.alias("fp")),
    )
    return cells.select(F.inline(sides)).groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp")
    )


def class_metrics(df: DataFrame, pred: str, obs: str) -> DataFrame:
    """Per class: sensitivity, specificity, predictive values, prevalence, balanced accuracy."""
    cells = confusion(df, pred, obs)
    counts = _class_counts(cells).withColumn("total", cells.agg(F.sum("n")).scalar())
    tn = F.col("total") - F.col("tp") - F.col("fn") - F.col("fp")
    rates = counts.withColumn("tn", tn).select(
        "class",
        F.try_divide("tp", F.col("tp") + F.col("fn")).alias("sensitivity"),
        F.try_divide("tn", F.col("tn") + F.col("fp")).alias("specificity"),
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("ppv"),
        F.try_divide("tn", F.col("tn") + F.col("fn")).alias("npv"),
        F.try_divide(F.col("tp") + F.col("fn"), "total").alias("prevalence"),
    )
    return rates.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def overall_metrics(df: DataFrame, pred: str, obs: str) -> DataFrame:
    """Accuracy, no-information rate and Cohen's kappa."""
    counts = _class_counts(confusion(df, pred, obs))
    observed, predicted = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    sums = counts.agg(
        F.sum("tp").cast("double").alias("hits"),
        F.sum(observed).cast("double").alias("total"),
        F.max(observed).alias("largest"),
        F.sum(observed.cast("double") * predicted).alias("chance"),
    )
    accuracy = F.try_divide("hits", "total")
    chance = F.try_divide(F.try_divide("chance", "total"), "total")
    return sums.select(
        F.col("total").cast("long").alias("n"),
        accuracy.alias("accuracy"),
        F.try_divide("largest", "total").alias("no_information_rate"),
        F.try_divide(accuracy - chance, 1 - chance).alias("kappa"),
    )


def _score_counts(df: DataFrame, score: str | Column, positive: Column) -> DataFrame:
    flagged = df.select(
        (-(F.col(score) if isinstance(score, str) else score).cast("double")).alias("__s"),
        positive.cast("long").alias("pos"),
        (~positive).cast("long").alias("neg"),
    )
    return running_sums(flagged, "__s", ["pos", "neg"])


def roc_curve(df: DataFrame, score: str | Column, positive: Column) -> DataFrame:
    """One row per distinct score t: rates when every score >= t is called positive, and the
    start of the curve, where nothing is (threshold infinity, sensitivity 0, specificity 1).

    Tied scores are one step. Counts accumulate over distinct scores, split into bins,
    so the curve of a very large table is still computed by all tasks.
    """
    c = _score_counts(df, score, positive)
    start = c.agg(F.max("pos_total").alias("p"), F.max("neg_total").alias("n")).where("p IS NOT NULL").select(
        F.lit(float("inf")).alias("threshold"),
        F.when(F.col("p") > 0, 0.0).alias("sensitivity"),
        F.when(F.col("n") > 0, 1.0).alias("specificity"),
    )
    return start.union(c.select(
        (-F.col("__s")).alias("threshold"),
        F.try_divide(F.col("pos_before") + F.col("pos"), "pos_total").alias("sensitivity"),
        F.try_divide(F.col("neg_total") - F.col("neg_before") - F.col("neg"), "neg_total").alias("specificity"),
    ))


def roc_auc(df: DataFrame, score: str | Column, positive: Column) -> DataFrame:
    """Area under the curve by trapezoids; each tied score is one trapezoid."""
    c = _score_counts(df, score, positive)
    area = F.sum(F.col("neg").cast("double") * (F.col("pos_before") + F.col("pos") / 2))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return c.agg(
        F.max("pos_total").alias("n_positive"), F.max("neg_total").alias("n_negative"), F.try_divide(area, pairs).alias("auc")
    )


def accuracy_by_model(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Accuracy of several prediction columns in one pass; a missing prediction is wrong."""
    right = lambda c: F.coalesce(F.col(c) == F.col(target), F.lit(False)).cast("double")
    wide = df.agg(*[F.avg(right(c)).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "model", "accuracy")


def regression_metrics(df: DataFrame, pred: str, obs: str, by: Sequence[str] = ()) -> DataFrame:
    """Squared correlation, root mean squared error and mean absolute error over the ``n`` rows that have both.

    ``n_missing`` counts the observed rows without a prediction, which the errors say nothing about.
    """
    p, o = F.col(pred).cast("double"), F.col(obs).cast("double")
    both = p.isNotNull() & o.isNotNull()
    held = lambda c: F.when(both, c)
    r = F.try_divide(F.covar_pop(held(p), held(o)), F.sqrt(F.var_pop(held(p))) * F.sqrt(F.var_pop(held(o))))
    return df.groupBy(*by).agg(
        F.count_if(both).alias("n"),
        F.count_if(o.isNotNull() & p.isNull()).alias("n_missing"),
        (r * r).alias("r2"),
        F.sqrt(F.avg((p - o) * (p - o))).alias("rmse"),
        F.avg(F.abs(p - o)).alias("mae"),
    )


def compare_models(cross_validated: DataFrame, holdout: DataFrame) -> DataFrame:
    """(model, accuracy, ci) beside holdout accuracy; models without one of them keep null."""
    return cross_validated.join(holdout, "model", "full")
