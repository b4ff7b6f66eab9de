"""Combining the predictions of several models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import bind_on_key
from .estimators import forest
from .features import fit_classifier


def dissent_vote(best: str, others: Sequence[str]) -> Column:
    """The best model's class, unless all the others agree on one class."""
    first = F.col(others[0])
    agree = F.lit(True)
    for c in others[1:]:
        agree = agree & (first == F.col(c))
    return F.when(agree, first).otherwise(F.col(best))


def prediction_table(held_out: Mapping[str, DataFrame], key: str = "key") -> DataFrame:
    """One row per key with the observed class as ``target`` and one prediction column per model."""
    frames = [
        df.select(key, *([F.col("obs").alias("target")] if i == 0 else []), F.col("pred").alias(name))
        for i, (name, df) in enumerate(held_out.items())
    ]
    return bind_on_key(frames, key)


def stack(predictions: DataFrame, models: Sequence[str], target: str = "target", ntree: int = 501, mtry: int = 2,
          max_depth: int = 10, seed: int = 1) -> PipelineModel:
    """Forest over the prediction columns. Fit it on held-out predictions, so that no
    model is judged on rows it has seen."""
    return fit_classifier(forest(ntree, mtry, max_depth, seed), predictions, target, list(models))
