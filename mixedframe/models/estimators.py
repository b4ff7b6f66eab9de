"""The classifiers, with the settings used for the wells as defaults."""

from __future__ import annotations

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)

from .boosting import SoftmaxBooster
from .features import FEATURES, INDEX, LABEL, SHARES


def forest(ntree: int = 201, mtry: int = 3, max_depth: int = 20, seed: int = 1, **params) -> RandomForestClassifier:
    """Random forest: ``ntree`` trees, ``mtry`` columns tried at each split."""
    return RandomForestClassifier(
        labelCol=LABEL, featuresCol=FEATURES, predictionCol=INDEX, probabilityCol=SHARES, rawPredictionCol="__raw", numTrees=ntree, featureSubsetStrategy=str(mtry),
        maxDepth=max_depth, seed=seed, **params,
    )


def boosted(nrounds: int = 250, max_depth: int = 5, eta: float = 0.4, gamma: float = 0.0, colsample: float = 0.8,
            min_child_weight: float = 1, subsample: float = 0.75, seed: int = 1) -> SoftmaxBooster:
    """Boosted trees on the multi-class log loss, a tree per class and round, columns sampled per tree."""
    return SoftmaxBooster(nrounds, max_depth, eta, gamma, colsample, min_child_weight, subsample, seed)


def boosted_one_vs_rest(nrounds: int = 250, max_depth: int = 5, eta: float = 0.4, gamma: float = 0.0, colsample: float = 0.8,
                        min_child_weight: int = 1, subsample: float = 0.75, seed: int = 1, parallelism: int = 3) -> OneVsRest:
    """The built-in boosted trees, one booster per class against the rest, columns sampled per split."""
    booster = GBTClassifier(
        labelCol=LABEL, featuresCol=FEATURES, predictionCol=INDEX, maxIter=nrounds, maxDepth=max_depth, stepSize=eta,
        minInfoGain=gamma, featureSubsetStrategy=str(colsample), minInstancesPerNode=min_child_weight,
        subsamplingRate=subsample, seed=seed,
    ).setProbabilityCol(SHARES).setRawPredictionCol("__raw")
    return OneVsRest(
        classifier=booster, labelCol=LABEL, featuresCol=FEATURES, predictionCol=INDEX, rawPredictionCol="__raw", parallelism=parallelism
    )


def logistic(family: str = "multinomial", decay: float = 0.0, max_iter: int = 100, tol: float = 1e-6) -> LogisticRegression:
    """Logistic regression, "binomial" or "multinomial"; ``decay`` is the ridge penalty."""
    return LogisticRegression(
        labelCol=LABEL, featuresCol=FEATURES, predictionCol=INDEX, probabilityCol=SHARES, rawPredictionCol="__raw", family=family, regParam=decay, elasticNetParam=0.0, maxIter=max_iter, tol=tol
    )
