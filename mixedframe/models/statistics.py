"""Standard errors of a two-class logistic model, from the Fisher information of the rows it was fitted on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURES


def information(model: PipelineModel, df: DataFrame) -> np.ndarray:
    """X'WX with W = p (1 - p), the intercept last: every task sums its rows, Spark sums the tasks' cells."""
    fitted = model.stages[-2]
    beta, intercept = fitted.coefficients.toArray(), float(fitted.intercept)
    d = len(beta) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d - 1)
            p = 1 / (1 + np.exp(-(x @ beta + intercept)))
            x = np.column_stack([x, np.ones(len(x))])
            total += x.T @ (x * (p * (1 - p))[:, None])
        i, j = np.indices((d, d)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "w"])

    vectors = PipelineModel(model.stages[:-2]).transform(df).select(vector_to_array(FEATURES).alias("x"))
    out = np.zeros((d, d))
    for r in vectors.mapInArrow(partial, "i int, j int, w double").groupBy("i", "j").agg(F.sum("w").alias("w")).collect():
        out[r.i, r.j] = r.w
    return out


def term_names(model: PipelineModel) -> list[tuple[str, str]]:
    """(column, term) for every place of the feature vector: a number's own name, or column=level."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    levels = {}
    for s in model.stages:
        if isinstance(s, StringIndexerModel) and s.isSet("inputCols"):
            levels.update(zip(s.getInputCols(), s.labelsArray))
    out: list[tuple[str, str]] = []
    for c in assembler.getInputCols():
        if c.endswith("__oh"):
            name = c.removesuffix("__oh")
            # the reference is the level indexed last
            out += [(name, f"{name}={v}") for v in list(levels[name])[:-1]]
        else:
            out.append((c, c))
    return out


def logistic_terms(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, term, estimate, std_error, z), the intercept last, for a two-class model without penalty.

    ``df`` has the rows the model was fitted on. A term that the rows do not determine (a
    constant column, or one that others add up to) has no standard error.
    """
    fitted = model.stages[-2]
    if not hasattr(fitted, "coefficients") or fitted.numClasses != 2:
        raise ValueError("a two-class logistic model is needed")
    info = information(model, df)
    scale = np.sqrt(np.maximum(np.diag(info), 1e-300))
    values, vectors = np.linalg.eigh(info / np.outer(scale, scale))
    sound = values > 1e-10 * max(values.max(), 1e-300)
    # terms with weight in a direction of no information have no variance
    lost = (vectors[:, ~sound] ** 2).sum(axis=1) > 1e-8
    variance = ((vectors[:, sound] ** 2) / values[sound]).sum(axis=1) / scale**2
    estimates = [*fitted.coefficients.toArray(), fitted.intercept]
    rows = []
    for (feature, term), b, v, bad in zip([*term_names(model), ("(intercept)", "(intercept)")], estimates, variance, lost):
        se = None if bad else float(np.sqrt(v))
        rows.append((feature, term, float(b), se, float(b) / se if se else None))
    return df.sparkSession.createDataFrame(rows, "feature string, term string, estimate double, std_error double, z double")


def statistic_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, importance): the largest test statistic, in size, of a feature's terms; highest first."""
    terms = logistic_terms(model, df).where("feature <> '(intercept)'")
    return terms.groupBy("feature").agg(F.coalesce(F.max(F.abs("z")), F.lit(0.0)).alias("importance")).orderBy(F.desc("importance"), "feature")
