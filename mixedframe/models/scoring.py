"""Applying fitted models: batch scores, what-if comparison, importance, partial dependence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import key_hash
from ..session import stage
from .cells import moved_to
from .features import PREDICTION, SHARES, class_labels, is_text, levels_of
from .statistics import statistic_importance
from .trees import trees_of

# R's machine epsilon: keeps the logarithm of a zero share finite
EPSILON = 2.220446049250313e-16


def score(model: PipelineModel, df: DataFrame, key: str, output: str = "prediction") -> DataFrame:
    """(key, predicted class)."""
    return model.transform(df).select(key, F.col(PREDICTION).alias(output))


def score_many(models: Mapping[str, PipelineModel], df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """One prediction column per model, all in one pass over the rows (no join)."""
    columns, out = df.columns, df
    for name, model in models.items():
        out = model.transform(out).withColumn(name, F.col(PREDICTION)).select(*columns, *(n for n in models if n == name or n in out.columns))
    return out.select(key, *keep, *models)


def what_if(model: PipelineModel, df: DataFrame, key: str, changes: Mapping[str, Column]) -> DataFrame:
    """(key, before, after): predicted class as is and with some columns changed."""
    before = model.transform(df).select(*df.columns, F.col(PREDICTION).alias("before"))
    after = model.transform(before.withColumns(dict(changes)))
    return after.select(key, "before", F.col(PREDICTION).alias("after"))


def _slots(model: PipelineModel) -> list[str]:
    """Source column of every position of the feature vector."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    encoded: dict[str, int] = {}
    for stage in model.stages:
        if hasattr(stage, "categorySizes"):
            encoded.update({c: n - 1 for c, n in zip(stage.getOutputCols(), stage.categorySizes)})
    slots: list[str] = []
    for c in assembler.getInputCols():
        slots += [c.removesuffix("__oh").removesuffix("__ix")] * encoded.get(c, 1)
    return slots


def _weights(fitted) -> list[float]:
    if hasattr(fitted, "featureImportances"):
        return list(fitted.featureImportances.toArray())
    if hasattr(fitted, "coefficientMatrix"):
        return list(abs(fitted.coefficientMatrix.toArray()).sum(axis=0))
    # one model per class: mean of their importances
    parts = [m.featureImportances.toArray() for m in fitted.models]
    return list(sum(parts) / len(parts))


def importance_table(spark: SparkSession, model: PipelineModel, rows: DataFrame | None = None) -> DataFrame:
    """(feature, importance) from the fitted model, highest first.

    Impurity decrease for trees, split shares for the softmax booster, and for logistic
    models coefficient magnitude; the indicator columns of one category are summed. A
    two-class logistic model with the ``rows`` it was fitted on is judged by its test
    statistics instead: a feature has the largest of its terms.
    """
    if rows is not None and getattr(model.stages[-2], "numClasses", 0) == 2 and hasattr(model.stages[-2], "coefficients"):
        return statistic_importance(model, rows)
    totals: dict[str, float] = {}
    for name, w in zip(_slots(model), _weights(model.stages[-2])):
        totals[name] = totals.get(name, 0.0) + float(w)
    found = sorted(totals.items(), key=lambda item: (-item[1], item[0]))
    return spark.createDataFrame(found, "feature string, importance double")


#: rows a task puts in order when columns are shuffled
BLOCK_ROWS = 100_000


def permuted(df: DataFrame, key: str, cols: Sequence[str], salt: str = "", suffix: str = "__moved", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with, for each listed column, its values moved to other rows as ``<col><suffix>``.

    All rows stand in one order, that of a hash of the key; each takes the values of the next
    row and the last those of the first. The order is cut into ranges of the hash, as many as
    leave about ``block_rows`` rows to each, and only a range is ordered by a task; its last
    row finds the first row of the next range, which is added to it. All columns share one
    shuffle.
    """
    n = df.count()
    blocks = max(1, -(-n // block_rows))
    span = 1 << 40
    order = F.pmod(F.xxhash64(F.lit(f"permuted-{salt}"), key_hash(key, salt), F.col(key)), F.lit(span))
    placed = df.withColumn("__order", order).withColumn("__block", F.floor(F.col("__order") * blocks / float(span)).cast("long"))
    placed = placed.withColumn("__row", F.struct(*cols))
    firsts = placed.groupBy("__block").agg(F.min_by("__row", F.struct("__order", F.col(key))).alias("__row"))
    # one row for each range: the first row of a range goes to the end of the one before it
    line = W.orderBy("__block")
    everyone = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.coalesce(F.lag("__block").over(line), F.last("__block").over(everyone))
    firsts = firsts.select(before.alias("__block"), "__row", F.lit(True).alias("__added"))
    rows = placed.withColumn("__added", F.lit(False)).unionByName(firsts, allowMissingColumns=True)
    turn = W.partitionBy("__block").orderBy("__added", "__order", key)
    moved = rows.withColumn("__row", F.lead("__row").over(turn)).where("NOT __added")
    return moved.select(*df.columns, *[F.col(f"__row.{c}").alias(c + suffix) for c in cols])


def permutation_importance(model: PipelineModel, df: DataFrame, key: str, target: str, features: Sequence[str],
                           block_rows: int = BLOCK_ROWS, seed: int = 1, predicted: str = PREDICTION) -> DataFrame:
    """(feature, accuracy, accuracy_drop): loss of accuracy when one column is shuffled.

    The rows are shuffled once for all columns. Each row is then laid out once as it is and
    once per column with that column's moved value, and all are scored in one pass. On the
    rows a model was fitted on, this also rewards what it has memorised; give it others, or
    use ``bagging.BaggedForest.importance``, which judges each tree on rows it has not seen.
    """
    rows = permuted(df.select(key, target, *features), key, list(features), str(seed), block_rows=block_rows)

    def variant(name: str) -> Column:
        return F.struct(F.lit(name).alias("feature"), *[F.col(f"{c}__moved" if c == name else c).alias(c) for c in features])

    laid_out = rows.select(target, F.inline(F.array(*[variant(c) for c in ("", *features)])))
    right = F.coalesce(F.col(predicted) == F.col(target), F.lit(False)).cast("double")
    each = model.transform(laid_out).groupBy("feature").agg(F.avg(right).alias("accuracy"))
    each = stage(each, "importance")
    base = each.where("feature = ''").select("accuracy").scalar()
    return each.where("feature <> ''").withColumn("accuracy_drop", base - F.col("accuracy"))


def _told_apart(model: PipelineModel, df: DataFrame, but: str) -> DataFrame:
    """The columns the model reads except ``but``, each distinct row once with its count ``__rows``.

    A forest compares a number with its cuts only, so a number moves to the next cut at or above it.
    """
    slots = _slots(model)
    features = [c for c in dict.fromkeys(slots) if c != but]
    forest = model.stages[-2]
    if isinstance(forest, RandomForestClassificationModel):
        trees = trees_of(df.sparkSession, forest)
        for c in features:
            if is_text(df, c):
                continue
            at = slots.index(c)
            cuts = np.unique(np.concatenate([t.cut[(t.feature == at) & (t.category < 0)] for t in trees]))
            value = F.col(c).cast("double")
            # beyond the last cut: any larger number; what the assembler refuses stays as it is
            moved = moved_to(value, cuts, [*cuts, np.nextafter(cuts[-1], np.inf)] if len(cuts) else [0.0])
            df = df.withColumn(c, F.when(value.isNull() | F.isnan(value), value).otherwise(moved))
    return df.groupBy(*features).agg(F.count("*").alias("__rows"))


def partial_dependence(model: PipelineModel, df: DataFrame, col: str, values: Sequence | None = None, points: int = 51) -> DataFrame:
    """(class, value, effect): mean centred log share of each class with ``col`` set to each value.

    All rows are scored at every grid value; rows that the model cannot tell apart are
    counted and scored once, the grid is laid out within each and summed map-side. Without ``values`` the grid is equally spaced over a number, and the
    levels of a category, for which ``value`` is text.
    """
    text = is_text(df, col)
    if values is None and text:
        values = levels_of(df, col)
    elif values is None:
        lo, hi = df.agg(F.min(col), F.max(col)).first()
        values = [lo + i * (hi - lo) / (points - 1) for i in range(points)] if hi > lo else [lo]
    grid = F.explode(F.array(*[F.lit(v) if text else F.lit(float(v)) for v in values]))
    rows = _told_apart(model, df, col).withColumn("__grid", grid).withColumn(col, F.col("__grid"))
    labels = class_labels(model)
    shares = model.transform(rows).select("__grid", "__rows", vector_to_array(SHARES).alias("p"))
    logs = shares.select("__grid", "__rows", F.transform("p", lambda p: F.log(F.greatest(p, F.lit(EPSILON)))).alias("l"))
    centre = F.aggregate("l", F.lit(0.0), lambda a, x: a + x) / F.size("l")
    logs = logs.withColumn("c", centre)
    weighed = lambda i: F.sum((F.col("l")[i] - F.col("c")) * F.col("__rows")) / F.sum("__rows")
    means = logs.groupBy("__grid").agg(*[weighed(i).alias(v) for i, v in enumerate(labels)])
    return means.withColumnRenamed("__grid", "value").unpivot("value", labels, "class", "effect")
