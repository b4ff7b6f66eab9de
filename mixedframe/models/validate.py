"""Cross-validation, tuning, feature elimination and substitution studies.

Features are indexed once and the indexed table is written to the shared folder;
every fit then reads only the vector, the label and the fold. Held-out predictions
of all settings form one DataFrame, so metrics are ordinary grouped aggregates.
Folds are balanced within each class of the target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbours import NeighbourIndex
from ..session import discard, scratch_path, stage
from .bagging import BaggedForest
from .cells import RowCells, counts_rows
from .features import FEATURES, INDEX, LABEL, SHARES, class_labels, feature_pipeline, widest_category, with_bins
from .folds import with_folds
from .trees import staged_predictions

Setting = Mapping[str, object]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def setting_name(setting: Setting) -> str:
    return ",".join(f"{k}={v}" for k, v in setting.items()) or "default"


def _predict(model, test: DataFrame, labels: Sequence[str], setting: str) -> DataFrame:
    text = [IndexToString(inputCol=i, outputCol=o, labels=list(labels)) for i, o in ((INDEX, "pred"), (LABEL, "obs"))]
    scored = model.transform(test)
    for back in text:
        scored = back.transform(scored)
    probability = []
    if SHARES in scored.columns:
        names = F.array(*[F.lit(v) for v in labels])
        probability = [F.map_from_arrays(names, vector_to_array(SHARES)).alias("probability")]
    return scored.select(F.lit(setting).alias("setting"), "fold", "key", "obs", "pred", *probability)


def _held_out(table: DataFrame, run: Callable[[object], Iterator[DataFrame]], jobs: Sequence, parallelism: int) -> DataFrame:
    """The frames of all jobs, as one scan.

    Each frame is written to one folder of its own as soon as it is there, and its model is
    let go, so neither the plan nor the driver grows with folds and settings. ``table``, the
    stored rows of all folds, is deleted when the last job is done.
    """
    spark = table.sparkSession
    folder = scratch_path(spark, "held-out")

    def work(numbered: tuple[int, object]) -> None:
        i, job = numbered
        for j, frame in enumerate(run(job)):
            frame.write.parquet(f"{folder}/job={i}/part={j}")

    with ThreadPool(parallelism) as pool:
        pool.map(work, list(enumerate(jobs)))
    discard(spark, table)
    return spark.read.parquet(folder).drop("job", "part")


class _FoldFits:
    """Fits on all folds but one. Forests share the cells of the table, which are counted once."""

    def __init__(self, table: DataFrame, estimators: Sequence[Estimator]):
        self.table = table
        self.cells = {b: RowCells(table, b, ["fold"]) for b in {e.getMaxBins() for e in estimators if counts_rows(e)}}

    def fit(self, estimator: Estimator, fold: int, features: Sequence[int] | None = None):
        """``features`` are places in the vector."""
        others = F.col("fold") != fold
        return self.cells[estimator.getMaxBins()].fit(estimator, others, features)

    def discard(self) -> None:
        for cells in self.cells.values():
            cells.discard()


class _Prepared:
    """A table with every feature indexed once, from which any selection is assembled."""

    def __init__(self, df: DataFrame, key: str, target: str, features: Sequence[str], k: int):
        fitted = feature_pipeline(df, target, features).fit(df)
        self.labels, self.levels = class_labels(fitted), widest_category(fitted)
        inputs = fitted.stages[-1].getInputCols()
        self.slot = {c: f"{c}__ix" if f"{c}__ix" in inputs else c for c in features}
        rows = fitted.transform(df).select(F.col(key).alias("key"), LABEL, *self.slot.values())
        self.table = stage(with_folds(rows, "key", LABEL, k), "folds", by="fold")

    def assembler(self, names: Sequence[str]) -> VectorAssembler:
        return VectorAssembler(inputCols=[self.slot[c] for c in names], outputCol=FEATURES)

    def share(self, estimators: Sequence[Estimator]) -> None:
        """Counts the cells that the fits of these estimators share."""
        every = self.assembler(list(self.slot)).transform(self.table).select("fold", LABEL, FEATURES)
        self.fits = _FoldFits(every, [with_bins(e, self.levels) for e in estimators])

    def fit(self, estimator: Estimator, names: Sequence[str], fold: int) -> PipelineModel:
        """The model of the named features on all folds but one."""
        assembler, estimator = self.assembler(names), with_bins(estimator, self.levels)
        if counts_rows(estimator):
            places = list(self.slot)
            return PipelineModel([assembler, self.fits.fit(estimator, fold, [places.index(c) for c in names])])
        return PipelineModel([assembler, estimator.fit(assembler.transform(self.table.filter(F.col("fold") != fold)))])

    def ranking(self, names: Sequence[str], rows: DataFrame, ntree: int, mtry: int, depth: int, seed: int = 1) -> DataFrame:
        """(feature, accuracy_drop, sd) on the rows that each tree of a forest has not seen."""
        vectors = stage(self.assembler(names).transform(rows).select("key", LABEL, FEATURES), "vectors")
        bag = BaggedForest.fit(vectors, "key", ntree, mtry, depth, seed, max(32, self.levels))
        found = stage(bag.importance(vectors, [[i] for i in range(len(names))], names), "importance")
        discard(rows.sparkSession, vectors)
        return found


def _order(importance: DataFrame) -> list[str]:
    """Features by the accuracy lost, most first."""
    return [r.feature for r in sorted(importance.collect(), key=lambda r: (-r.accuracy_drop, r.feature))]


def tune(make: Callable[..., Estimator], df: DataFrame, key: str, target: str, features: Sequence[str],
         grid: Sequence[Setting] = ({},), k: int = 10, onehot: bool = False, parallelism: int = 2) -> DataFrame:
    """Held-out predictions (setting, fold, key, obs, pred) of every setting in the grid,
    with a map ``probability`` (class to share) where the model gives one.

    ``make(**setting)`` builds the estimator. Level sets are those of the whole table.
    Fits of different folds and settings run at the same time, ``parallelism`` of them.
    """
    prepared = feature_pipeline(df, target, features, onehot).fit(df)
    rows = prepared.transform(df).select(F.col(key).alias("key"), LABEL, FEATURES)
    table = stage(with_folds(rows, "key", LABEL, k), "folds", by="fold")
    labels, levels = class_labels(prepared), widest_category(prepared)

    estimators = [with_bins(make(**s), levels) for s in grid]
    fits = _FoldFits(table, estimators)

    def run(job: tuple[int, int]) -> Iterator[DataFrame]:
        at, fold = job
        estimator = estimators[at]
        model = fits.fit(estimator, fold) if counts_rows(estimator) else estimator.fit(table.filter(F.col("fold") != fold))
        yield _predict(model, table.filter(F.col("fold") == fold), labels, setting_name(grid[at]))

    held_out = _held_out(table, run, [(i, f) for i in range(len(grid)) for f in range(k)], parallelism)
    fits.discard()
    return held_out


def tune_tree_counts(make: Callable[[int], Estimator], df: DataFrame, key: str, target: str, features: Sequence[str],
                     counts: Sequence[int], k: int = 10, onehot: bool = False, parallelism: int = 2) -> DataFrame:
    """Held-out predictions (setting ``ntree=n``, fold, key, obs, pred) of the first n trees of one forest per fold.

    ``make(n)`` builds a forest of n trees; only the largest is fitted, and one pass over the
    held-out rows gives the predictions of all counts.
    """
    prepared = feature_pipeline(df, target, features, onehot).fit(df)
    rows = prepared.transform(df).select(F.col(key).alias("key"), LABEL, FEATURES)
    table = stage(with_folds(rows, "key", LABEL, k), "folds", by="fold")
    labels, levels = class_labels(prepared), widest_category(prepared)
    name = lambda at: F.element_at(F.array(*[F.lit(v) for v in labels]), at.cast("int") + 1)

    estimator = with_bins(make(max(counts)), levels)
    fits = _FoldFits(table, [estimator])

    def run(fold: int) -> Iterator[DataFrame]:
        model = fits.fit(estimator, fold) if counts_rows(estimator) else estimator.fit(table.filter(F.col("fold") != fold))
        scored = staged_predictions(model, table.filter(F.col("fold") == fold), counts)
        each = scored.select("fold", "key", name(F.col(LABEL)).alias("obs"), F.explode("staged").alias("ntree", "at"))
        yield each.select(F.concat(F.lit("ntree="), F.col("ntree").cast("string")).alias("setting"), "fold", "key", "obs", name(F.col("at")).alias("pred"))

    held_out = _held_out(table, run, range(k), parallelism)
    fits.discard()
    return held_out


def cross_validate(estimator: Estimator, df: DataFrame, key: str, target: str, features: Sequence[str],
                   k: int = 10, onehot: bool = False, parallelism: int = 2) -> DataFrame:
    """Held-out predictions (fold, key, obs, pred) of one estimator."""
    return tune(lambda: estimator, df, key, target, features, ({},), k, onehot, parallelism).drop("setting")


def cross_validate_knn(df: DataFrame, key: str, target: str, features: Sequence[str] | str, neighbours: int = 7,
                       k: int = 10, **options) -> DataFrame:
    """Held-out predictions of the nearest-neighbour classifier, from one index for all folds."""
    named = [features] if isinstance(features, str) else list(features)
    rows = df.select(key, target, *[c for c in named if c not in (key, target)])
    table = stage(with_folds(rows, key, target, k), "folds")
    index = NeighbourIndex(key, features, neighbours, [target], apart="fold", **options).fit(table)
    found = index.classify(table, key, target, "pred", ["fold", target])
    return found.select(F.col(key).alias("key"), "fold", F.col(target).alias("obs"), "pred")


def fold_accuracy(held_out: DataFrame, by: Sequence[str] = ("setting",)) -> DataFrame:
    """Accuracy of each fold; a missing prediction is wrong."""
    by = [c for c in by if c in held_out.columns]
    return held_out.groupBy(*by, "fold").agg(
        F.count("*").alias("n"), F.avg(F.coalesce(F.col("pred") == F.col("obs"), F.lit(False)).cast("double")).alias("accuracy")
    )


def summarize_folds(folds: DataFrame, by: Sequence[str] = ("setting",), value: str = "accuracy") -> DataFrame:
    """Mean over folds, its sample deviation, and half a 95% interval: 1.96 sd / sqrt(k)."""
    by = [c for c in by if c in folds.columns]
    stats = folds.groupBy(*by).agg(
        F.count("*").alias("k"), F.avg(value).alias(value), F.stddev_samp(value).alias(f"{value}_sd")
    )
    return stats.withColumn("ci", 1.96 * F.col(f"{value}_sd") / F.sqrt("k"))


def best_config(results: DataFrame, setting: str = "setting", value: str = "accuracy") -> DataFrame:
    """The setting with the highest metric; a tie goes to the first name."""
    best = F.struct(-F.col(value), F.col(setting))
    return results.agg(F.min_by(setting, best).alias(setting), F.max(value).alias(value))


def one_se_rule(results: DataFrame, complexity: str, value: str = "accuracy", sd: str = "accuracy_sd", k: str = "k") -> DataFrame:
    """The simplest setting within one standard error of the best."""
    se = F.col(sd) / F.sqrt(F.col(k))
    floor = results.agg(
        F.max_by(F.col(value) - se, F.struct(F.col(value), -F.col(complexity).cast("double"))).alias("f")
    )
    good = results.filter(F.col(value) >= floor.scalar())
    return good.orderBy(complexity).limit(1)


def rfe(make: Callable[[int], Estimator], df: DataFrame, key: str, target: str, features: Sequence[str],
        sizes: Sequence[int] = (4, 6, 8, 10, 12), k: int = 10, parallelism: int = 2, ranking: Mapping | None = None) -> DataFrame:
    """Recursive feature elimination: held-out predictions with column ``size``.

    In each fold the features are ranked once, by the accuracy that the trees of a bagged
    forest lose on their out-of-bag rows when a feature is shuffled, and the model is
    refitted on the best of each size (and on all). ``make(n)`` builds the estimator for n
    features; ``ranking`` may set ntree, mtry, depth and seed of the bagged forest.
    """
    prepared = _Prepared(df, key, target, features, k)
    bag = _bag_settings(len(features), ranking)
    kept = [n for n in sorted(set(sizes)) if n < len(features)]
    prepared.share([make(n) for n in (*kept, len(features))])

    def run(fold: int) -> Iterator[DataFrame]:
        train, test = prepared.table.filter(F.col("fold") != fold), prepared.table.filter(F.col("fold") == fold)
        order = _order(prepared.ranking(features, train, **bag))
        yield _predict(prepared.fit(make(len(features)), features, fold), test, prepared.labels, str(len(features)))
        for size in kept:
            yield _predict(prepared.fit(make(size), order[:size], fold), test, prepared.labels, str(size))

    held_out = _held_out(prepared.table, run, range(k), parallelism)
    prepared.fits.discard()
    return held_out.withColumn("size", F.col("setting").cast("int")).drop("setting")


def _bag_settings(n_features: int, given: Mapping | None) -> dict:
    return {"ntree": 201, "mtry": max(1, round(n_features**0.5)), "depth": 20, "seed": 1, **(given or {})}


def rank_features(df: DataFrame, key: str, target: str, features: Sequence[str], **ranking) -> DataFrame:
    """(feature, accuracy_drop, sd): out-of-bag permutation importance of a bagged forest on the whole table."""
    prepared = _Prepared(df, key, target, features, 1)
    return prepared.ranking(features, prepared.table, **_bag_settings(len(features), ranking))


def ablate(estimator: Estimator, df: DataFrame, key: str, target: str, base: Sequence[str],
           variants: Mapping[str, tuple[Sequence[str], Sequence[str]]], k: int = 10, parallelism: int = 2) -> DataFrame:
    """Feature-substitution study: held-out predictions with ``setting`` naming the variant.

    A variant is (columns to drop, columns to add); "baseline" is always included. All
    columns are indexed and stored once.
    """
    lists = {"baseline": list(base)}
    for name, (drop, add) in variants.items():
        lists[name] = [c for c in base if c not in set(drop)] + [c for c in add if c not in base]
    prepared = _Prepared(df, key, target, list(dict.fromkeys(c for names in lists.values() for c in names)), k)

    prepared.share([estimator])

    def run(job: tuple[str, int]) -> Iterator[DataFrame]:
        name, fold = job
        model = prepared.fit(estimator, lists[name], fold)
        yield _predict(model, prepared.table.filter(F.col("fold") == fold), prepared.labels, name)

    held_out = _held_out(prepared.table, run, [(n, f) for n in lists for f in range(k)], parallelism)
    prepared.fits.discard()
    return held_out
