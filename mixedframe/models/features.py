"""Feature preparation and classifier pipelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import IndexToString, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

# reserved names, so that a table may have columns called label, features or prediction
LABEL, FEATURES, PREDICTION = "__label", "__features", "__predicted"
INDEX, SHARES = "__prediction", "__probability"
#: text features are categories: an indexer keeps their levels on the driver
MAX_LEVELS = 100_000


def is_text(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)


def level_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Levels of each column, counted before anything is gathered; more than ``MAX_LEVELS`` is an error."""
    if not cols:
        return {}
    counts = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols]).first().asDict()
    wide = [c for c, n in counts.items() if n > MAX_LEVELS]
    if wide:
        raise ValueError(f"{', '.join(wide)}: more than {MAX_LEVELS} levels; lump them first")
    return counts


def feature_stages(df: DataFrame, features: Sequence[str], onehot: bool = False, unseen: str = "keep") -> list:
    """Stages that turn the listed columns into one vector.

    With ``onehot`` a category of k levels becomes k-1 indicator columns, its
    alphabetically first level being the reference, as in a model formula. Without,
    it stays one nominal column that trees split by level. ``unseen`` says what
    happens to a level not met while fitting: "keep" gives it a level of its own, which
    as indicators is a row of zeros, like the reference. A text feature with more than
    ``MAX_LEVELS`` levels is no category and is refused before anything is gathered.
    """
    text = [c for c in features if is_text(df, c)]
    sizes = level_counts(df, text)
    stages: list = []
    if text:
        order = "alphabetDesc" if onehot else "alphabetAsc"
        stages.append(
            StringIndexer(inputCols=text, outputCols=[f"{c}__ix" for c in text],
                          stringOrderType=order, handleInvalid=unseen)
        )
    if text and onehot:
        # an unseen level has the slot after the reference, which is last: both are no indicator
        known = ", ".join(f"least(`{c}__ix`, {max(sizes[c] - 1, 0)}) AS `{c}__known`" for c in text)
        stages.append(SQLTransformer(statement=f"SELECT *, {known} FROM __THIS__"))
        stages.append(
            OneHotEncoder(inputCols=[f"{c}__known" for c in text], outputCols=[f"{c}__oh" for c in text], dropLast=True)
        )
    suffix = "__oh" if onehot else "__ix"
    inputs = [f"{c}{suffix}" if c in text else c for c in features]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="error"))
    return stages


def feature_pipeline(df: DataFrame, target: str | None, features: Sequence[str], onehot: bool = False, unseen: str = "keep") -> Pipeline:
    stages = feature_stages(df, features, onehot, unseen)
    if target:
        stages.insert(0, StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc"))
    return Pipeline(stages=stages)


def widest_category(model: PipelineModel) -> int:
    """Largest number of levels among the indexed feature columns."""
    sizes = [
        len(labels) + 1
        for stage in model.stages
        if stage.hasParam("inputCols") and stage.isSet("inputCols") and hasattr(stage, "labelsArray")
        for labels in stage.labelsArray
    ]
    return max(sizes, default=0)


def class_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def with_bins(estimator: Estimator, levels: int) -> Estimator:
    """Trees need at least as many bins as the widest category has levels."""
    if estimator.hasParam("classifier"):
        wrapped = estimator.copy()
        return wrapped.setClassifier(with_bins(estimator.getClassifier(), levels))
    if estimator.hasParam("maxBins") and estimator.getOrDefault("maxBins") < levels:
        return estimator.copy({estimator.getParam("maxBins"): levels})
    return estimator


def fit_classifier(estimator: Estimator, df: DataFrame, target: str, features: Sequence[str], onehot: bool = False) -> PipelineModel:
    """Fitted pipeline from raw columns to the text column ``predicted``.

    Learners pass over their input several times, so the needed columns are computed
    once and stored; ``df`` itself is read a single time.
    """
    rows = stage(df.select(target, *features), "train")
    prepared = feature_pipeline(rows, target, features, onehot).fit(rows)
    vectors = prepared.transform(rows).select(LABEL, FEATURES)
    from .cells import fit_rows  # which reads the names above

    fitted = fit_rows(with_bins(estimator, widest_category(prepared)), vectors)
    back = IndexToString(inputCol=INDEX, outputCol=PREDICTION, labels=class_labels(prepared))
    return PipelineModel([*prepared.stages, fitted, back])


@dataclass(frozen=True)
class StandardizerModel:
    """Means and sample deviations of the fitted table."""

    stats: Mapping[str, tuple[float, float]]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns(
            {
                c + suffix: (F.col(c).cast("double") - F.lit(mean)) / F.lit(sd) if sd else
                F.when(F.col(c).isNotNull(), F.lit(0.0))
                for c, (mean, sd) in self.stats.items()
            }
        )


@dataclass(frozen=True)
class Standardizer:
    """Centre and scale to mean 0 and sample deviation 1; a constant column becomes 0."""

    cols: Sequence[str]

    def fit(self, df: DataFrame) -> StandardizerModel:
        row = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in self.cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in self.cols]
        ).first()
        return StandardizerModel({c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in self.cols})


def one_hot(df: DataFrame, col: str, levels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """k-1 indicator columns ``col_level``; the alphabetically first level is the reference."""
    rest = sorted(levels)[1:]
    return df.select(
        *keep, *[(F.col(col) == F.lit(v)).cast("int").alias(f"{col}_{v}") for v in rest]
    )


def levels_of(df: DataFrame, col: str) -> list[str]:
    """The level set of a category; as many columns result from ``one_hot``, so a wide one is refused."""
    level_counts(df, [col])
    return sorted(r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().collect())
