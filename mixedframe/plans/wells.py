"""The water-well study end to end: cleaning, imputation, models, ensembles, submissions.

``WellsCleaner`` learns from the labelled table and is applied to both tables. All
text lists below are fixed values of the data set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import BLANK_TOKENS, blank_to, canonicalize, collapse_target, log10_or_zero, recode, year_of
from ..models import ensemble, evaluate, scoring, validate
from ..models.estimators import boosted, forest, logistic
from ..models.features import PREDICTION, Standardizer, fit_classifier
from ..operators.cleaning import ServiceYears, ServiceYearsModel, TopKLumper, TopKLumperModel
from ..operators.impute import group_medians, impute_group_median
from ..operators.joins import left_join
from ..operators.neighbours import NeighbourIndex, vote
from ..session import stage
from ..sources import write_table

KEY, TARGET = "id", "status_group"

SCHEMA = """
    id long, amount_tsh double, date_recorded date, funder string, gps_height int, installer string,
    longitude double, latitude double, wpt_name string, num_private int, basin string, subvillage string,
    region string, region_code string, district_code string, lga string, ward string, population int,
    public_meeting string, recorded_by string, scheme_management string, scheme_name string, permit string,
    construction_year int, extraction_type string, extraction_type_group string, extraction_type_class string,
    management string, management_group string, payment string, payment_type string, water_quality string,
    quality_group string, quantity string, quantity_group string, source string, source_type string,
    source_class string, waterpoint_type string, waterpoint_type_group string
"""
LABEL_SCHEMA = "id long, status_group string"

# Columns that repeat another, never vary, or have no known meaning.
DROPPED = ("wpt_name", "num_private", "public_meeting", "recorded_by", "scheme_name", "payment", "quantity_group")

# Fixed values: (include, exclude, label) rules for the two name columns, in order.
GOVERNMENT = "(gov)|(dist)|(coun)"
COMMUNITY = "(comm)|(vill)"
NOT_COMMUNITY = "(committe)|(bank)"
FUNDER_RULES = (
    (GOVERNMENT, "(village)|(comm)|(china)|(belgian)|(finland)|(irish)|(ital)|(japan)|(iran)|(egypt)|(methodist)", "gov"),
    (COMMUNITY, NOT_COMMUNITY, "comm"),
)
INSTALLER_RULES = (
    (GOVERNMENT, "(ital)|(japan)|(iran)|(egypt)|(methodist)", "gov"),
    (COMMUNITY, NOT_COMMUNITY, "comm"),
)

# Levels merged in the management columns.
SCHEME_LEVELS = {"swc": "other", "trust": "other", "none": "other"}
MANAGEMENT_LEVELS = {"company": "private operator", "other - school": "other", "trust": "other"}

# Feature lists of the models.
FOREST_FEATURES = (
    "installer20", "funder20", "longitude", "latitude", "gps_height", "pop_log", "years_op",
    "extraction_type_group", "management", "payment_type", "waterpoint_type",
)
LEAKY_FEATURES = ("quantity", "water_quality")
BOOSTED_FEATURES = (
    "amount_tsh", "installer20", "longitude", "latitude", "gps_height", "pop_log3", "permit", "years_op",
    "extraction_type_group", "management", "payment_type", "source_type", "waterpoint_type",
)
MULTINOMIAL_FEATURES = (
    "installer10", "region", "permit", "extraction_type_group", "management", "payment_type", "source_type",
    "waterpoint_type",
)
NEIGHBOUR_FEATURES = ("longitude", "latitude", "gps_height", "pop_log3", "amount_log", "years_op")
# Features offered to elimination (BOOSTED_FEATURES) and what it leaves out, sizes and
# settings tried, single substitutions (left out, put in), and the two lists of the two-class model.
ELIMINATED = ("amount_tsh", "source_type", "permit")
SIZES = (4, 6, 8, 10, 12)
TREE_COUNTS = (51, 101, 201, 301, 501)
COLUMNS_TRIED = (2, 3, 4, 5)
SUBSTITUTIONS = {
    "installer10": (["installer20"], ["installer10"]), "funder20": ([], ["funder20"]),
    "extraction_type_class": (["extraction_type_group"], ["extraction_type_class"]),
    "management_group": (["management"], ["management_group"]), "pop_log": (["pop_log3"], ["pop_log"]),
    "pop_log2": (["pop_log3"], ["pop_log2"]), "amount_log": (["payment_type"], ["amount_log"]),
    "construction_year": (["years_op"], ["construction_year"]),
}
TWO_CLASS_FEATURES = {
    "all": ("amount_tsh", "installer10", "longitude", "latitude", "gps_height", "permit", "pop_log3", "years_op",
            "extraction_type_group", "management", "payment_type", "source_type", "waterpoint_type"),
    "fewer": ("installer10", "gps_height", "years_op", "payment_type", "region", "source_type", "waterpoint_type"),
}
TWO_CLASS = "status_group2"
NEIGHBOURS = 7
POPULATION_NEIGHBOURS = 5


def join_labels(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Every labelled well, label columns first."""
    return left_join(labels, features, KEY)


def row_cleaning(df: DataFrame) -> DataFrame:
    """Everything that needs only the row itself, in two projections."""
    cleaned = df.drop(*DROPPED).withColumns(
        {
            "amount_log": log10_or_zero("amount_tsh"),
            "year_recorded": year_of("date_recorded"),
            "pop_log": log10_or_zero("population"),
            "scheme_management": recode(blank_to(F.lower("scheme_management"), [""]), SCHEME_LEVELS),
            "permit": blank_to("permit", [""]),
            "management": recode("management", MANAGEMENT_LEVELS),
            "funder_name": canonicalize(blank_to(F.lower("funder")), FUNDER_RULES),
            "installer_name": canonicalize(blank_to(F.lower("installer")), INSTALLER_RULES),
        }
    )
    return cleaned


@dataclass(frozen=True)
class WellsCleanerModel:
    years: ServiceYearsModel
    lumpers: Mapping[str, TopKLumperModel]
    population: NeighbourIndex
    medians: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        rows = self.years.transform(row_cleaning(df))
        cleaned = rows
        for output, lumper in self.lumpers.items():
            cleaned = lumper.transform(cleaned, output)
        cleaned = cleaned.drop("funder_name", "installer_name")
        cleaned = impute_group_median(cleaned, "region_code", "population", output="population2", medians=self.medians)
        cleaned = cleaned.withColumn("pop_log2", log10_or_zero("population2"))
        # a well without a known population gets the mean of its nearest known wells
        missing = F.col("pop_log") == 0
        near = self.population.join(rows.filter(missing).select(KEY, "latitude", "longitude"), KEY)
        means = near.groupBy(KEY).agg(F.avg("pop_log").alias("__mean"))
        filled = F.when(missing, F.col("__mean")).otherwise(F.col("pop_log"))
        return cleaned.join(means, KEY, "left").withColumn("pop_log3", filled).drop("__mean")


class WellsCleaner:
    """Learns the median building year, the kept names and the known populations."""

    def __init__(self, small: int = 10, large: int = 20, neighbours: int = POPULATION_NEIGHBOURS):
        self.sizes, self.neighbours = (small, large), neighbours

    def fit(self, train: DataFrame) -> WellsCleanerModel:
        cleaned = row_cleaning(train)
        lumpers = {
            f"{name}{label}": TopKLumper(f"{name}_name", k).fit(cleaned)
            for name in ("funder", "installer")
            for label, k in zip((10, 20), self.sizes)
        }
        known = cleaned.filter(F.col("population") > 1)
        population = NeighbourIndex(KEY, ["latitude", "longitude"], self.neighbours, ["pop_log"]).fit(known)
        medians = stage(group_medians(cleaned, "region_code", "population"), "medians")
        return WellsCleanerModel(ServiceYears("year_recorded", "construction_year").fit(cleaned), lumpers, population, medians)


@dataclass(frozen=True)
class NeighbourClassifier:
    """k-NN on standardized numbers; the fitted scaling is also used when scoring."""

    index: NeighbourIndex
    scaler: object
    features: Sequence[str]
    label: str

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str] = NEIGHBOUR_FEATURES, label: str = TARGET, k: int = NEIGHBOURS) -> NeighbourClassifier:
        scaler = Standardizer(features).fit(train)
        index = NeighbourIndex(KEY, list(features), k, [label]).fit(scaler.transform(train.select(KEY, label, *features)))
        return cls(index, scaler, features, label)

    def score(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        near = self.index.join(self.scaler.transform(df.select(KEY, *self.features)), KEY)
        return vote(near, KEY, self.label, output)


@dataclass(frozen=True)
class WellsModels:
    """The fitted single models and the stack over their predictions."""

    pipelines: Mapping[str, PipelineModel]
    knn: NeighbourClassifier
    stacked: PipelineModel

    def predictions(self, df: DataFrame) -> DataFrame:
        """(id, rf, leak, xgb, log, knn, vote, stack)."""
        trees = scoring.score_many(self.pipelines, df, KEY)
        table = trees.join(self.knn.score(df, "knn"), KEY, "left")
        table = table.withColumn("vote", ensemble.dissent_vote("rf", ["xgb", "log", "knn"]))
        return self.stacked.transform(table).select(*table.columns, F.col(PREDICTION).alias("stack"))

    def submissions(self, df: DataFrame, folder: str) -> list[str]:
        """One CSV of (id, status_group) per model."""
        table = stage(self.predictions(df), "predictions")
        paths = []
        for name in ("rf", "leak", "xgb", "vote", "stack"):
            path = f"{folder}/submission_{name}.csv"
            write_table(table.select(KEY, F.col(name).alias(TARGET)), path)
            paths.append(path)
        return paths


def fit_models(train: DataFrame, k: int = 10, forest_params: Mapping | None = None, boosted_params: Mapping | None = None,
               stack_params: Mapping | None = None, parallelism: int = 2) -> WellsModels:
    """Fit all models on a cleaned training table; the stack learns from held-out folds."""
    rf = forest(**{"ntree": 201, "mtry": 3, **(forest_params or {})})
    xgb, log = boosted(**(boosted_params or {})), logistic("multinomial")
    pipelines = {
        "rf": fit_classifier(rf, train, TARGET, FOREST_FEATURES),
        "leak": fit_classifier(rf, train, TARGET, [*FOREST_FEATURES, *LEAKY_FEATURES]),
        "xgb": fit_classifier(xgb, train, TARGET, BOOSTED_FEATURES, onehot=True),
        "log": fit_classifier(log, train, TARGET, MULTINOMIAL_FEATURES, onehot=True),
    }
    scaled = Standardizer(NEIGHBOUR_FEATURES).fit(train).transform(train.select(KEY, TARGET, *NEIGHBOUR_FEATURES))
    held_out = {
        "rf": validate.cross_validate(rf, train, KEY, TARGET, FOREST_FEATURES, k, parallelism=parallelism),
        "xgb": validate.cross_validate(xgb, train, KEY, TARGET, BOOSTED_FEATURES, k, True, parallelism),
        "log": validate.cross_validate(log, train, KEY, TARGET, MULTINOMIAL_FEATURES, k, True, parallelism),
        "knn": validate.cross_validate_knn(scaled, KEY, TARGET, list(NEIGHBOUR_FEATURES), NEIGHBOURS, k),
    }
    stacked = ensemble.stack(ensemble.prediction_table(held_out), list(held_out), **(stack_params or {}))
    return WellsModels(pipelines, NeighbourClassifier.fit(train), stacked)


SELECTED_FEATURES = tuple(c for c in BOOSTED_FEATURES if c not in ELIMINATED)


def eliminate_features(train: DataFrame, sizes: Sequence[int] = SIZES, k: int = 10, ntree: int = 501) -> DataFrame:
    """(size, k, accuracy, accuracy_sd, ci) of recursive elimination."""
    make = lambda n: forest(ntree, max(1, round(n**0.5)))
    held_out = validate.rfe(make, train, KEY, TARGET, BOOSTED_FEATURES, sizes, k, ranking={"ntree": ntree})
    return validate.summarize_folds(validate.fold_accuracy(held_out, ["size"]), ["size"])


def rank_features(train: DataFrame, ntree: int = 501) -> DataFrame:
    """(feature, accuracy_drop, sd) out of bag, on the whole training table."""
    return validate.rank_features(train, KEY, TARGET, BOOSTED_FEATURES, ntree=ntree)


def tune_forest(train: DataFrame, trees: Sequence[int] = TREE_COUNTS, mtry: Sequence[int] = COLUMNS_TRIED, k: int = 10, ntree: int = 201) -> DataFrame:
    """(setting, k, accuracy, accuracy_sd, ci) for each tree count with 3 columns tried, and each number of columns.

    The tree counts are prefixes of one forest per fold.
    """
    counts = validate.tune_tree_counts(lambda n: forest(n, 3), train, KEY, TARGET, SELECTED_FEATURES, trees, k)
    columns = validate.tune(lambda mtry: forest(ntree, mtry), train, KEY, TARGET, SELECTED_FEATURES, [{"mtry": m} for m in mtry], k)
    held_out = counts.unionByName(columns.drop("probability"))
    return validate.summarize_folds(validate.fold_accuracy(held_out))


def substitute_features(train: DataFrame, k: int = 10, ntree: int = 201, mtry: int = 3) -> DataFrame:
    """(setting, k, accuracy, accuracy_sd, ci) of the selected features and of each single substitution."""
    held_out = validate.ablate(forest(ntree, mtry), train, KEY, TARGET, SELECTED_FEATURES, SUBSTITUTIONS, k)
    return validate.summarize_folds(validate.fold_accuracy(held_out))


def with_two_classes(df: DataFrame) -> DataFrame:
    """Wells in need of repair count as not functional."""
    return df.withColumn(TWO_CLASS, collapse_target(TARGET, ["functional"], "functional", "non functional"))


def two_class_models(train: DataFrame, k: int = 10) -> DataFrame:
    """Held-out predictions of the two-class logistic model, with ``setting`` naming its feature list."""
    rows = with_two_classes(train)
    parts = [
        validate.cross_validate(logistic("binomial"), rows, KEY, TWO_CLASS, features, k, onehot=True).withColumn("setting", F.lit(name))
        for name, features in TWO_CLASS_FEATURES.items()
    ]
    return validate.union_all(parts)


def compare_accuracies(held_out: Mapping[str, DataFrame], holdout: DataFrame, models: Sequence[str]) -> DataFrame:
    """(model, accuracy, ci, holdout): cross-validated accuracy beside that on other labelled wells.

    ``holdout`` has the target and a prediction column per model; a model that was not
    cross-validated (vote, stack) has no accuracy of its own.
    """
    parts = [
        validate.summarize_folds(validate.fold_accuracy(df.withColumn("model", F.lit(name)), ["model"]), ["model"])
        for name, df in held_out.items()
    ]
    results = validate.union_all(parts).select("model", "accuracy", "ci")
    other = evaluate.accuracy_by_model(holdout, list(models), TARGET).withColumnRenamed("accuracy", "holdout")
    return evaluate.compare_models(results, other)


def age_to(year: int):
    """What-if change: every well as old as it will be in ``year``."""
    return {"years_op": F.col("years_op") + (F.lit(year) - F.col("year_recorded"))}


def class_changes(model: PipelineModel, df: DataFrame, year: int = 2019) -> DataFrame:
    """(id, before, after) predicted classes when all wells age to ``year``."""
    return scoring.what_if(model, df, KEY, age_to(year))


def missing_rules(df: DataFrame) -> dict:
    """What counts as missing in each column of the raw table."""
    rules = {c: F.col(c) == 0 for c in ("amount_tsh", "longitude", "latitude", "construction_year")}
    rules["population"] = F.col("population") < 2
    for c in ("funder", "installer"):
        rules[c] = F.col(c).isin(*BLANK_TOKENS)
    for c in ("scheme_management", "permit"):
        rules[c] = F.col(c) == ""
    return {c: rule for c, rule in rules.items() if c in df.columns}
