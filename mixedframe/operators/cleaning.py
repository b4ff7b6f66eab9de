"""Learned cleaning steps: fitted on one table, applied to any."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import years_in_service
from ..session import stage
from .joins import join_null_safe
from .ordered import exact_median
from .profile import top_k_values, value_counts


@dataclass(frozen=True)
class TopKLumperModel:
    """Keeps the fitted levels of ``col`` and writes ``other`` for every other value.

    The levels are a stored table, so there may be any number of them.
    """

    col: str
    levels: DataFrame
    other: str = "other"

    def transform(self, df: DataFrame, output: str | None = None) -> DataFrame:
        kept = self.levels.select(F.col(self.col).alias("__level"))
        joined = df.join(kept, F.col(self.col) == F.col("__level"), "left")
        return joined.withColumn(output or self.col, F.coalesce("__level", F.lit(self.other))).drop("__level")


@dataclass(frozen=True)
class TopKLumper:
    """Learns the k most frequent levels; ties go to the alphabetically first."""

    col: str
    k: int
    other: str = "other"

    def fit(self, df: DataFrame) -> TopKLumperModel:
        top = top_k_values(df.filter(F.col(self.col).isNotNull()), self.col, self.k)
        return TopKLumperModel(self.col, stage(top.select(self.col), "levels"), self.other)


@dataclass(frozen=True)
class ServiceYearsModel:
    recorded: str
    built: str
    median_built: float

    def transform(self, df: DataFrame, output: str = "years_op") -> DataFrame:
        return df.withColumn(output, years_in_service(self.recorded, self.built, self.median_built))


@dataclass(frozen=True)
class ServiceYears:
    """Learns the median of the known (non-zero) building years."""

    recorded: str
    built: str

    def fit(self, df: DataFrame) -> ServiceYearsModel:
        known = df.filter(F.col(self.built) > 0)
        row = exact_median(known, self.built).first()
        if row is None or row[0] is None:
            raise ValueError(f"no known value in {self.built}")
        return ServiceYearsModel(self.recorded, self.built, float(row[0]))


def align_levels(df: DataFrame, train: DataFrame, col: str, output: str, unknown: str | None = None) -> DataFrame:
    """Impose the levels seen in ``train``: any other value becomes ``unknown``."""
    seen = train.select(col).distinct().withColumn("__seen", F.lit(True))
    joined = join_null_safe(df, seen, [col], "left")
    value: Column = F.when(F.col("__seen"), F.col(col)).otherwise(F.lit(unknown))
    return joined.withColumn(output, value).drop("__seen")


def regex_value_counts(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Counts of the distinct values that match a pattern."""
    return value_counts(df.filter(F.col(col).rlike(pattern)), col)
