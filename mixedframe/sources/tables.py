"""Table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row and declared types.

    The schema is always declared: inference would need a second pass and would
    turn a True/False category into a boolean. A blank text field is a level of
    its own (""), a blank number is null.
    """
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(
        *[
            F.coalesce(F.col(f.name), F.lit("")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in raw.schema
        ]
    )


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header row in every part file, written by the executors in parallel."""
    df.write.mode(mode).option("header", True).csv(path)


def save_results(df: DataFrame, path: str, mode: str = "error") -> None:
    """Keep a result table (metrics, grids) apart from the heavy model."""
    df.write.mode(mode).parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
