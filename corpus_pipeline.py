"""From raw documents to packed batches, stage by stage.

Each stage takes the documents its predecessor kept and returns documents with the same
columns; the last returns where every document is packed. A stage's result is written as
Parquet and read again.

Defined cases: a null, empty or blank text has no language and goes in the first stage (if
there is a language to learn); a null ``lang`` teaches nothing, a null ``source`` is a source of
its own, a null ``doc_id`` is near no other document; texts of any length are read whole in
every stage; repeated rows stay or go together, are redacted, mixed and packed each; other
columns pass through unchanged up to the last stage, whatever their names (those the stages
use themselves begin with two underscores); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixedframe.llm.language import LanguageModel, held_out, rejected
from mixedframe.llm.mixing import mix_sources
from mixedframe.llm.neardup import near_duplicates
from mixedframe.llm.packing import pack
from mixedframe.llm.secret_scan import redact_secrets
from mixedframe.session import stage


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that clearly fits best, go.

    The model is learned from two thirds of the documents that have a lang. Where no
    document has one, nothing can be judged and all stay.
    """
    model = LanguageModel.fit(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    if not model.langs:
        return docs
    names = ("__lang_pred", "__lang_score")
    return model.predict(docs, names=names).where(~rejected(names=names)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together; rows without one stay.
    """
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets are replaced by a mark."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get square-root weights: documents are repeated or left out at random, in a new order."""
    return mix_sources(docs).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document copy."""
    return pack(docs)


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", remove_secrets),
    ("mixing", mix),
    ("packing", pack_batches),
]

#: SQL can express neither the language model nor the optimal buckets
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        rows = stage(apply(spark, rows, sf_dir), name)
    return rows
