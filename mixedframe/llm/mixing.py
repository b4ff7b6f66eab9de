"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of copies its documents need so that the mixture has the
target weights. Each document draws its number of copies by inverting the Poisson
distribution at a uniform number hashed from its id and the seed, so the draw is the same on
every run and on every retry, and no task has to know of any other. Copies are then placed
in a global random order by a hash of id and copy number.

Defined cases: null is a source of its own; rows that share a doc_id share the draw; a
source without a given weight has weight 0; an empty table stays empty; null, empty and very
long texts are documents like any other, as texts are not read; repeated rows are repeated
each; columns of the input pass through, but those named ``__u``, ``__n``, ``__copy``,
``__place``, ``__source`` and ``__below`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: at most so many steps of all sources together (8 MB) are sent to every executor
SMALL = 1_000_000
SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_steps(rate: Column) -> Column:
    """The distribution function of a Poisson law at 0, 1, 2 ..., far beyond the last likely count."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("below"))
    step = lambda s, k: F.struct(
        (s.log_p + F.ln(rate) - F.ln(k)).alias("log_p"),
        F.concat(s.below, F.array(F.element_at(s.below, -1) + F.exp(s.log_p + F.ln(rate) - F.ln(k)))).alias("below"),
    )
    walked = F.aggregate(F.sequence(F.lit(1), last), start, lambda s, k: step(s, k.cast("double")), lambda s: s.below)
    return F.when(rate > 0, walked).otherwise(F.array(F.lit(1.0)))


def mixture_rates(docs: DataFrame, weights: DataFrame | None = None, exponent: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, n, rate): documents of each source and the mean copies of one of them.

    ``weights`` is a table (source, weight); without it a source of n documents has weight
    n ** exponent. The mixture has ``epochs`` times the documents of ``docs``.
    """
    counts = stage(docs.groupBy("source").agg(F.count("*").alias("n")), "sources")
    if weights is None:
        weighed = counts.withColumn("weight", F.sqrt("n") if exponent == 0.5 else F.pow("n", F.lit(float(exponent))))
    else:
        given = weights.select(F.col("source").alias("__source"), F.col("weight").cast("double").alias("weight"))
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        weighed = weighed.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    total, weight = weighed.agg(F.sum("n"), F.sum("weight")).first()
    if not total or not weight:
        return weighed.select("source", "n", F.lit(0.0).alias("rate"))
    # rounded, since the order of a sum over executors is not fixed
    return weighed.select("source", "n", F.round(F.col("weight") / float(f"{weight:.12g}") * float(epochs * total) / F.col("n"), 9).alias("rate"))


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, exponent: float = 0.5, epochs: float = 1.0, seed: str = SEED
) -> DataFrame:
    """The columns of ``docs`` and __copy (from 1) and __place, one row per copy, in order of __place in each part."""
    rates = mixture_rates(docs, weights, exponent, epochs)
    length = rates.agg(F.sum(F.col("rate") + 10 * F.sqrt("rate") + 32)).first()[0] or 0.0
    few = length <= SMALL
    steps = rates.select(F.col("source").alias("__source"), poisson_steps(F.col("rate")).alias("__below"))
    steps = F.broadcast(steps) if few else steps
    drawn = uniform(F.lit(seed), F.col("doc_id"))
    copies = F.size(F.filter("__below", lambda b: b <= F.col("__u")))
    return (
        docs.withColumn("__u", drawn)
        .join(steps, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__n", copies)
        .where("__n > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
        .withColumn("__place", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("__copy").cast("string"))))
        .drop("__u", "__source", "__below", "__n")
        .repartition("__place")
        .sortWithinPartitions("__place")
    )
