"""Toxic passages as maximum-scoring segments, calibrated by extreme values.

Words and their first bytes are counted in toxic and in clean labelled documents. The
log-odds of each with a Dirichlet prior drawn from the whole sample, less ``CAUTION`` standard
deviations, is what it adds to a passage; a word counts as the strongest of its forms, and
every word costs ``COST``. One linear scan finds all maximal-scoring segments of a text, over
its few positive words and running sums. Their significance follows the extreme-value law:
a text of n clean words has about K n exp(-lambda S) segments of score S or more, where
lambda solves E[exp(lambda s)] = 1 over the words of clean documents and K fits their best
segments. A document's score is a logistic function of lambda S - ln(K n) for its best S.

The model is fitted on at most about ``LABELLED`` labelled documents, so the labels, the 2**18
hashed features and the calibration rows are of bounded size.

Defined cases: null and blank texts have no segment and get the score that goes with it; a
null or other label than 0 and 1 teaches nothing; without both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .labels import training_labels
from .text import NOT_WORDLIKE, words

LABELLED = 200_000
BITS = 18
PREFIXES = (4, 5, 6)
PRIOR_SHARE = 0.02
CAUTION = 1.64
LEAST, MOST, COST = 2.0, 8.0, 0.03
SIGNIFICANT = 0.01
STEP = 0.25


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, starts = words(column, NOT_WORDLIKE, PREFIXES)
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64), starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        label = batch.column("y").to_numpy()
        for y in (0, 1):
            keys, _ = _buckets(batch.column("text").filter(pa.array(label == y)))
            totals[y] += np.bincount(keys.ravel(), minlength=1 << BITS)
    some = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[0, some]), pa.array(totals[1, some])], ["bucket", "clean", "toxic"])


def log_odds(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-odds with an informative Dirichlet prior, less ``CAUTION`` standard deviations."""
    prior = PRIOR_SHARE * (clean + toxic)
    total = prior.sum()
    odds = lambda y: np.log((y + prior) / (y.sum() + total - y - prior))
    return odds(toxic) - odds(clean) - CAUTION * np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, after last, score), in linear time.

    Only positive scores are visited one by one; what lies between is in the running sums.
    """
    ahead = np.concatenate(([0.0], np.cumsum(scores)))
    left: list[float] = []
    right: list[float] = []
    span: list[tuple[int, int]] = []
    before: list[int] = []  # the last earlier candidate that begins lower
    for at in np.flatnonzero(scores > 0):
        low, high, first = ahead[at], ahead[at + 1], int(at)
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = before[j]
            if j < 0 or right[j] >= high:
                break
            low, first, cut = left[j], span[j][0], j
            j = before[j]
            del left[cut:], right[cut:], span[cut:], before[cut:]
        left.append(low)
        right.append(high)
        span.append((first, int(at) + 1))
        before.append(j)
    return [(a, b, float(r - l)) for (a, b), l, r in zip(span, left, right)]


def _measure(table: np.ndarray):
    """Per labelled document its best segment and length; per task the scores of clean words in bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(int((MOST + COST) / STEP) + 2, np.int64)
        as_batch = lambda kind, *c: pa.RecordBatch.from_arrays([pa.array(np.full(len(c[0]), kind, np.int32)), *(pa.array(np.asarray(x, float)) for x in c)], ["kind", "a", "b", "c"])
        for batch in batches:
            label = batch.column("y").to_numpy()
            keys, starts = _buckets(batch.column("text"))
            scores = table[keys].max(axis=1) - COST
            clean = np.repeat(label == 0, np.diff(starts))
            bins += np.bincount(np.rint((scores[clean] + COST) / STEP).astype(np.int64), minlength=len(bins))
            best = [max((s for _, _, s in segments(scores[a:b])), default=0.0) for a, b in zip(starts[:-1], starts[1:])]
            yield as_batch(0, label, best, np.diff(starts))
        yield as_batch(1, np.arange(len(bins)), bins, bins)

    return run


def _decay(bins: np.ndarray) -> float:
    """The positive lambda with E[exp(lambda s)] = 1 over binned scores."""
    share, value = bins / bins.sum(), np.arange(len(bins)) * STEP - COST
    if not (share[value > 0]).sum() or share @ value >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while share @ np.exp(high * value) < 1:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if share @ np.exp(middle * value) < 1 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a slight pull of the slope to 0."""
    design, w = np.column_stack([x, np.ones(len(x))]), np.array([0.0, np.log(y.mean() / (1 - y.mean()))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hessian, design.T @ (p - y) + np.array([1e-2 * w[0], 0]))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


class ToxicityModel:
    """What each hashed form adds to a passage, the extreme-value law, and its logistic calibration."""

    def __init__(self, table: np.ndarray, decay: float, log_k: float, slope: float, offset: float):
        self.table, self.decay, self.log_k, self.slope, self.offset = table, decay, log_k, slope, offset

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, column: str = "toxic", bound: int = LABELLED) -> ToxicityModel:
        """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, column) outside the held-out fold."""
        sample = F.broadcast(training_labels(labels, column, bound))  # about ``bound`` rows of twelve bytes
        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("text", "y")
        counted = text.mapInArrow(_count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        found = counted.toPandas()  # at most 2**BITS rows
        table = np.zeros(1 << BITS)
        if len(found) and found["toxic"].any() and found["clean"].any():
            odds = log_odds(found["clean"].to_numpy(float), found["toxic"].to_numpy(float))
            table[found["bucket"]] = np.where(odds >= LEAST, np.minimum(odds, MOST), 0.0)
        shared = docs.sparkSession.sparkContext.broadcast(table)
        measured = stage(text.mapInArrow(lambda it: _measure(shared.value)(it), "kind int, a double, b double, c double"), "measured")
        bins = measured.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).orderBy("a").toPandas()["n"].to_numpy(float)
        rows = measured.where("kind = 0").select("a", "b", "c").toPandas()  # about ``bound`` rows
        y = rows["a"].to_numpy()
        if not len(y) or y.min() == y.max():
            return cls(table, 1.0, 0.0, 0.0, -np.inf)
        decay = _decay(bins) if bins.sum() else 1.0
        excess = decay * rows["b"].to_numpy() - np.log(np.maximum(rows["c"].to_numpy(), 1))
        log_k = float(excess[y == 0].mean() - np.euler_gamma)
        return cls(table, decay, log_k, *_logistic(excess - log_k, y))

    def _score(self, column: pa.Array):
        keys, starts = _buckets(column)
        scores = self.table[keys].max(axis=1) - COST
        best, passages = np.zeros(len(starts) - 1), []
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            found = segments(scores[a:b])
            best[i] = max((s for _, _, s in found), default=0.0)
            rate = self.log_k + np.log(max(b - a, 1))
            rated = ((x, y, s, float(np.exp(min(rate - self.decay * s, 50.0)))) for x, y, s in found)
            passages.append([{"first_word": x, "after_word": y, "score": s, "expected": e} for x, y, s, e in rated if e <= SIGNIFICANT])
        excess = self.decay * best - np.log(np.maximum(np.diff(starts), 1)) - self.log_k
        if not np.isfinite(self.offset):
            return np.zeros(len(best)), passages
        return 1 / (1 + np.exp(-np.clip(self.slope * excess + self.offset, -500, 500))), passages

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score, and the significant passages: word positions, score, and how many a clean text would have."""
        model = docs.sparkSession.sparkContext.broadcast(self)
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("after_word", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score, passages = model.value._score(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(passages, kind)], ["doc_id", "score", "passages"])

        schema = "doc_id long, score double, passages array<struct<first_word:long,after_word:long,score:double,expected:double>>"
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
