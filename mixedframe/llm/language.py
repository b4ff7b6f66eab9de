"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams per language in every task and adds the counts up in a
shuffle; a language ends as one row of log-probabilities (65,536 32-bit floats). The matrix of
up to ``BLOCK`` languages (64 MB) is broadcast at once; with more of them the documents are
scored block by block, each keeping the best language so far and the sum of all posterior
weights. A text's score is the posterior share of the predicted language; among equal ones
the first by name wins.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is
everything when there is nothing to learn from; a null doc_id counts as the empty text in
the split; columns with the names of the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

BITS = 16
ORDERS = 3
ALPHA = 0.1
BLOCK = 256
#: n-grams x languages scored at once
AT_ONCE = 1 << 21
PIECE = 1 << 18
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of about PIECE characters: code points, starts of the pieces, n-grams to begin in each, its text.

    A longer text is cut into pieces that overlap, so that no n-gram is lost or counted twice.
    """
    parts, begun, owner, held = [], [], [], 0

    def run():
        sizes = np.array([len(p) for p in parts], np.int64)
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        return points, np.cumsum(np.concatenate(([0], sizes))), np.array(begun, np.int64), np.array(owner, np.int64)

    for i, text in enumerate(texts):
        text = (text or "").lower()
        for at in range(0, len(text), PIECE):
            parts.append(text[at : at + PIECE + ORDERS - 1])
            begun.append(min(PIECE, len(text) - at))
            owner.append(i)
            held += len(parts[-1])
            if held >= PIECE:
                yield run()
                parts, begun, owner, held = [], [], [], 0
    if parts:
        yield run()


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of n-grams, the text of each, and which texts of the run have a letter (a row for each n-gram order)."""
    for points, starts, begun, owner in _pieces(texts):
        at = np.arange(len(points))
        piece = np.repeat(np.arange(len(begun)), np.diff(starts))
        within = at - starts[piece]
        left = starts[piece + 1] - at
        hashed = np.zeros(len(points), np.uint32)
        lettered = np.unique(owner[piece[letters()[np.minimum(points, 0x10FFFF)]]])
        for order in range(1, ORDERS + 1):
            hashed[: len(points) - order + 1] += points[order - 1 :] * _FACTORS[order - 1]
            use = (within < begun[piece]) & (left >= order)
            key = hashed[use] + np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF)
            key = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            key = (key ^ (key >> np.uint32(12))) * np.uint32(0x297A2D39)
            yield (key >> np.uint32(32 - BITS)).astype(np.int64), owner[piece[use]], lettered


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text leaves ``fold`` modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in set(langs):
            own = totals.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
            rows = [i for i, x in enumerate(langs) if x == lang]
            own[-1] += len(rows)
            for keys, _, _ in ngrams(batch.column("text").take(pa.array(rows)).to_pylist()):
                own[:-1] += np.bincount(keys, minlength=1 << BITS)
    for lang, own in totals.items():
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(own[some])], ["lang", "bucket", "n"])


def _log_shares(key: tuple, table: pa.Table) -> pa.Table:
    counts = np.zeros((1 << BITS) + 1)
    counts[table["bucket"].to_numpy()] = table["n"].to_numpy()
    grams = counts[:-1] + ALPHA
    row = np.log(grams / grams.sum()).astype("<f4").tobytes()
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "texts": pa.array([int(counts[-1])], pa.int64()), "log_share": pa.array([row], pa.binary())})


def fits_of(texts: list[str | None], prior: np.ndarray, log_share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each text in each language (columns of ``log_share``), and which texts have a letter."""
    fits = np.zeros((len(texts), len(prior))) + prior
    spoken = np.zeros(len(texts), bool)
    step = max(1, AT_ONCE // max(1, len(prior)))
    for keys, owner, lettered in ngrams(texts):
        spoken[lettered] = True
        for at in range(0, len(keys), step):
            own = owner[at : at + step]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            fits[own[first]] += np.add.reduceat(log_share[keys[at : at + step]].astype(np.float64), first, axis=0)
    return fits, spoken


class LanguageModel:
    """Log-probabilities of the n-gram buckets for each language learned, in a stored table (lang, texts, log_share)."""

    def __init__(self, learned: DataFrame, langs: list[str], texts: list[int], block: int = BLOCK):
        self.learned, self.langs, self.block = learned, langs, block
        self.prior = np.log(np.array(texts, float) / max(1, sum(texts)))

    @classmethod
    def fit(cls, rows: DataFrame, block: int = BLOCK) -> LanguageModel:
        """Learn from all rows (text, lang) whose lang is not null."""
        rows = rows.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
        counted = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        learned = stage(counted.groupBy("lang").applyInArrow(_log_shares, "lang string, texts long, log_share binary"), "languages")
        found = sorted((r.lang, r.texts) for r in learned.select("lang", "texts").collect())
        return cls(learned, [r[0] for r in found], [r[1] for r in found], block)

    def matrices(self) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Names, log priors and the matrix (n-gram buckets x languages) of ``block`` languages at a time."""
        for at in range(0, len(self.langs), self.block):
            names = self.langs[at : at + self.block]
            shares = {r.lang: np.frombuffer(r.log_share, "<f4") for r in self.learned.where(F.col("lang").isin(names)).collect()}
            yield names, self.prior[at : at + self.block], np.ascontiguousarray(np.stack([shares[n] for n in names], axis=1))

    def predict(self, docs: DataFrame, drop: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
        """``docs`` with the predicted language and its score, without the columns named in ``drop``."""
        docs = docs.drop(*names)
        kept = [c for c in docs.columns if c not in drop]
        if not self.langs:
            return docs.select(*kept, F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]))
        best, fit, rest, said = "__lang_best", "__lang_fit", "__lang_rest", "__lang_said"
        state = [T.StructField(best, T.StringType()), T.StructField(fit, T.DoubleType()), T.StructField(rest, T.DoubleType()), T.StructField(said, T.BooleanType())]
        n_blocks = -(-len(self.langs) // self.block)
        rows = docs
        for i, matrix in enumerate(self.matrices()):
            keep = [c for c in docs.columns if c in kept or (c == "text" and i + 1 < n_blocks)]
            model = docs.sparkSession.sparkContext.broadcast(matrix)
            scored = lambda it, m=model, k=keep, first=i == 0: _scored(it, m, k, first)
            rows = rows.mapInArrow(scored, T.StructType([docs.schema[c] for c in keep] + state))
            if i + 1 < n_blocks:
                rows = stage(rows, "scored")
                model.unpersist()
        lang = F.when(F.col(said), F.col(best)).otherwise(UNKNOWN)
        return rows.select(*kept, lang.alias(names[0]), F.when(F.col(said), 1 / F.col(rest)).otherwise(0.0).alias(names[1]))


def _scored(batches: Iterator[pa.RecordBatch], model, kept: list[str], first: bool) -> Iterator[pa.RecordBatch]:
    """The best language so far, its fit, and the sum of exp(fit - best fit) over all languages so far."""
    langs, prior, log_share = model.value
    for batch in batches:
        fits, spoken = fits_of(batch.column("text").to_pylist(), prior, log_share)
        at = fits.argmax(axis=1)
        top = fits.max(axis=1)
        rest = np.exp(fits - top[:, None]).sum(axis=1)
        names = np.array(langs, object)[at]
        if not first:
            before, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__lang_fit", "__lang_rest"))
            names = np.where(top > before, names, batch.column("__lang_best").to_numpy(zero_copy_only=False))
            most = np.maximum(top, before)
            rest, top = rest * np.exp(top - most) + own * np.exp(before - most), most
        state = [pa.array(names, pa.string()), pa.array(top), pa.array(rest), pa.array(spoken)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *state], [*kept, "__lang_best", "__lang_fit", "__lang_rest", "__lang_said"])


def rejected(min_score: float = 0.5, names: tuple[str, str] = ("lang_pred", "score")) -> Column:
    """Whether a scored document has no language worth keeping: no letter, or no clear winner."""
    return (F.col(names[0]) == UNKNOWN) | (F.col(names[1]) < min_score)
