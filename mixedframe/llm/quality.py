"""Text quality: histogram gradient-boosted trees over document statistics.

One pass over the texts gives each document's statistics, in numpy over byte arrays. The
trees are fitted on at most about ``LABELLED`` labelled documents: statistics become bin
numbers once, every level of a tree is one histogram of gradients per statistic. Trees are
complete and stored as flat arrays, so scoring walks all trees and documents at once.

Defined cases: null and blank texts have all statistics 0 and are scored like any other; a
label that is null or not 0 or 1 teaches nothing; without labels every score is 0.5, with
one class only it is that class; a text of any length is measured whole, in runs of about a
megabyte; repeated rows are scored each, and a repeated label counts each time; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .labels import training_labels
from .text import RUN, utf8, words

LABELLED = 50_000
TREES, DEPTH, BINS = 60, 4, 64
RATE, PENALTY, LEAST_WEIGHT = 0.15, 1.0, 2.0

STATISTICS = (
    "log_words", "word_length", "upper", "digits", "symbols", "exclamations", "bars", "stops", "non_ascii", "blanks",
    "distinct_words", "commonest_word", "distinct_lines", "line_words", "capitalised",
)

_CLASSES = ("other", "lower", "upper", "digit", "blank", "newline", "stop", "exclamation", "bar", "symbol", "non_ascii", "continuation")


def _class_of_byte() -> np.ndarray:
    of = np.zeros(256, np.int64)
    for name, members in (
        ("lower", range(0x61, 0x7B)), ("upper", range(0x41, 0x5B)), ("digit", range(0x30, 0x3A)), ("blank", (0x20, 0x09, 0x0B, 0x0C, 0x0D)),
        ("newline", (0x0A,)), ("stop", b".,;:?"), ("exclamation", b"!"), ("bar", b"|"), ("symbol", b"#$%&*+<=>@^_`~\\/{}[]"),
        ("continuation", range(0x80, 0xC0)), ("non_ascii", range(0xC0, 0x100)),
    ):
        of[list(members)] = _CLASSES.index(name)
    return of


_OF_BYTE = _class_of_byte()
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    data, starts = utf8(column)
    n, classes = len(starts) - 1, len(_CLASSES)
    counts = np.zeros(n * classes, np.int64)
    for at in range(0, len(data), RUN):
        owner = np.searchsorted(starts, np.arange(at, min(at + RUN, len(data))), "right") - 1
        key = owner * classes + _OF_BYTE[data[at : at + RUN]]
        low = int(owner[0]) * classes
        own = np.bincount(key - low)
        counts[low : low + len(own)] += own
    c = dict(zip(_CLASSES, counts.reshape(n, classes).T.astype(float)))
    chars = np.maximum(counts.reshape(n, classes).sum(axis=1) - c["continuation"], 1)
    hashes, edges = words(column)
    lines, line_edges = words(column, _NEWLINE)
    n_words, n_lines = np.diff(edges).astype(float), np.diff(line_edges).astype(float)
    distinct, commonest, distinct_lines = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        own = np.sort(hashes[edges[i] : edges[i + 1], 0])
        if len(own):
            begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            distinct[i], commonest[i] = len(begins), np.diff(np.append(begins, len(own))).max()
        if n_lines[i]:
            distinct_lines[i] = len(np.unique(lines[line_edges[i] : line_edges[i + 1], 0]))
    per_word, per_line = np.maximum(n_words, 1), np.maximum(n_lines, 1)
    letters = np.maximum(c["lower"] + c["upper"] + c["non_ascii"], 1)
    dark = chars - c["blank"] - c["newline"]
    columns = [
        np.log1p(n_words), dark / per_word, c["upper"] / letters, c["digit"] / chars, c["symbol"] / per_word, c["exclamation"] / per_word,
        c["bar"] / per_word, c["stop"] / per_word, c["non_ascii"] / letters, c["blank"] / chars, distinct / per_word, commonest / per_word,
        distinct_lines / per_line, n_words / per_line, c["upper"] / per_word,
    ]
    return np.where((n_words > 0)[:, None], np.column_stack(columns), 0.0)


class BoostedTrees:
    """Complete trees in flat arrays: for each tree the statistic and threshold of its inner nodes, and leaf values."""

    def __init__(self, start: float, statistic: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.start, self.statistic, self.threshold, self.leaf = start, statistic, threshold, leaf

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> BoostedTrees:
        inner, width = (1 << depth) - 1, x.shape[1] if x.ndim == 2 else 0
        nothing = (np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
        if not len(y):
            return cls(0.0, *nothing)
        if y.min() == y.max():
            return cls(np.inf if y[0] else -np.inf, *nothing)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)])
        start = float(np.log(y.mean() / (1 - y.mean())))
        margin = np.full(len(y), start)
        statistic, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, n = (1 << level) - 1, 1 << level
                here = node - first
                best = np.full(n, 1e-6)
                for f in range(width):
                    key = here * BINS + binned[f]
                    gs = np.bincount(key, g, n * BINS).reshape(n, BINS).cumsum(axis=1)
                    hs = np.bincount(key, h, n * BINS).reshape(n, BINS).cumsum(axis=1)
                    g_all, h_all = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + PENALTY) + (g_all - gs) ** 2 / (h_all - hs + PENALTY) - g_all**2 / (h_all + PENALTY)
                    gain[(hs < LEAST_WEIGHT) | (h_all - hs < LEAST_WEIGHT)] = 0
                    gain = gain[:, : len(cuts[f])]
                    if not gain.shape[1]:
                        continue
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(n), at]
                    better = top > best
                    best[better] = top[better]
                    statistic[t, first + np.flatnonzero(better)] = f
                    threshold[t, first + np.flatnonzero(better)] = cuts[f][at[better]]
                node = 2 * node + 1 + (x[np.arange(len(y)), statistic[t, node]] > threshold[t, node])
            at_leaf = node - inner
            gs, hs = np.bincount(at_leaf, g, inner + 1), np.bincount(at_leaf, h, inner + 1)
            leaf[t] = -RATE * gs / (hs + PENALTY)
            margin += leaf[t, at_leaf]
        return cls(start, statistic, threshold, leaf)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 for each row of statistics."""
        trees, inner = self.statistic.shape
        margin = np.full(len(x), self.start)
        each, depth = np.arange(trees)[:, None], (inner + 1).bit_length() - 1
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.zeros((trees, len(part)), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[np.arange(len(part)), self.statistic[each, node]] > self.threshold[each, node])
            margin[at : at + 4096] += self.leaf[each, node - inner].sum(axis=0)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats``, an array of ``STATISTICS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.FixedSizeListArray.from_arrays(pa.array(statistics(batch.column("text")).ravel()), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists.cast(pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, column: str = "quality", bound: int = LABELLED) -> DataFrame:
    """doc_id, score (share of label 1) and stats of every document."""
    measured = stage(document_statistics(docs), "statistics")
    sample = measured.join(training_labels(labels, column, bound), "doc_id").select("doc_id", "stats", "y").toPandas()  # about ``bound`` rows
    sample = sample.sort_values(["doc_id", "y"], kind="stable")
    x = np.array(sample["stats"].tolist(), float).reshape(len(sample), len(STATISTICS))
    model = docs.sparkSession.sparkContext.broadcast(BoostedTrees.fit(x, sample["y"].to_numpy(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.predict(x)), batch.column("stats")], ["doc_id", "score", "stats"])

    return measured.mapInArrow(run, "doc_id long, score double, stats array<double>")
