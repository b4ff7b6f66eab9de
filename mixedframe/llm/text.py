"""Whole Arrow text columns as hashed words and n-grams, in numpy.

A column is cut into runs of about ``RUN`` bytes (between words, so a text of any length is
read in pieces), and each run is handled as one array: no loop over characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

#: word bytes are all but the space and tab to carriage return
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: word bytes are ASCII letters, digits and every byte of a longer character
NOT_WORDLIKE = np.ones(256, bool)
NOT_WORDLIKE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def byte_values() -> np.ndarray:
    """A scrambled value of each byte, A-Z as a-z."""
    lowered = np.arange(256, dtype=np.uint64)
    lowered[0x41:0x5B] += np.uint64(32)
    return mix(lowered + np.uint64(0x51ED270B))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and its inverse modulo 2**64, for i up to n."""
    if len(_powers[0]) <= n:
        size, inverse = max(n + 1, RUN + 4096), np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, factor in enumerate((BASE, inverse)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and where each text starts (one more entry than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(starts):
        starts = np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def runs(data: np.ndarray, starts: np.ndarray, cut: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``RUN`` bytes that end at a text's end or at a byte where ``cut`` holds."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + RUN, n)
        if end < n:
            edge = starts[np.searchsorted(starts, end, "right") - 1]
            if edge > at:
                end = int(edge)
            else:  # inside one long text
                stop = int(starts[np.searchsorted(starts, at, "right")])
                end = min(end, stop)
                while end < stop and not cut[data[end]]:
                    ahead = np.flatnonzero(cut[data[end : min(end + RUN, stop)]])
                    end = end + int(ahead[0]) if len(ahead) else min(end + RUN, stop)
        yield at, end
        at = end


def words(column: pa.Array, separators: np.ndarray = BLANKS, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, letters A-Z folded, and where each text's words start.

    The hashes have one column for the word and one for each prefix length in bytes (a
    shorter word stands for its own prefix).
    """
    data, starts = utf8(column)
    found, counts = [], np.zeros(len(starts), np.int64)
    for a, b in runs(data, starts, separators):
        part = data[a:b]
        inside = ~separators[part]
        edges = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
        begins, ends = inside.copy(), inside.copy()
        fresh = np.zeros(len(part), bool)
        fresh[edges] = True
        fresh[0] = True
        begins[1:] &= ~inside[:-1] | fresh[1:]
        ends[:-1] &= ~inside[1:] | fresh[1:]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte_values()[part] * up[: len(part)], out=sums[1:])
        columns = [mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))]
        for k, size in enumerate(prefixes):
            stop = np.minimum(first + size, last)
            columns.append(mix((sums[stop] - sums[first]) * down[first] + np.uint64(0xA5A5 + k)))
        found.append(np.stack(columns, axis=1))
        owner = np.searchsorted(starts, first + a, "right") - 1
        counts += np.bincount(owner + 1, minlength=len(counts))[: len(counts)]
    hashes = np.concatenate(found) if found else np.zeros((0, 1 + len(prefixes)), np.uint64)
    return hashes, np.cumsum(counts)


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its ``size``-word shingles.

    A text with fewer words gives its whole word sequence as one shingle, one without
    words gives none.
    """
    hashes, starts = words(column)
    hashes = hashes[:, 0]
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    whole = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for k in range(size):
        whole += hashes[k : len(hashes) - size + 1 + k] * factors[k]
    whole = mix(whole)
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= size:
            own = np.sort(whole[a : b - size + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
        elif b > a:
            yield mix((hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield hashes[:0]
