"""Whole texts as terms: runs of certain bytes, letters A-Z folded.

Terms end at ASCII characters only, so UTF-8 bytes can be cut without being decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20


def folding(digits: bool) -> bytes:
    """For each byte what it stands for: a-z for A-Z, itself inside a term, a space elsewhere."""

    def stands_for(b: int) -> int:
        if 0x41 <= b <= 0x5A:
            return b + 32
        return b if b >= 0x80 or 0x61 <= b <= 0x7A or (digits and 0x30 <= b <= 0x39) else 0x20

    return bytes(map(stands_for, range(256)))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def term_lists(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in their order, in lists of bounded size: a long text is cut between terms."""
    text = text.translate(table)
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end
