"""Words of Arrow text columns as places in their bytes, a bounded piece of the bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import by_value, fresh_texts

by_value(__name__)

#: Bytes looked at together; a piece ends where a word does.
PIECE = 4 << 20


def byte_table(digits: bool) -> np.ndarray:
    """What each byte counts as: lower-cased letters and bytes of other characters (and digits) as themselves, 0 for all that parts words."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 0
    table[97:123] = table[65:91] = np.arange(97, 123)
    if digits:
        table[48:58] = np.arange(48, 58)
    return table


def mapped(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) through a table, and where each text begins in them (and the last ends)."""
    texts = fresh_texts(texts)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
    return table[raw], ends


def word_pieces(raw: np.ndarray, ends: np.ndarray, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first byte, end byte, row) of the words, in order; a word never lies in two texts, and is whole whatever its length."""
    low = 0
    while low < len(raw):
        high = min(low + size, len(raw))
        while high < len(raw) and raw[high - 1]:  # on to the end of the word
            gaps = np.flatnonzero(raw[high : high + size] == 0)
            high = high + int(gaps[0]) + 1 if len(gaps) else min(high + size, len(raw))
        inside = raw[low:high] != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = ends[np.searchsorted(ends, low) : np.searchsorted(ends, high)] - low  # texts that begin here
        first[edges] = inside[edges]
        edges = edges[edges > 0] - 1
        last[edges] = inside[edges]
        at = np.flatnonzero(first) + low
        if len(at):
            yield at, np.flatnonzero(last) + low + 1, np.searchsorted(ends, at, "right") - 1
        low = high
