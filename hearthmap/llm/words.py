"""Words, word hashes and shingles of whole Arrow text columns, without a Python loop over words.

A word is a run of bytes other than space and U+0009..U+000D.  Hashes of byte ranges are differences
of a running polynomial sum modulo 2**64, so any range of a batch costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes of text that one step works on; a longer single text is worked on alone.
STEP_BYTES = 2_000_000
SHINGLE_WORDS = 5

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


class RangeHash:
    """Hash of any byte range of ``data``."""

    def __init__(self, data: np.ndarray):
        power, self._inverse = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        values = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(values ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offset of each text (one more than texts); null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


@dataclass
class Words:
    """Words of a run of texts: byte ranges, the text each belongs to, first word of each text."""

    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    bounds: np.ndarray


def find_words(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = SEPARATOR) -> Words:
    """Words of texts that lie side by side; ``between`` flags the bytes that no word holds."""
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    beside = np.zeros(len(data) + 1, bool)
    beside[1:] = inside
    start = np.flatnonzero(inside & (~beside[:-1] | edge[:-1]))
    beside[:-1] = inside
    beside[-1] = False
    end = np.flatnonzero(inside & (~beside[1:] | edge[1:])) + 1
    owner = np.searchsorted(bounds, start, "right") - 1
    counts = np.bincount(owner, minlength=len(bounds) - 1)
    return Words(start, end, owner, np.concatenate([[0], np.cumsum(counts)]))


def windows_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` successive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * np.uint64(_BASE) + values[j : j + n]
    return mix(total ^ np.uint64(width))


def shingle_sequence(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """Hashes of the five-word shingles of each text in order, and the first of each text.

    A text with one to four words has its whole word sequence as its only shingle.
    """
    words = find_words(data, bounds)
    hashes = RangeHash(data)(words.start, words.end)
    counts = np.diff(words.bounds)
    all_windows = windows_hash(hashes, SHINGLE_WORDS)
    n = len(all_windows)
    inner = words.owner[:n] == words.owner[SHINGLE_WORDS - 1 :] if n else np.zeros(0, bool)
    sequence, owner = all_windows[inner], words.owner[:n][inner]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS))
    if len(short):
        whole = np.array(
            [windows_hash(hashes[words.bounds[i] : words.bounds[i + 1]], counts[i])[0] for i in short],
            np.uint64,
        )
        place = np.searchsorted(owner, short)
        sequence, owner = np.insert(sequence, place, whole), np.insert(owner, place, short)
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))])
    return sequence, first, words


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the first of each text."""
    sequence, first, _ = shingle_sequence(data, bounds)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for a, b in zip(first[:-1], first[1:]):
        sequence[a:b].sort()
    fresh = np.ones(len(sequence), bool)
    fresh[1:] = (sequence[1:] != sequence[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[fresh], minlength=len(first) - 1)
    return sequence[fresh], np.concatenate([[0], np.cumsum(counts)])


def steps(
    batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES, more: tuple[str, ...] = ()
) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, in ``column`` and ``more`` together; one row at least."""
    bounds = sum(raw(batch.column(c))[1] for c in (column, *more))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
