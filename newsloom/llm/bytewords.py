"""Words of whole Arrow columns by numpy: no Python string is made.

Words are runs of bytes other than space, tab, line feed, VT, FF and CR; in UTF-8 no other character
contains these bytes. A-Z are folded to a-z. A word is represented by a 64-bit hash.
"""

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which each bit depends on all (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(x: np.ndarray, lane: int) -> np.ndarray:
    """Random numbers for ``x``, others for each lane."""
    return mixed(x + np.uint64((lane + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(c).isalnum() for c in range(128)]
_BYTE = mixed(np.arange(256, dtype=np.uint64) + _STEP)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> np.ndarray:
    """The first ``n`` powers of the base and of its inverse modulo 2**64.

    Those for a piece of usual size are kept; a longer text's are made for it alone.
    """
    if n > CHUNK_BYTES + 1:
        return _made_powers(n)
    if not _powers:
        _powers.append(_made_powers(CHUNK_BYTES + 1))
    return _powers[0][:, :n]


def _made_powers(n: int) -> np.ndarray:
    steps = np.full((2, n), _BASE, np.uint64)
    steps[1] = pow(_BASE, -1, 1 << 64)
    steps[:, 0] = 1
    return np.cumprod(steps, axis=1, dtype=np.uint64)


@dataclass
class Words:
    """Words of some texts: hashes, byte places in ``data``, and each text's range of words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def _bounds(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def words_of(column: pa.Array, between: np.ndarray = _SPACE) -> Words:
    """The words of a string column; null is a text without words. ``between`` marks the bytes that part words."""
    column = column.cast(pa.large_string())
    buffer, bounds = column.buffers()[2], _bounds(column)
    data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]] if buffer else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    n = len(data)
    inside = ~between[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    first[0] = first[n] = True
    first[1:n] |= ~inside[: n - 1] if n else first[1:n]
    last = np.ones(n, bool)
    if n:
        last[:-1] = ~inside[1:]
        last |= _at_end(bounds, n)
    starts = np.flatnonzero(first[:n] & inside)
    ends = np.flatnonzero(last & inside) + 1
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, starts, ends, np.searchsorted(starts, bounds), data)


def _at_end(bounds: np.ndarray, n: int) -> np.ndarray:
    """Marks bytes after which a text ends."""
    mark = np.zeros(n, bool)
    mark[bounds[1:][bounds[1:] > 0] - 1] = True
    return mark


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of some ``CHUNK_BYTES`` of text, or of one longer text.

    A worker's earlier tasks leave their functions, with the tables these hold, in cycles of
    references; they are cleared first, so that a worker's memory does not grow with its tasks.
    """
    gc.collect()
    for batch in batches:
        bounds = _bounds(batch.column(text).cast(pa.large_string()))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def chunks(
    batches: Iterator[pa.RecordBatch], between: np.ndarray = _SPACE
) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Pieces of the batches with the words of their texts."""
    for piece in pieces(batches):
        yield piece, words_of(piece.column("text"), between)


def windows(words: Words, size: int, whole_if_shorter: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words, the word each starts with, and each text's range of windows.

    A text of fewer words has none or, if asked for, one of all its words.
    """
    n = len(words.hashes)
    end = np.repeat(words.offsets[1:], np.diff(words.offsets))
    at = np.arange(n)
    full = at + size <= end
    if whole_if_shorter:
        short = np.diff(words.offsets) < size
        full |= np.repeat(short, np.diff(words.offsets)) & (at == np.repeat(words.offsets[:-1], np.diff(words.offsets)))
    at, end = at[full], end[full]
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        word = words.hashes[np.minimum(at + k, max(n - 1, 0))]
        total = mixed(total + np.where(at + k < end, word, np.uint64(0)) + np.uint64(k))
    return total, at, np.searchsorted(at, words.offsets)
