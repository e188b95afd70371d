"""Words, word hashes and hashes of word runs for whole batches of texts, in numpy.

A word is a maximal run of characters other than space and U+0009-U+000D. All
functions work on one concatenated UTF-8 buffer of several texts at a time; a
word never crosses the border of a text. Hashes are 64-bit polynomials over
bytes (or over word hashes) followed by a bit mixer.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about this many bytes (one text at least), so the
#: numpy temporaries of a task stay small whatever the number of rows in a batch.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    known = _powers[base]
    while len(known) < n:
        step = np.uint64(pow(base, len(known), 1 << 64))
        known = np.concatenate([known, known * step])
    if len(known) <= 4 * SLICE_BYTES:
        _powers[base] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective mixer of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of values[start:stop] for each pair; equal runs have equal hashes."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * _power(_BASE, n), out=total[1:])
    return mix((total[stop] - total[start]) * _power(_INVERSE, n + 1)[start])


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the texts) of consecutive rows, about ``size`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(column))
        lo, hi = offsets[first], offsets[last]
        yield first, last, data[lo:hi], offsets[first : last + 1] - lo
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Start and end byte of each word; index of the first word of each text (and the total)."""
    solid = ~_SPACE[data]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    before = np.ones(len(data), dtype=bool)
    before[1:] = ~solid[:-1]
    after = np.ones(len(data), dtype=bool)
    after[:-1] = ~solid[1:]
    starts = np.flatnonzero(solid & (before | border[:-1]))
    stops = np.flatnonzero(solid & (after | border[1:])) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return run_hashes(data.astype(np.uint64) + np.uint64(1), starts, stops)


def owner(firsts: np.ndarray) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
