"""Words of many texts at once: byte spans and 64-bit hashes from Arrow columns, without a Python loop over words.

A column of texts is one byte buffer and its offsets. Words are found with masks over that buffer and hashed with a
polynomial over the bytes (a running sum times inverse powers), so the cost is a few NumPy passes a byte. Work goes
slice by slice, so memory follows the slice and not the batch; a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)

#: White space as in `[^\x20\x09-\x0D]+`.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Everything but ASCII letters, digits and the bytes of longer characters.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))
#: Hash value of each byte with A-Z read as a-z.
_FOLDED = _BYTE_VALUES[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]

_powers: dict[int, np.ndarray] = {}


def _power_run(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        run = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
        run[0] = 1
        have = np.cumprod(run, dtype=np.uint64)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; a null counts as an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, at = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(end, rows)
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each row's first word (one more entry than rows). Words end at row ends."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= gap[:-1]
    after = edge[1:].copy()
    after[:-1] |= gap[1:]
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each byte span, ASCII case folded unless told otherwise; with several `ends`, one row of hashes for each."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE_VALUES)[data] * _power_run(_PRIME, len(data))[: len(data)], out=total[1:])
    base, scale = total[starts], _power_run(_INVERSE, len(data))[starts]
    out = [mix((total[e] - base) * scale) for e in ends]
    return out[0] if len(out) == 1 else np.stack(out)


def hashed_words(column: pa.Array, separators: np.ndarray = WHITE, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row) for slices of the column."""
    data, offsets = buffers(column)
    for low, high in slices(offsets, limit):
        part = offsets[low : high + 1]
        text = data[part[0] : part[-1]]
        starts, ends, firsts = spans(text, part - part[0], separators)
        yield low, high, hashes(text, starts, ends), firsts


def chained(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values; run i starts at value i (len - n + 1 runs)."""
    runs = len(values) - n + 1
    if runs <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(runs, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(_PRIME) + values[k : k + runs])
    return out
