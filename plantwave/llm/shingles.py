"""Word shingle hashes of whole texts, many texts at a time in numpy.

Words are runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased. A word's hash is a polynomial over random
byte values, taken from running sums so that all words of a batch are hashed at once; shingles mix their words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is hashed alone.
SLAB = 1 << 18
_rng = np.random.default_rng(20_17)
_EXACT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE = _EXACT.copy()
_VALUE[65:91] = _VALUE[97:123]  # A-Z are a-z
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, SLAB + 1), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if len(known) <= SLAB + 1:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, starts: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of texts that lie end to end in data."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    seams = starts[(starts > 0) & (starts < len(data))]
    first[seams] |= inside[seams]
    last[seams - 1] |= inside[seams - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, line_hashes(data, a, b, values)


def line_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the byte ranges from a to b."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_EXACT if values is None else values)[data] * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[b] - sums[a]) * _power(_INVERSE, len(data))[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in lower case, word number at which each text starts, and the count)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts) + 1, np.int64)
    a, _, hashes = word_spans(data, starts, _VALUE)
    return hashes, np.append(np.searchsorted(a, starts), len(a))


def slabs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts of the texts) of parts of a string column; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLAB, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row:end] - offsets[row]
        row = end


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, sorted; the whole sequence is one shingle if it has fewer words."""
    for _, data, starts in slabs(column):
        hashes, at = word_hashes(data, starts)
        rolled = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for i in range(words):
            rolled = mix(rolled + np.uint64(0x2545F4914F6CDD1D)) + hashes[i : len(hashes) - words + 1 + i] if len(rolled) else rolled
        rolled = mix(rolled)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for i in range(a, b):
                    whole = mix(whole + np.uint64(0x2545F4914F6CDD1D)) + hashes[i : i + 1]
                yield mix(whole + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
