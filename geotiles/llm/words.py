"""Vectorised word splitting and hashing over Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, exactly as
``text.encode().lower().split()`` gives them, but nothing is turned into
Python objects: a polynomial prefix hash over the UTF-8 bytes yields one
mixed 64-bit value per word.  Two different words share a value with a
probability of about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of text handled at once; one longer text is handled alone and whole.
SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(20, (n - 1).bit_length())
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


def hash_words(texts: pa.Array, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the number of words of each text (null: none)."""
    n = len(texts)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    if not n or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = word[cuts]  # a word never spans two texts
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers.of(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[data] * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one longer row."""
    lengths = texts.cast(pa.large_binary()).fill_null(b"")
    size = np.diff(np.frombuffer(lengths.buffers()[1], dtype=np.int64)[lengths.offset : lengths.offset + len(texts) + 1])
    begin, held = 0, 0
    for i, x in enumerate(size.tolist()):
        if i > begin and held + x > limit:
            yield begin, i
            begin, held = i, 0
        held += x
    if begin < len(size):
        yield begin, len(size)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` consecutive words, over document borders too."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(out)] + np.uint64(k + 1))
    return out


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of every row's distinct ``n``-word shingles, ordered by both.

    A row with words, but fewer than ``n``, has the whole sequence as its one
    shingle; a row without words has none.
    """
    ends = np.cumsum(counts)
    rows = np.repeat(np.arange(len(counts)), counts)
    values = combine(hashes, n)
    inside = np.arange(len(values)) + n <= ends[rows[: len(values)]]
    row, value = rows[: len(values)][inside], values[inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([combine(hashes[ends[i] - counts[i] : ends[i]], int(counts[i]))[0] for i in short], dtype=np.uint64)
        row, value = np.concatenate([row, short]), np.concatenate([value, mix(extra + np.uint64(0x5851F42D4C957F2D))])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


POWERS = _Powers()
