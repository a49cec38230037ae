"""Vectorised hashing of words and word shingles straight from Arrow's UTF-8 buffers.

No Python string is made for a word. A word's hash is a polynomial over
randomised byte codes, obtained for all words at once from one prefix sum, then
finished with a 64-bit mixer. Two different words, or two different shingles,
share a hash with a probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_INV = pow(_STEP, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_STEP, _STEP_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            _powers[k] = p
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (one row alone may be larger)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def word_hashes(buf: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all rows, and each row's range in them."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[buf]
    if lower:
        buf = _LOWER[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[1:-1]
    cut = cut[cut < n]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = cut[cut > 0] - 1
    last[edge] = inside[edge]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[buf] * power[:n], out=total[1:])
    h = (total[e] - total[s]) * inverse[s]
    h = mix(h + (e - s).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(s, off)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each row: sorted hashes end to end, and offsets.

    A row of fewer than ``k`` words has its whole word sequence as its one
    shingle; a row without words has none.
    """
    w, at = word_hashes(buf, off, lower=True)
    rows, counts = len(off) - 1, np.diff(at)
    out = []
    if len(w) >= k:
        h = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            h += w[i : i + len(h)] * _PLACE[i]
        h = mix(h)
    for r in range(rows):
        a, c = at[r], counts[r]
        if c >= k:
            out.append(np.unique(h[a : a + c - k + 1]))
        elif c:
            out.append(mix(np.array([np.sum(w[a : a + c] * _PLACE[32 : 32 + c]) + U64(c)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum([len(x) for x in out], out=offsets[1:])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), offsets
