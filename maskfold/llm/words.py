"""Word and shingle hashes of whole Arrow string columns with numpy (used inside tasks).

Words are maximal runs of bytes other than ASCII white space, with A-Z lower-cased.
"""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@cache
def _byte_values(separators: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """A random-looking 64-bit value per byte, upper case like lower case; which bytes separate words:
    ASCII white space and ``separators``."""
    value = mix64(np.arange(1, 257, dtype=U) * U(BASE))
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14), *separators]] = True
    value[space] = 0
    return value, space


@cache
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log2
    out = []
    for b in (BASE, INVERSE):
        p = np.ones(n, U)
        p[1:] = U(b)
        out.append(np.cumprod(p))
    return out[0], out[1]


def column_chunks(column):
    """Cut an Arrow string column into slices of about ``CHUNK_BYTES`` (one text at least)."""
    import pyarrow as pa
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield at, column.slice(at, end - at)
        at = end


def word_hashes(column, separators: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of each text's words) of a large_string column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, U), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]: offsets[-1]]
    offsets = offsets - offsets[0]
    value, space = _byte_values(separators)
    inside = ~space[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    starts[cuts] = inside[cuts]  # a word never spans two texts
    start = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | starts[1:]
    end = np.flatnonzero(ends) + 1
    power, inverse = _powers(max(16, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(value[data] * power[: len(data)], out=total[1:])
    hashes = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(U) * U(BASE))
    return hashes, np.searchsorted(start, offsets).astype(np.int64)


def combine(*columns: np.ndarray) -> np.ndarray:
    """A hash of the sequence of hashes in each row."""
    out = columns[0]
    for c in columns[1:]:
        out = mix64(out * U(BASE) + c)
    return out


def shingle_sets(column, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence where it is shorter."""
    words, at = word_hashes(column)
    runs = combine(*(words[i: len(words) - k + 1 + i] for i in range(k))) if len(words) >= k else words[:0]
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            s = np.sort(runs[a: b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(combine(np.array([b - a], U), *(words[i: i + 1] for i in range(a, b))))
        else:
            out.append(words[:0])
    return out
