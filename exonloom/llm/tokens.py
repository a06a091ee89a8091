"""Words of whole byte texts, hashed with array operations only.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``; A-Z count as a-z.  Hashes are multilinear
over 64 bits: every byte value and every place in a word has a fixed random number, so two
different words meet with a chance near 2**-63.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
END = np.uint64(0x9E3779B97F4A7C15)  # the hash of the end token, which no word has


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed random number for each integer."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(n: int) -> np.uint64:
    """A fixed random odd number for ``n``."""
    return (mix(np.array([n])) | np.uint64(1))[0]


SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
OF_BYTE = mix(np.arange(256) + 32 * UPPER + (1 << 32))


def places(n: int) -> np.ndarray:
    """A fixed odd number for each of the first ``n`` places of a word."""
    return mix(np.arange(n)) | np.uint64(1)


def unused(columns: Iterable[str], stem: str) -> str:
    """A column name that none of ``columns`` has, in whatever case."""
    taken = {c.lower() for c in columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def texts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of the texts, and the number of words of each text."""
    base, data = int(offsets[0]), data[offsets[0] : offsets[-1]]
    edges = offsets - base
    solid = ~SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    inner = edges[(edges > 0) & (edges < len(data))]
    start[inner] = solid[inner]  # a text never goes on with the word of the one before
    stop = np.zeros(len(data) + 1, bool)
    stop[1:] = solid
    stop[1:-1] &= ~solid[1:] | start[1:]
    a, b = np.flatnonzero(start), np.flatnonzero(stop)
    return a + base, b + base, np.diff(np.searchsorted(a, edges))


def hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int | None = None, part: int = 1 << 18) -> np.ndarray:
    """Hash of each span, or of its first ``most`` bytes; about ``part`` bytes are worked on at a time."""
    size = b - a if most is None else np.minimum(b - a, most)
    ends = np.cumsum(size)
    out = np.empty(len(a), np.uint64)
    i = 0
    while i < len(a):
        done = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + part, "right")))
        n = size[i:j]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        values = OF_BYTE[data[at + np.repeat(a[i:j], n)]] * places(int(n.max()))[at]
        out[i:j] = np.add.reduceat(values, first)
        i = j
    return out + mix(size)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words of each text."""
    a, b, n = spans(data, offsets)
    return hashes(data, a, b), n
