"""Arrow text columns as numpy word-hash arrays: the small helper that the text operators share.

A *block* is a run of consecutive rows whose texts are concatenated as bytes.
Words become 64-bit hashes without a Python object for each word. Null texts
are empty texts here; each operator says what that means for its result.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: list[np.ndarray] = []


def separated_by(separators) -> np.ndarray:
    """Byte values plus one, A-Z as a-z, and 0 for each separator."""
    t = np.arange(1, 257, dtype=np.uint64)
    t[65:91] += np.uint64(32)
    t[list(separators)] = 0
    return t


#: Words of letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case.
ALNUM = separated_by(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
#: Words between ASCII white space: [^\x20\x09-\x0D]+.
SPACED = separated_by([32, *range(9, 14)])

#: The same words as bytes: text.translate(ALNUM_BYTES).split(b" ") without its empty strings.
ALNUM_BYTES = bytes(int(x) - 1 if x else 32 for x in ALNUM)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES) + 1
        rows = [np.full(size, x, dtype=np.uint64) for x in (_ODD, _INVERSE)]
        for r in rows:
            r[0] = 1
        _powers[:] = [np.cumprod(r, dtype=np.uint64) for r in rows]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds of the rows in them); a longer row is a block of its own."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: the hash of each word, where it starts, and the index of each row's first word (and one more at the end)."""
    t = table[data]
    inside = t != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = bounds[:-1][bounds[:-1] < bounds[1:]]
    start[at] = inside[at]
    s = np.flatnonzero(start)
    if not len(s):
        return np.zeros(0, np.uint64), s, np.zeros(len(bounds), np.int64)
    up, down = powers(len(t))
    h = np.add.reduceat(t * up[: len(t)], s) * down[s]
    return mix(h), s, np.searchsorted(s, bounds)


def follow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0xA0761D6478BD642F) + np.uint64(1))


def word_hashes(text: str, table: np.ndarray = ALNUM) -> np.ndarray:
    """The hashes of one text's words, as :func:`words` gives them."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return words(data, np.array([0, len(data)]), table)[0]


def give_back() -> None:
    """Returns to the system what Arrow and the C library keep of memory that is free: a Python worker stays for later tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with :func:`give_back` at its task's end."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def ragged(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list array of the given arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
