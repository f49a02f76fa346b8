"""Vectorised text kernels over the UTF-8 buffers of an Arrow string column.

A word is a maximal run of bytes that a table of 256 flags marks as word bytes. Hashes are
polynomials over Z/2^64 with odd bases: prefix sums give the hash of any substring or window
of words in constant time, and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_BYTE_BASE, _WORD_BASE, _WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def space_table() -> np.ndarray:
    """Word bytes: all but ASCII white space."""
    t = np.ones(256, bool)
    t[list(ASCII_SPACE)] = False
    return t


def alnum_table() -> np.ndarray:
    """Word bytes: ASCII letters and digits, and every byte of a longer character."""
    t = np.zeros(256, bool)
    t[[b for b in range(128) if chr(b).isalnum()]] = True
    t[128:] = True
    return t


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of at most `limit` bytes; a longer text is a slice of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = texts.cast(pa.string()).fill_null("")
    _, offsets = utf8(texts)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), len(texts))
        yield row, texts.slice(row, stop - row)
        row = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array without nulls."""
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(max(n, 1), b, U64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


class Powers:
    """Power tables that grow with the longest chunk seen."""

    def __init__(self) -> None:
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __call__(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in self.kept or len(self.kept[base][0]) < n:
            self.kept[base] = powers(base, max(n, 1 << 16))
        up, down = self.kept[base]
        return up[:n], down[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more entry at the end)."""
    word = table[data]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[edge] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, power: Powers) -> np.ndarray:
    up, down = power(_BYTE_BASE, len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def window_hashes(words: np.ndarray, size: int, power: Powers, second: bool = False) -> np.ndarray:
    """Hash of words[i : i + size] for each i; windows over the end of a row must be masked by the caller."""
    n = len(words)
    if n < size:
        return np.zeros(0, U64)
    up, down = power(_WORD_BASE_2 if second else _WORD_BASE, n)
    total = np.zeros(n + 1, U64)
    np.cumsum(words * up, out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: n - size + 1])


def sliding(x: np.ndarray, size: int, extreme: np.ufunc) -> np.ndarray:
    """Extreme of x[i : i + size], in log(size) passes."""
    width, out = 1, x
    while width * 2 <= size:
        out = extreme(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return extreme(out[: len(out) - rest], out[rest:]) if rest else out


def window_valid(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the n window starts lie, with the whole window, in one row."""
    delta = np.zeros(n + 1, np.int32)
    count = np.maximum(np.diff(first) - size + 1, 0)
    has = count > 0
    np.add.at(delta, first[:-1][has], 1)
    np.add.at(delta, first[:-1][has] + count[has], -1)
    return np.cumsum(delta[:-1]) > 0


def anchors(words: np.ndarray, first: np.ndarray, gram: int, window: int, power: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed anchors: (word index, hash) of grams that are minimal in some run of grams that `window` words hold.

    Equal runs of `window` words choose the same grams, so two texts that share so many words share an anchor.
    """
    span = window - gram + 1
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    grams = window_hashes(words, gram, power)
    least = sliding(grams, span, np.minimum)
    least[~window_valid(first, window, len(least))] = 0
    pad = np.zeros(span - 1, U64)
    most = sliding(np.concatenate([pad, least, pad]), span, np.maximum)
    at = np.flatnonzero((grams <= most) & (most > 0))
    return at, grams[at]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges starts[i] .. starts[i] + counts[i]."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - first, counts)


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def flat(column: pa.ChunkedArray) -> np.ndarray:
    """All values of a list column without nulls."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts) if parts else np.zeros(0)


def release() -> None:
    """Hands freed memory back to the system: Spark keeps Python workers between tasks, with what their allocators hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library than glibc


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases memory when its task ends."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped
