"""Vectorised text primitives on the UTF-8 buffers of Arrow batches.

Everything here works on a whole batch at once: the bytes of all texts stand in one array, words are found with a
byte-class table, and the hash of any byte span comes from one prefix sum (a polynomial in an odd base modulo 2**64,
whose powers have inverses), so no Python loop runs over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
KEPT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def power(base: np.uint64, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n; the first ``KEPT`` stay for the life of the worker, and more are made for the call
    alone, so that one very long text leaves nothing behind."""
    if n <= KEPT and int(base) in _powers:
        return _powers[int(base)][:n]
    steps = np.full(max(n, KEPT), base, dtype=np.uint64)
    steps[0] = 1
    np.cumprod(steps, dtype=np.uint64, out=steps)
    if n <= KEPT:
        _powers[int(base)] = steps
    return steps[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return power(BASE, n), power(BASE_INVERSE, n)


def give_back() -> None:
    """Return freed memory to the machine: an idle Python worker otherwise holds its largest batch until the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # only where the C library has it
        trim(0)


#: The one large thing that this worker keeps between tasks.
_kept: dict[str, object] = {}


def keep_only(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by this worker until another operator keeps something or asks for the room."""
    if name not in _kept:
        keep_nothing()
        _kept[name] = make()
    return _kept[name]


def keep_nothing() -> None:
    """Drop what an operator before this one left in a worker that Spark uses again."""
    if _kept:
        _kept.clear()
        give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = 1_500_000) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes: the working arrays of one range are some twenty times its bytes."""
    sizes = pc.binary_length(pc.fill_null(column, "").cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of ASCII letters and digits and of every byte of a non-ASCII character.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): word k is data[starts[k]:ends[k]]; document d has the words bounds[d]..bounds[d+1]."""
    inside = table[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (data[j] + 1) * BASE**j for j < i."""
    up = power(BASE, len(data))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return total


def span_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal spans have equal hashes wherever they stand."""
    down = power(BASE_INVERSE, len(total))
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(column, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds by document)."""
    data, offsets = buffer_of(column)
    if lower:
        data = LOWER[data]
    starts, ends, bounds = spans(data, offsets)
    return span_hash(prefix_hash(data), starts, ends), bounds


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of word n-grams; a document of 1..width-1 words has one shingle, all its words."""
    lengths = np.diff(bounds)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled[: n - k] += words[k:] * np.uint64((0xA0761D6478BD642F * (2 * k + 3) | 1) & (2**64 - 1))
    room = np.repeat(bounds[1:], lengths) - np.arange(n)
    keep = room >= width
    short = (lengths > 0) & (lengths < width)
    if short.any():
        at = bounds[:-1][short]
        sums = np.zeros(len(at), dtype=np.uint64)
        for k in range(width - 1):
            has = lengths[short] > k
            sums[has] += words[at[has] + k] * np.uint64((0xE7037ED1A0B428DB * (2 * k + 3) | 1) & (2**64 - 1))
        rolled[at] = sums
        keep[at] = True
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    return mix(rolled[keep]), np.concatenate([[0], np.cumsum(counts)])
