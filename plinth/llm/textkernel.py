"""Vectorised text primitives shared by the corpus operators.

A batch of texts is one flat byte array plus row offsets.  Words, lines and shingles are
index arrays over it and are hashed with numpy, so no Python object is made per word.  Word
classes are byte classes: every byte of a multi-byte UTF-8 character is at least 0x80, so
splitting at ASCII separators is exact on the encoded form.

Hashes are 64-bit.  Two distinct words, lines or shingles share a value with a chance of
about n^2 / 2^65 over n of them; callers that need certainty verify on the text.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.  Bounds the work arrays (about 40 bytes per text byte);
#: a longer text makes a block of its own.
BLOCK_BYTES = 1 << 21
_ROWS = 512

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)

#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of words made of digits, ASCII letters and everything beyond ASCII.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:0x80] = True
NON_ALNUM[0x30:0x3A] = NON_ALNUM[0x41:0x5B] = NON_ALNUM[0x61:0x7B] = False
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """A block of texts as one byte array; a null text is empty."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.flat, self.offsets = flat, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        return next(blocks(pa.array(texts, pa.string()), limit=1 << 62), (None, cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))))[1]

    def lower(self) -> Texts:
        return Texts(LOWER[self.flat], self.offsets)

    def spans(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs without separators, none crossing texts, and the
        index of each text's first run (one entry more than texts)."""
        inside = ~separators[self.flat]
        n = len(inside)
        bounds = self.offsets
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[bounds[:-1][bounds[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, bounds)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of ``\\n``-separated lines (a text of k breaks has k + 1 lines)
        and the index of each text's first line."""
        breaks = np.flatnonzero(self.flat == 10)
        first = np.searchsorted(breaks, self.offsets) + np.arange(len(self.offsets))
        total = len(breaks) + len(self)
        starts, ends = np.empty(total, np.int64), np.empty(total, np.int64)
        own = np.searchsorted(self.offsets, breaks, side="right") - 1
        place = np.arange(len(breaks)) + own
        ends[place] = breaks
        starts[place + 1] = breaks + 1
        starts[first[:-1]] = self.offsets[:-1]
        ends[first[1:] - 1] = self.offsets[1:]
        return starts, ends, first

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each span's bytes."""
        power, inverse = _power_tables(len(self.flat) + 1)
        sums = np.zeros(len(self.flat) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.flat] * power[: len(self.flat)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    def count(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.zeros(len(self.flat) + 1, np.int64)
        np.cumsum(marked, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def part(self, start: int, end: int) -> bytes:
        return self.flat[start:end].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[slice, Texts]]:
    """Splits a string column into runs of rows of at most ``limit`` bytes (or one row)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    # a few hundred rows at a time, as the conversion copies them
    step = _ROWS if limit < 1 << 40 else max(1, len(column))
    for base in range(0, len(column), step):
        part = column.slice(base, step).cast(pa.large_binary()).fill_null(b"")
        n = len(part)
        _, raw_offsets, data = part.buffers()
        offsets = np.frombuffer(raw_offsets, np.int64)[part.offset : part.offset + n + 1]
        flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
            hi = min(hi, n)
            yield slice(base + lo, base + hi), Texts(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi


def lean(task: Callable) -> Callable:
    """The task, giving free memory back to the system when it ends: Python workers stay alive
    and would hold the peak of each step that they have run."""

    @functools.wraps(task)
    def run(*args):
        try:
            yield from task(*args)
        finally:
            trim()

    return run


def trim() -> None:
    """Gives free memory of this process back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def owners(first: np.ndarray) -> np.ndarray:
    """For index bounds per text, the text of each item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(values: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` consecutive items inside a text, and their starts."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(_BASE_INV) + values[k : k + n]
    room = np.repeat(first[1:], np.diff(first))[:n]
    starts = np.flatnonzero(np.arange(n) + size <= room)
    return mix(total[starts]), starts


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks keys that occur at least twice."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def member(keys: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each key in an ascending array, and whether it is there."""
    if not len(ordered):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return place, ordered[place] == keys


class Lookup:
    """Places of keys in an ascending array of distinct hashes, by their leading bits.

    Some five times as fast as a binary search, as hashes are spread evenly.
    """

    def __init__(self, ordered: np.ndarray):
        self.ordered = ordered
        bits = max(1, int(max(1, len(ordered)) * 2 - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.edge = np.searchsorted(ordered, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :func:`member`; the place of a key that is not there is any."""
        n = len(self.ordered)
        if not n or not len(keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(self.edge[(keys >> self.shift).astype(np.int64)], n - 1)
        here = self.ordered[place]
        there = here == keys
        open_ = np.flatnonzero(here < keys)
        while len(open_):
            at = place[open_] + 1
            open_, at = open_[at < n], at[at < n]
            here = self.ordered[at]
            place[open_] = at
            there[open_] = here == keys[open_]
            open_ = open_[here < keys[open_]]
        return place, there


def distinct_by_text(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, key) pairs, ordered by text and then key."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[fresh], owner[fresh]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def crc_of_id(ids: np.ndarray | list) -> np.ndarray:
    """crc32 of each id's decimal text; a null id counts as the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids], np.uint32)
