"""Texts of an Arrow column as numpy arrays of bytes, words and rolling hashes.

A column of texts is one byte buffer with offsets, so whole batches are split into words and hashed without a loop over
texts. A null text counts as an empty one everywhere.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random number for each byte.
BYTE_NUMBERS = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))

WHITE = (0x20, *range(0x09, 0x0E))
#: Words are runs of anything but ASCII white space.
PLAIN_WORD = np.ones(256, bool)
PLAIN_WORD[list(WHITE)] = False
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x41:0x5B] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_tables = {"power": np.ones(1, U64), "inverse": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each; kept by the worker, and a quarter more when they run short."""
    if len(_tables["power"]) < n:
        size = max(n, len(_tables["power"]) * 5 // 4)
        for name, factor in (("power", _BASE), ("inverse", _INVERSE)):
            row = np.full(size, factor, U64)
            row[0] = 1
            _tables[name] = np.cumprod(row)
    return _tables["power"][:n], _tables["inverse"][:n]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not the GNU C library
    _trim = None


def give_back() -> None:
    """Hands freed memory back to the system: workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def thrifty(group: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group's rows that hands back what it took, once its own arrays are gone."""

    def call(table: pa.Table) -> pa.Table:
        out = group(table)
        give_back()
        return out

    return call


def thrifty_pair(group: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As thrifty, for a group's rows of two tables. Spark counts the arguments."""

    def call(table: pa.Table, marks: pa.Table) -> pa.Table:
        out = group(table, marks)
        give_back()
        return out

    return call


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that the texts of a slice hold `most` bytes or are a single text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and n + 1 offsets into them."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of n texts: starts and ends in bytes, and n + 1 offsets of each text's words."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of(self) -> np.ndarray:
        """Number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.offsets[1:], self.counts) - np.arange(len(self.starts))


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    inside = is_word[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return Words(starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes in every task."""
    return run_hashes(BYTE_NUMBERS[data], starts, ends)


def run_hashes(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As span_hashes, for runs of 64-bit numbers that look random."""
    power, inverse = powers(len(numbers) + 1)
    sums = np.zeros(len(numbers) + 1, U64)
    np.cumsum(numbers * power[:-1], out=sums[1:])
    found = sums[ends]
    found -= sums[starts]
    found *= inverse[starts]
    return mix(found + (ends - starts).astype(U64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbouring words at each word; the last n - 1 are left out. Windows may run across texts."""
    if len(words) < n:
        return np.zeros(0, U64)
    size = len(words) - n + 1
    found = words[:size].copy()
    for k in range(1, n):
        found *= U64(0xC2B2AE3D27D4EB4F)
        found += words[k : k + size]
    return mix(found)


def covered(starts: np.ndarray, width: int | np.ndarray, size: int) -> np.ndarray:
    """True where one of the spans `starts` to `starts + width` lies."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for keys that are there more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    found = np.zeros(len(keys), bool)
    if len(keys):
        found[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return found


def text_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a flag or number per byte or word over each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def join_words(data: np.ndarray, words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    text_of = words.text_of()[keep]
    starts = words.starts[keep]
    sizes = words.ends[keep] - starts + 1
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = np.arange(len(out))
    at -= np.repeat(ends - sizes - starts, sizes)
    np.minimum(at, max(0, len(data) - 1), out=at)
    out = data[at] if len(out) else out
    out[ends - 1] = 0x20
    counts = np.bincount(text_of, minlength=len(words.offsets) - 1)
    last = np.cumsum(counts)
    tails = ends[last[counts > 0] - 1] - 1  # the space after the last word of a text
    keep_byte = np.ones(len(out), bool)
    keep_byte[tails] = False
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], last])] - np.concatenate([[0], np.cumsum(counts > 0)])
    out = np.ascontiguousarray(out[keep_byte])
    return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Starts and ends of the runs of true flags in each text, counted from the text's start."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[0] = len(flags) > 0
    edge[1:-1] = flags[1:] != flags[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    at = at[at < len(flags)]
    stop = np.append(at[1:], len(flags))[flags[at]] if len(at) else at
    at = at[flags[at]]
    bounds = np.searchsorted(at, offsets).astype(np.int32)
    base = np.repeat(offsets[:-1], np.diff(bounds))
    make = lambda x: pa.ListArray.from_arrays(pa.array(bounds), pa.array(x - base, pa.int64()))
    return make(at), make(stop)
