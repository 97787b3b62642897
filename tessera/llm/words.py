"""Words of whole texts as integer arrays: a vectorised splitter over Arrow string batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the white space that ends a word: space and \t \n \v \f \r.
SPACE_BYTES = (32, 9, 10, 11, 12, 13)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True

#: Text bytes handled at once (arrays of eight bytes a character then fit a core's cache); a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task would otherwise keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about limit text bytes each."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield batch.slice(start, end - start)
        start = end
    give_back()


class Texts:
    """The bytes of a string array's texts, one after another; null counts as empty."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.n = len(column)
        self.bytes = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) and ends[-1] > ends[0] else np.zeros(0, np.uint8)
        self.ends = ends - ends[0] if len(ends) else np.zeros(1, np.int64)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """For each text the number of its bytes that are flagged."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.ends[1:]] - total[self.ends[:-1]]


def encoded(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dense numbers of the byte strings that lie one after another in data, and the distinct strings."""
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    strings = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class Words:
    """The words of texts: doc (text's place), code (number of the distinct word), distinct (the words)."""

    def __init__(self, texts: Texts, more_breaks: Callable[[np.ndarray], np.ndarray] | None = None):
        """more_breaks: from the bytes, which of them also begin a word."""
        inside = ~_IS_SPACE[texts.bytes]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = texts.ends[:-1][texts.ends[:-1] < len(first)]
        first[begins] = inside[begins]
        if more_breaks is not None:
            first |= more_breaks(texts.bytes) & inside
        starts = np.flatnonzero(first)
        kept = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
        lengths = np.diff(np.append(kept[starts], kept[-1]))
        self.inside, self.starts, self.lengths = inside, starts, lengths
        self.doc = np.searchsorted(texts.ends, starts, "right") - 1
        self.code, self.distinct = encoded(texts.bytes[inside], lengths)
        self.per_doc = np.bincount(self.doc, minlength=texts.n)[: texts.n]


def grouped(keys: np.ndarray, *parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that places equal rows of parts together, and whether each differs from the one before it.

    keys are hashes of the rows. Neighbours are compared in full, and rows with one key and
    different parts are sorted by the parts.
    """
    order = np.argsort(keys, kind="stable")
    same_key = keys[order][1:] == keys[order][:-1]
    same = np.ones(max(len(order) - 1, 0), bool)
    for part in parts:
        same &= part[order][1:] == part[order][:-1]
    if (same_key & ~same).any():
        order = np.lexsort(parts)
        same = np.ones(len(order) - 1, bool)
        for part in parts:
            same &= part[order][1:] == part[order][:-1]
    return order, np.concatenate((np.ones(min(len(order), 1), bool), ~same))


def mixed(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of integers."""
    with np.errstate(over="ignore"):
        value = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
        for part in parts:
            value = (value ^ part.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(29)
            value *= np.uint64(0x94D049BB133111EB)
            value ^= value >> np.uint64(32)
    return value
