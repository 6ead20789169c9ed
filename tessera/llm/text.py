"""Vectorised tokenising of Arrow text batches (bytes in, word positions and 64-bit hashes out).

All word classes of the operators are defined on ASCII bytes, and every byte of a multi-byte UTF-8
character is 0x80 or more, so words can be cut on the UTF-8 bytes themselves. A word's hash is a
polynomial over its bytes modulo 2**64 (taken from prefix sums, so one pass serves all words),
finished with a mixing step; equal hashes are taken as equal words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_CHUNK = 1 << 20


def _class(separators: list[tuple[int, int]]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    for lo, hi in separators:
        out[lo:hi + 1] = False
    return out


#: Words between blanks: [^\x20\x09-\x0D]+
BLANK_WORDS = _class([(0x20, 0x20), (0x09, 0x0D)])
#: Words of letters, digits and non-ASCII characters, after lower-casing: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM_WORDS = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n positions."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(n, dtype=np.uint64)
        filled = 1
        while filled < n:
            k = min(filled, n - filled)
            p[filled:filled + k] = p[:k] * np.uint64(pow(base, filled, 1 << 64))
            filled += k
        out.append(p)
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash (all output bits depend on all input bits)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def seeded(h: np.ndarray, seed: int) -> np.ndarray:
    """An independent hash of each value for each seed."""
    return mix(h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK))


class Words:
    """The words of some rows: ``row`` (non-decreasing), byte ``start`` and ``end``, ``hash``, and ``first`` (word offsets by row).

    ``classes`` says of every byte value, or as a function of all bytes, which belong to words; ``cuts``
    says of all bytes before which ones a word ends though the next one follows at once.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, classes: np.ndarray | Callable[[np.ndarray], np.ndarray], fold: bool,
                 cuts: Callable[[np.ndarray], np.ndarray] | None = None):
        self.rows = len(offsets) - 1
        self.raw = buf
        b = _FOLD[buf] if fold else buf
        self.buf = b
        if len(b) == 0:
            self.start = self.end = np.zeros(0, dtype=np.int64)
            self.hash = np.zeros(0, dtype=np.uint64)
            self.first = np.zeros(self.rows + 1, dtype=np.int64)
            return
        word = classes(b) if callable(classes) else classes[b]
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        edges = offsets[:-1][offsets[:-1] < len(b)]
        before[edges] = False
        cut = None if cuts is None else cuts(b)
        if cut is not None:
            before &= ~cut
        self.start = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1] = False
        after[:-1] = word[1:]
        edges = offsets[1:][offsets[1:] > 0]
        after[edges - 1] = False
        if cut is not None:
            after[:-1] &= ~cut[1:]
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets, side="left")
        up, down = _powers(1 << max(20, int(len(b)).bit_length()))
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hash = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> str:
        return self.buf[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def runs(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n consecutive words of one row: (position of its first word, hash). Rows with fewer words have none."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = np.zeros(total - n + 1, dtype=np.uint64)
    c = 1
    for k in range(n):
        h += hashes[k:total - n + 1 + k] * np.uint64(c)
        c = c * 0xC2B2AE3D27D4EB4F & _MASK
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[:total - n + 1] == row[n - 1:])
    return at, mix(h[at])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, o - o[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = _CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches holding about ``max_bytes`` of text each (one row at least), with the bytes and offsets of ``column``.

    Keeps a task's memory bounded by the slice or the longest single text, whatever the batch size.
    """
    for batch in batches:
        raw, offs = column_bytes(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        n = batch.num_rows
        while lo < n:
            hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
            hi = min(max(hi, lo + 1), n)
            yield batch.slice(lo, hi - lo), raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
            lo = hi


def ragged_index(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def ragged(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """List column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(first, type=pa.int32()), pa.array(values, type=kind))
