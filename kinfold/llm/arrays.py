"""Whole-column text arithmetic inside Arrow tasks: words, 64-bit hashes and sliding windows as numpy arrays.

A task sees one Arrow batch at a time and works on slices of a few MB of it, so memory follows the longest document
and not the table. Hashes are 64-bit; where equality of hashes decides a result, the callers say how it is confirmed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAD = 64
SLICE_BYTES = 1_000_000
_LONG_WORD = 64

_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)

_bytes = np.arange(256)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: Words are runs of anything but blanks: [^\x20\x09-\x0D]+
NOT_BLANK = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
#: Words of lower-cased text are runs of digits, letters and all beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)


@dataclass
class Texts:
    """Some documents' UTF-8 bytes, one after another; ``data`` has PAD zero bytes more at its end."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def size(self) -> int:
        return int(self.bounds[-1])

    def at(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def map_bytes(self, table: np.ndarray) -> Texts:
        return Texts(table[self.data], self.bounds)


def texts_of(column: pa.Array) -> Texts:
    """The texts of an Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return Texts(np.zeros(PAD, np.uint8), np.zeros(1, np.int64))
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    first, last = int(bounds[0]), int(bounds[-1])
    data = np.zeros(last - first + PAD, np.uint8)
    if last > first:
        data[: last - first] = np.frombuffer(column.buffers()[2], dtype=np.uint8, count=last - first, offset=first)
    return Texts(data, bounds - first)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, a longer text alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(int(start), int(stop - start))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    for batch in batches:
        for part in slices(batch, column):
            yield part, texts_of(part.column(column))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _S32)
    x *= _C2
    x ^= x >> _S32
    x *= _C2
    x ^= x >> _S32
    return x


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts."""
    x = a * _C1
    x += b
    x ^= x >> _S32
    x *= _C2
    x ^= x >> np.uint64(29)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as a little-endian number."""
    return np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


@dataclass
class Words:
    """``first[i]`` is the number of words before document ``i``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: Texts, is_word: np.ndarray) -> Words:
    n = texts.size
    inside = is_word[texts.data[:n]]
    opens, closes = inside.copy(), inside.copy()
    if n:
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        full = texts.bounds[:-1] < texts.bounds[1:]
        firsts, lasts = texts.bounds[:-1][full], texts.bounds[1:][full] - 1
        opens[firsts] = inside[firsts]
        closes[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.bounds))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; spans of up to eight bytes cannot collide with each other."""
    eight = eights(data)
    left = ends - starts
    out = mix((eight[starts] & _MASKS[np.minimum(left, 8)]) + left.astype(np.uint64) * _C1)
    active = np.flatnonzero((left > 8) & (left <= _LONG_WORD))
    at = 8
    while len(active):
        rest = left[active] - at
        out[active] = mix(out[active] + (eight[starts[active] + at] & _MASKS[np.minimum(rest, 8)]))
        active = active[rest > 8]
        at += 8
    for i in np.flatnonzero(left > _LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, dtype="<u8")[0]
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` neighbours, by doubling; entry ``i`` covers ``[i, i + width)``."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    out: np.ndarray | None = None
    have, level, span = 0, hashes, 1
    while True:
        if width & span:
            if out is None:
                out = level
            else:
                out = join_hash(level[: len(level) - have], out[span:]) if have else level
            have += span
        if span * 2 > width:
            return out
        level = join_hash(level[:-span], level[span:])
        span *= 2


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of ``width`` lies within one document."""
    counts = np.diff(first) - width + 1
    has = counts > 0
    return ramps(first[:-1][has], counts[has])


def ramps(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``count`` numbers each."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)


def covered(length: int, starts: np.ndarray, width) -> np.ndarray:
    """Which of ``length`` places some ``[start, start + width)`` covers."""
    steps = np.zeros(length + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps[:-1]) > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each place."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
