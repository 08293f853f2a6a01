"""Packing by minimum bin slack.

Each task packs the documents of its own input partition, so nothing is shuffled. Documents are cut into full windows
first; what remains of each (less than a window) goes to a pool of lengths. For each window the longest remaining piece
is set, and a bitset dynamic program over the multiset of remaining lengths (one bit per reachable sum, counts split into
powers of two) finds the sum closest to the capacity; the layers are walked back for the counts to take. The program
stops at the first length with which the capacity is met exactly. A window that cannot be met exactly is filled up by
cutting one more piece. What is left at the end of a partition, less than one window, is cut into sequences of powers of
two lengths, which need no padding.

Defined cases: a null or empty text is its end id alone. Repeated rows are packed each. An empty table gives no rows. Columns other than doc_id and text are not read.
A partition's ids are held in groups of about ``GROUP_IDS``, a longer document alone, and leave the task in batches of
``SEQUENCES_AT_ONCE``.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import token_ids

CAPACITY = 4096
GROUP_IDS = 1 << 19
SEQUENCES_AT_ONCE = 64
_LOCAL_BITS = 33

Piece = tuple[int, int, int]  # document's place, start, length


def fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as close to ``capacity`` as can be, never above.

    ``lengths`` is in the order in which lengths are tried.
    """
    limit = (1 << (capacity + 1)) - 1
    reach = 1
    layers: list[tuple[int, int, int]] = []
    for length in lengths:
        left = min(counts[length], capacity // length)
        step = 1
        while left:
            take = min(step, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            left -= take
            step *= 2
        if reach >> capacity:
            break
    best = reach.bit_length() - 1
    out: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(layers):
        if not before >> best & 1:
            best -= length * take
            out[length] += take
    return out


class Packer:
    """Sequences as lists of pieces; documents are told by a number."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.pool: dict[int, list[Piece]] = defaultdict(list)
        self.total = 0

    def add(self, doc: int, n: int) -> Iterator[list[Piece]]:
        start = 0
        while n - start >= self.capacity:
            yield [(doc, start, self.capacity)]
            start += self.capacity
        self._put((doc, start, n - start))

    def _put(self, piece: Piece) -> None:
        if piece[2]:
            self.pool[piece[2]].append(piece)
            self.total += piece[2]

    def _take(self, length: int) -> Piece:
        pieces = self.pool[length]
        piece = pieces.pop()
        if not pieces:
            del self.pool[length]
        self.total -= length
        return piece

    def windows(self, keep: int = 0) -> Iterator[list[Piece]]:
        """Full windows while more than ``keep`` ids, and a window of them, remain."""
        order = sorted(self.pool, reverse=True)
        while self.total >= max(self.capacity, keep):
            order = [length for length in order if length in self.pool]
            seed = self._take(order[0])
            counts = {length: len(self.pool[length]) for length in order if length in self.pool}
            room = self.capacity - seed[2]
            chosen = fill([length for length in order if length in counts], counts, room)
            window = [seed] + [self._take(length) for length, n in chosen.items() for _ in range(n)]
            slack = room - sum(piece[2] for piece in window[1:])
            if slack:
                longer = min((length for length in self.pool if length > slack), default=None)
                doc, start, length = self._take(longer if longer else max(self.pool))
                window.append((doc, start, min(slack, length)))
                self._put((doc, start + slack, length - slack) if length > slack else (doc, start, 0))
                order = sorted(self.pool, reverse=True)
            yield window

    def rest(self) -> Iterator[list[Piece]]:
        """The last ids in sequences of powers of two lengths."""
        pieces = [piece for length in sorted(self.pool, reverse=True) for piece in self.pool[length]]
        self.pool.clear()
        left, self.total = self.total, 0
        pieces.reverse()
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            sequence = []
            while room:
                doc, start, length = pieces.pop()
                take = min(room, length)
                sequence.append((doc, start, take))
                room -= take
                if take < length:
                    pieces.append((doc, start + take, length - take))
            yield sequence


def _packed(batches: Iterator[pa.RecordBatch], path: str, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << _LOCAL_BITS
    packer, n_sequences = Packer(), 0
    # By number: doc_id, its number of ids, and those from some start on that are still needed.
    docs: dict[int, tuple[int | None, int, int, np.ndarray]] = {}
    number = held = 0

    def rows(sequences: Iterator[list[Piece]]) -> pa.RecordBatch:
        nonlocal n_sequences
        out, ids_out = [], []
        for sequence in sequences:
            offset = 0
            for doc, start, length in sequence:
                doc_id, total, begin, ids = docs[doc]
                part = ids[start - begin : start - begin + length]
                out.append((doc_id, start, length, zlib.crc32(part.tobytes()), total, base + n_sequences, offset))
                if with_ids:
                    ids_out.append(part)
                offset += length
            n_sequences += 1
        columns = list(zip(*out, strict=True)) or [()] * 7
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        if with_ids:
            flat = np.concatenate(ids_out) if ids_out else np.zeros(0, np.uint32)
            ends = np.r_[0, np.cumsum([len(i) for i in ids_out])].astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32))))
            names = [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def all_of(added: list[list[Piece]], keep: int, last: bool) -> Iterator[list[Piece]]:
        yield from added
        yield from packer.windows(keep)
        if last:
            yield from packer.rest()

    added: list[list[Piece]] = []
    for batch, ids, first in token_ids.encoded_slices(batches, path):
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
            docs[number] = doc_id, len(own), 0, own
            added += packer.add(number, len(own))
            number += 1
            held += len(own)
        if held >= GROUP_IDS:
            for some in batched(all_of(added, 16 * CAPACITY, False), SEQUENCES_AT_ONCE):
                yield rows(iter(some))
            # One piece of a document waits at most; what was before it is out.
            waiting = {doc: start for pieces in packer.pool.values() for doc, start, _ in pieces}
            kept = {}
            for doc, start in waiting.items():
                doc_id, total, begin, own = docs[doc]
                kept[doc] = doc_id, total, start, own[start - begin :].copy()
            docs, added, held = kept, [], 0
    for some in batched(all_of(added, 0, True), SEQUENCES_AT_ONCE):
        yield rows(iter(some))


def pack(docs: DataFrame, path: str, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A sequence number has the task's partition in its upper bits. Sequences never span partitions.
    """
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + (", ids array<int>" if with_ids else "")
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _packed(batches, path, end_id, with_ids), schema
    )
