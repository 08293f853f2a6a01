"""Token-ID output as patched frame-of-reference blocks.

``write_ids`` sorts documents by doc_id over range partitions, encodes their texts, ends each with one id, and stores
the ids in files. Files are rows of a table on shared storage (``part``, ``seq``, ``n_ids``, ``payload``): Spark writes them
with its own commit, so a lost task leaves no half file, and any store that Spark reaches will do. ``read_ids`` decodes the
payloads again; nothing but them is needed.

A payload, little-endian:

* ``KPF1``; number of documents (u32), of blocks (u32) and of ids (u64)
* doc_id (i64) and number of ids (u64) of each document
* block index: start of each block in the block area (u64), and its end
* blocks of ``BLOCK`` ids (the last may be shorter): least id (u32), width (u8), number of exceptions (u8), ids less the
  least in ``width`` bits each, filled up to whole 64-bit words; then place (u8) and full difference (u32) of each exception

The width is that of the ``PERCENTILE`` of the differences in the block, so a few large ids do not widen all others.

Defined cases: a null or empty text is the end id alone; rows of equal doc_id are documents of their own, ordered by a
hash of their text; a null doc_id comes first and is stored as
the least i64; an empty table has no file. A document lies in one file and is
encoded in one task, with about 28 bytes of memory per byte of its text. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm import arrays as A
from kinfold.llm import token_ids
from kinfold.sources.scratch import materialize

BLOCK = 128
PERCENTILE = 90
FILE_IDS = 1 << 20
_MAGIC = b"KPF1"
_WORD = 64
_NO_ID = -(1 << 63)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1))).astype(np.int64) + 1, 0)


def _words(width: np.ndarray | int):
    return (BLOCK * width + _WORD - 1) // _WORD


def _pack_rows(rows: np.ndarray, width: int) -> np.ndarray:
    """Each row of BLOCK values in ``width`` bits per value, as 64-bit words."""
    out = np.zeros((len(rows), _words(width)), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, _WORD)
        out[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + width > _WORD:
            out[:, word + 1] |= rows[:, i] >> np.uint64(_WORD - shift)
    return out


def _unpack_rows(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), BLOCK), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, _WORD)
        values = words[:, word] >> np.uint64(shift)
        if shift + width > _WORD:
            values |= words[:, word + 1] << np.uint64(_WORD - shift)
        out[:, i] = values & mask
    return out


def pack_ids(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    n_blocks = -(-len(ids) // BLOCK)
    # A short last block is filled with its last id, which changes neither least id nor width much.
    full = np.concatenate([ids, np.repeat(ids[-1:], n_blocks * BLOCK - len(ids))]).astype(np.uint64).reshape(-1, BLOCK)
    least = full.min(axis=1) if n_blocks else np.zeros(0, np.uint64)
    rest = full - least[:, None]
    k = BLOCK * PERCENTILE // 100
    widths = _widths(np.partition(rest, k, axis=1)[:, k]) if n_blocks else np.zeros(0, np.int64)
    odd = rest >> widths[:, None].astype(np.uint64) != 0
    n_odd = odd.sum(axis=1)
    sizes = 6 + 8 * _words(widths) + 5 * n_odd
    starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    area = np.zeros(int(starts[-1]), np.uint8)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(at), values.itemsize * values.size // max(len(at), 1))
        area[at[:, None] + np.arange(raw.shape[1])] = raw

    put(starts[:-1], least.astype("<u4"))
    area[starts[:-1] + 4] = widths
    area[starts[:-1] + 5] = n_odd
    for width in np.unique(widths):
        if width:
            rows = np.flatnonzero(widths == width)
            kept = rest[rows] & np.uint64((1 << int(width)) - 1)
            put(starts[rows] + 6, _pack_rows(kept, int(width)).astype("<u8"))
    row, place = np.nonzero(odd)
    order = np.arange(len(row)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    lists = starts[row] + 6 + 8 * _words(widths[row])
    area[lists + order] = place
    if len(row):
        put(lists + n_odd[row] + 4 * order, rest[row, place].astype("<u4"))
    head = _MAGIC + np.array([len(doc_ids), n_blocks], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    table = doc_ids.astype("<i8").tobytes() + counts.astype("<u8").tobytes()
    return head + table + starts.astype("<u8").tobytes() + area.tobytes()


def unpack_ids(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids)."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a block file")
    n_docs, n_blocks = (int(v) for v in np.frombuffer(payload, "<u4", 2, 4))
    n_ids = int(np.frombuffer(payload, "<u8", 1, 12)[0])
    at = 20
    doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
    counts = np.frombuffer(payload, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    at += 16 * n_docs
    starts = np.frombuffer(payload, "<u8", n_blocks + 1, at).astype(np.int64)
    area = np.frombuffer(payload, np.uint8, int(starts[-1]), at + 8 * (n_blocks + 1))

    def take(places: np.ndarray, kind: str, count: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * count
        return np.ascontiguousarray(area[places[:, None] + np.arange(size)]).view(kind)

    least = take(starts[:-1], "<u4", 1).astype(np.uint64)
    widths, n_odd = area[starts[:-1] + 4].astype(np.int64), area[starts[:-1] + 5].astype(np.int64)
    out = np.zeros((n_blocks, BLOCK), np.uint64)
    for width in np.unique(widths):
        if width:
            rows = np.flatnonzero(widths == width)
            out[rows] = _unpack_rows(take(starts[rows] + 6, "<u8", _words(int(width))), int(width))
    row = np.repeat(np.arange(n_blocks), n_odd)
    if len(row):
        order = np.arange(len(row)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
        lists = starts[row] + 6 + 8 * _words(widths[row])
        out[row, area[lists + order]] = take(lists + n_odd[row] + 4 * order, "<u4", 1)[:, 0]
    return doc_ids, counts, (out + least).reshape(-1)[:n_ids].astype(np.uint32)


def _files(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def file() -> pa.RecordBatch:
        docs, counts, ids = (np.concatenate(columns) for columns in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int64()),
                pa.array([seq], pa.int64()),
                pa.array([len(ids)], pa.int64()),
                pa.array([pack_ids(docs, counts, ids)], pa.binary()),
            ],
            names=["part", "seq", "n_ids", "payload"],
        )

    for batch, ids, first in token_ids.encoded_slices(batches, path):
        ends = first[1:] + np.arange(len(first) - 1)
        ended = np.full(len(ids) + len(ends), end_id, np.uint32)
        place = np.ones(len(ended), bool)
        place[ends] = False
        ended[place] = ids
        docs = pc.fill_null(batch.column("doc_id").cast(pa.int64()), _NO_ID).to_numpy()
        held.append((docs, np.diff(first) + 1, ended))
        if sum(len(h[2]) for h in held) >= FILE_IDS:
            yield file()
            seq += 1
            held = []
    if held:
        yield file()


def write_ids(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """The table of files, in ascending doc_id order by (part, seq)."""
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text")
    )
    files = ordered.mapInArrow(
        lambda batches: _files(batches, path, end_id), "part long, seq long, n_ids long, payload binary"
    )
    return materialize(files, "id-blocks")


def read_ids(files: DataFrame, spread, schema: str) -> DataFrame:
    """Decodes each file; ``spread(part, seq, doc_ids, counts, ids)`` makes its rows as an Arrow batch."""

    def decode(batches):
        for batch in batches:
            for part, seq, payload in zip(*[batch.column(c).to_pylist() for c in ("part", "seq", "payload")], strict=True):
                yield spread(part, seq, *unpack_ids(payload))

    return files.select("part", "seq", "payload").mapInArrow(decode, schema)


def _checked(part: int, seq: int, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(counts)
    sums = [zlib.crc32(ids[end - n : end].astype("<u4").tobytes()) for end, n in zip(ends, counts, strict=True)]
    columns = [np.full(len(doc_ids), part), np.full(len(doc_ids), seq), doc_ids, ends - counts, counts, sums]
    names = ["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"]
    arrays = [pa.array(np.asarray(c), pa.int64()) for c in columns]
    arrays[2] = pa.array(doc_ids, pa.int64(), mask=doc_ids == _NO_ID)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def id_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, as read from the files.

    Starts are running sums: over the files of a part, and over the parts (one row per range partition).
    """
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("_parts_before")
    )
    before = sizes.withColumn("_before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    rows = read_ids(
        files, _checked, "part long, seq long, doc_id long, start long, n_tokens long, ids_crc32 long"
    ).join(before.drop("n_ids"), ["part", "seq"])
    start = F.col("start") + F.col("_before") + F.col("_parts_before")
    return rows.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
