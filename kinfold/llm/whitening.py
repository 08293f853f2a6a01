"""Embedding whitening on leading components found by contour integration (see ``feast``).

Rows without a usable vector go; the entries ``c`` of the others become the whole numbers floor(256 c). The fit list has each
distinct vector once. One pass over it sums the vectors, a second the products of centred vectors, a third, after the
components are known, the covariance of the whitened vectors. Each pass sums blocks inside tasks and then in about the
square root of the number of tasks groups, so the driver sees that many square matrices of a vector's length, however
many rows there are. Sums of whole numbers are exact; sums of products are in doubles.

Defined cases: a vector with a null, infinite or NaN entry is dropped, an empty one is not. Shorter vectors count as filled up with
zeros. Entries beyond +-``LARGEST`` count as that; a ``deviation`` that needs more than 63 bits is null. Rows that repeat are returned each
and fitted once; a null vec_id is an id like others. Components of no variance (beyond rounding) can't be whitened and are
left out, so there may be fewer than asked for, and none for a single distinct vector. An empty table gives no rows.
Columns other than vec_id and the vector are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import feast
from kinfold.sources.scratch import materialize

COMPONENTS = 4
SCALE = 256
LARGEST = 1 << 32
BLOCK = 4096
#: A component's variance must be more than this part of the largest one.
LEAST_SHARE = 1e-13


@dataclass(frozen=True)
class Fit:
    """``values`` by falling size and ``vectors`` as columns, of the covariance of ``n`` vectors with ``sums``."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / max(self.n, 1)) @ self.vectors / np.sqrt(self.values)


def _usable(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the rows with a usable vector, and their whole numbers."""
    lists = batch.column("vector")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    entries = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = lists.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    good[owner[~np.isfinite(entries)]] = False
    x = np.zeros((len(sizes), width), np.int64)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.clip(np.nan_to_num(np.floor(SCALE * entries)), -LARGEST, LARGEST)
    x[owner, place] = whole.astype(np.int64)
    rows = np.flatnonzero(good)
    return rows, x[rows]


def _keys(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, x = _usable(batch, width)
        ends = pa.py_buffer((np.arange(len(x) + 1) * 8 * width).astype(np.int32).tobytes())
        keys = pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(x.astype("<i8").tobytes())])
        yield pa.RecordBatch.from_arrays([keys], names=["x"])


def fit_list(rows: DataFrame, width: int) -> DataFrame:
    """Each distinct vector once, as little-endian 64-bit numbers, in a table."""
    keys = rows.select("vector").mapInArrow(lambda batches: _keys(batches, width), "x binary")
    return materialize(keys.distinct(), "whitening-fit")


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            raw = b"".join(batch.column("x").slice(start, BLOCK).to_pylist())
            yield np.frombuffer(raw, "<i8").reshape(-1, width)


def _summed(fitted: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``of(block)`` over all blocks, added up in tasks, then in groups of tasks, then on the driver."""
    kind = of(np.zeros((0, width), np.int64)).dtype
    groups = int(np.ceil(np.sqrt(max(fitted.rdd.getNumPartitions(), 1))))

    def tasks(batches):
        total = None
        for block in _blocks(batches, width):
            total = of(block) if total is None else total + of(block)
        if total is not None:
            group = TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_pydict({"group": pa.array([group], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    def added(sums: list[bytes]) -> np.ndarray:
        return sum(np.frombuffer(s, kind) for s in sums)

    def meet(table: pa.Table) -> pa.Table:
        return pa.table({"sums": pa.array([added(table.column("sums").to_pylist()).tobytes()], pa.binary())})

    met = fitted.mapInArrow(tasks, "group int, sums binary").groupBy("group").applyInArrow(meet, "sums binary").collect()
    return added([row.sums for row in met]) if met else None


def fit(fitted: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    sums = _summed(fitted, width, lambda x: np.r_[len(x), x.sum(axis=0)].astype(np.int64))
    if sums is None:
        return Fit(0, np.zeros(width, np.int64), np.zeros(0), np.zeros((width, 0)), 0.0)
    n, mean = int(sums[0]), sums[1:] / sums[0]

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return (centred.T @ centred).ravel()

    covariance = _summed(fitted, width, products).reshape(width, width) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = feast.leading(covariance, components)
    kept = values > LEAST_SHARE * max(values.max(initial=0.0), 0.0)
    return Fit(n, sums[1:], values[kept], vectors[:, kept], float(np.trace(covariance)))


def identity_error(fitted: DataFrame, width: int, found: Fit) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    size = len(found.values)
    if not size:
        return 0.0
    mean = _summed(fitted, width, lambda x: found.whitened(x).sum(axis=0)) / found.n

    def products(x: np.ndarray) -> np.ndarray:
        centred = found.whitened(x) - mean
        return (centred.T @ centred).ravel()

    covariance = _summed(fitted, width, products).reshape(size, size) / found.n
    return float(np.abs(covariance - np.eye(size)).max())


def _deviations(x: np.ndarray, found: Fit) -> list[int | None]:
    """Sums of (n x - S)^2, exact; null where 63 bits are too few."""
    largest = int(np.abs(x).max(initial=0)) * found.n + int(np.abs(found.sums).max(initial=0))
    if x.shape[1] * largest**2 < 1 << 63:
        return ((found.n * x - found.sums) ** 2).sum(axis=1).tolist()
    exact = [sum((found.n * int(c) - int(s)) ** 2 for c, s in zip(row, found.sums, strict=True)) for row in x]
    return [value if value < 1 << 63 else None for value in exact]


_WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    width = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    if width <= 0:
        return embeddings.sparkSession.createDataFrame([], _WHITENED)
    fitted = fit_list(rows, width)
    found = fit(fitted, width, components)
    error = identity_error(fitted, width, found)
    size = len(found.values)

    def spread(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                usable, x = _usable(part, width)
                each = np.repeat(np.arange(len(usable)), size)
                columns = [
                    part.column("vec_id").take(pa.array(usable[each], pa.int64())),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(usable))),
                    pa.array(np.full(len(each), found.n, np.int64)),
                    pa.array(_deviations(x, found), pa.int64()).take(pa.array(each, pa.int64())),
                    pa.array(found.whitened(x).ravel(), pa.float64()),
                    pa.array(np.tile(found.values / (found.trace or 1.0), len(usable)), pa.float64()),
                    pa.array(np.full(len(each), error)),
                ]
                names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(spread, _WHITENED)
