"""Which occupied cells are near each other, found tile by tile.

A tile is a box of 16 cells a side. A cell goes to its own tile and, as a halo, to those tiles that its reach of three
cells touches: 3.6 copies on average for cells at random places, 16 at most, half of the others if each pair is wanted
once. A tile holds at most 22 ** 4 cells whatever the data, so a task looks its neighbours up in a table of that many
places. Clusters are merged inside a tile first: a cell then sends one link to the lowest cell it is linked to there, not
one to each neighbour, and tiles meet through the cells of their halos.

Blocks that eps can bridge meet as pairs of blocks: the probes of one and the cells of the other, in the tiles of both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.features import AXES

REACH = 3
TILE_BITS = 4
SIDE = (1 << TILE_BITS) + 2 * REACH
# Scores are centred on zero: a tile's middle lies there, not its corner, so that the bulk of a block is not cut.
SHIFT = 1 << (TILE_BITS - 1)
# Probes of one cell that one task takes at most; more are dealt to several tasks, each with the cells of the tile.
SHARE = 16
CHUNK = 256

_CELL = [f"c{k}" for k in AXES]
_LOW, _HIGH = ([f"{edge}{k}" for k in AXES] for edge in ("lo", "hi"))
_TILE = [f"t{k}" for k in AXES]
_CARRIED = ["id", "n", *_CELL, *_LOW, *_HIGH]
_KEY = ["a_block", "b_block", "penalty", "share", *_TILE]
_STRIDES = np.array([SIDE**3, SIDE**2, SIDE, 1])

_PAIRS = "a_id long, b_id long, penalty double, b_n long, sure boolean"


def steps() -> np.ndarray:
    """Steps to all cells that can be within eps, the cell itself included: a side is just below eps/2, so at most 2 cells lie between."""
    every = np.array(list(product(range(-REACH, REACH + 1), repeat=len(AXES))))
    return every[(np.maximum(abs(every) - 1, 0) ** 2).sum(axis=1) <= 4]


@dataclass
class Boxes:
    """Cells or probes of one tile: ids, rows, places in the tile's table, lowest and highest values."""

    ids: np.ndarray
    n: np.ndarray
    places: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _boxes(table: pa.Table) -> Boxes:
    def stacked(names: list[str]) -> np.ndarray:
        return np.stack([table.column(c).to_numpy() for c in names], axis=1)

    begin = (stacked(_TILE) << TILE_BITS) - SHIFT - REACH
    places = (stacked(_CELL) - begin) @ _STRIDES
    return Boxes(table.column("id").to_numpy(), table.column("n").to_numpy(), places, stacked(_LOW), stacked(_HIGH))


def _squared(sides: np.ndarray, penalty: float) -> np.ndarray:
    total = sides[:, 0] * sides[:, 0]
    for k in range(1, sides.shape[1]):
        total = total + sides[:, k] * sides[:, k]
    return penalty + total


def _near(probes: Boxes, cells: Boxes, lower: np.ndarray, penalty: float, eps: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(probe, cell, sure) by position, for cells whose box is within eps and whose position is above the probe's ``lower``."""
    table = np.full(SIDE ** len(AXES), -1, np.int32)
    table[cells.places] = np.arange(len(cells.ids))
    around = steps() @ _STRIDES
    for start in range(0, len(probes.ids), CHUNK):
        found = table[probes.places[start : start + CHUNK, None] + around]
        a, slot = np.nonzero(found > lower[start : start + CHUNK, None])
        b = found[a, slot]
        a = a + start
        ahead, behind = cells.low[b] - probes.high[a], probes.low[a] - cells.high[b]
        close = _squared(np.maximum(np.maximum(ahead, behind), 0.0), penalty) <= eps * eps
        a, b = a[close], b[close]
        farthest = np.maximum(cells.high[b] - probes.low[a], probes.high[a] - cells.low[b])
        yield a, b, _squared(farthest, penalty) <= eps * eps


def _hang(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of a and b; afterwards every position points to its root, the lowest of its tree."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _own_and_halo(table: pa.Table) -> tuple[Boxes, Boxes, np.ndarray] | None:
    """Own cells, all cells with the own ones first, and for each own cell its position: pairs lie above it."""
    own = table.column("own").to_numpy()
    if not own.any():
        return None
    order = np.lexsort((table.column("id").to_numpy(), ~own))
    cells = _boxes(table.take(pa.array(order)))
    n = int(own.sum())
    probes = Boxes(cells.ids[:n], cells.n[:n], cells.places[:n], cells.low[:n], cells.high[:n])
    return probes, cells, np.arange(n)


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in schema.split(", ")])


def _linked_pairs(batches: Iterator[pa.RecordBatch], eps: float) -> Iterator[pa.RecordBatch]:
    """All pairs of near cells, each once, the lower id first."""
    met = _own_and_halo(pa.Table.from_batches(list(batches)))
    if met is None:
        return
    probes, cells, lower = met
    for a, b, sure in _near(probes, cells, lower, 0.0, eps):
        low, high = np.minimum(a, b), np.maximum(a, b)
        swap = cells.ids[low] > cells.ids[high]
        first, second = np.where(swap, high, low), np.where(swap, low, high)
        yield _batch(_PAIRS, cells.ids[first], cells.ids[second], np.zeros(len(a)), cells.n[second], sure)


def _merged(batches: Iterator[pa.RecordBatch], eps: float) -> Iterator[pa.RecordBatch]:
    """A sure link from each cell to the lowest one of its cluster in this tile, and the open pairs between such clusters.

    The neighbours are looked up twice, so that no more than a chunk of pairs is held.
    """
    met = _own_and_halo(pa.Table.from_batches(list(batches)))
    if met is None:
        return
    probes, cells, lower = met
    parent = np.arange(len(cells.ids))
    for a, b, sure in _near(probes, cells, lower, 0.0, eps):
        _hang(parent, a[sure], b[sure])
    lowest = cells.ids.copy()
    np.minimum.at(lowest, parent, cells.ids)
    root = lowest[parent]
    hung = np.flatnonzero(root != cells.ids)
    yield _batch(_PAIRS, cells.ids[hung], root[hung], np.zeros(len(hung)), cells.n[hung], np.ones(len(hung), bool))
    for a, b, sure in _near(probes, cells, lower, 0.0, eps):
        still = ~sure & (parent[a] != parent[b])
        a, b = a[still], b[still]
        yield _batch(_PAIRS, cells.ids[a], cells.ids[b], np.zeros(len(a)), cells.n[b], np.zeros(len(a), bool))


def _probed(batches: Iterator[pa.RecordBatch], eps: float) -> Iterator[pa.RecordBatch]:
    """All near pairs of a probe and a cell."""
    table = pa.Table.from_batches(list(batches))
    own = table.column("own").to_numpy()
    if own.all() or not own.any():
        return
    penalty = table.column("penalty")[0].as_py()
    probes, cells = _boxes(table.filter(pa.array(own))), _boxes(table.filter(pa.array(~own)))
    for a, b, sure in _near(probes, cells, np.full(len(probes.ids), -1), penalty, eps):
        yield _batch(_PAIRS, probes.ids[a], cells.ids[b], np.full(len(a), penalty), cells.n[b], sure)


def _tile(cell: str, ahead: int = 0) -> Column:
    return F.shiftright(F.col(cell) + SHIFT + ahead, TILE_BITS)


def _with_own_tile(df: DataFrame) -> DataFrame:
    return df.withColumns({t: _tile(c) for t, c in zip(_TILE, _CELL, strict=True)})


def _with_tiles(df: DataFrame) -> DataFrame:
    for t, c in zip(_TILE, _CELL, strict=True):
        df = df.withColumn(t, F.explode(F.sequence(_tile(c, -REACH), _tile(c, REACH))))
    return df


def _in_tiles(rows: DataFrame, find: Callable, eps: float) -> DataFrame:
    placed = rows.select(*_KEY, "own", *[F.col(c).cast("long") if c in ("id", "n") else F.col(c) for c in _CARRIED])

    def of_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return find(batches, eps)

    return placed.groupBy(*_KEY).applyInArrow(of_tile, _PAIRS)


def _inside_blocks(cells: DataFrame) -> DataFrame:
    """Cells in their own tile and in the touched tiles before it, where the pairs across tiles are found once."""
    placed = _with_tiles(cells.select("block", *_CARRIED))
    mine = F.struct(*[_tile(c).alias(t) for t, c in zip(_TILE, _CELL, strict=True)])
    at = F.struct(*_TILE)
    return placed.filter(at <= mine).select(
        F.col("block").alias("a_block"), F.col("block").alias("b_block"), F.lit(0.0).alias("penalty"),
        F.lit(0).alias("share"), *_TILE, (at == mine).alias("own"), *_CARRIED,
    )


def _met(probes: DataFrame, cells: DataFrame, blocks: DataFrame, per_cell: int, eps: float) -> DataFrame:
    """Near pairs of probes and cells over the given pairs of blocks."""
    shares = -(-per_cell // SHARE)
    sides = {"a": _with_own_tile(probes), "b": _with_tiles(cells)}
    dealt = {"a": F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))}
    rows = [
        placed.withColumnRenamed("block", f"{side}_block")
        .join(blocks, f"{side}_block")
        .select("a_block", "b_block", "penalty", dealt[side].alias("share"), *_TILE, F.lit(side == "a").alias("own"), *_CARRIED)
        for side, placed in sides.items()
    ]
    return _in_tiles(rows[0].unionByName(rows[1]), _probed, eps)


def near_cells(cells: DataFrame, eps: float, bridges: DataFrame | None, merged: bool) -> DataFrame:
    """``(a_id, b_id, penalty, b_n, sure)``: pairs of cells whose boxes are within eps, each once; ``sure`` if all their rows are.

    With ``merged`` there are fewer: sure links that connect what the sure pairs of a block connect, and only those open
    pairs whose cells their tile has not connected. ``bridges`` are the pairs of blocks that eps bridges.
    """
    found = _in_tiles(_inside_blocks(cells), _merged if merged else _linked_pairs, eps)
    if bridges is not None:
        found = found.unionByName(_met(cells, cells, bridges.select("a_block", "b_block", "penalty"), 1, eps))
    return found


def probed_cells(probes: DataFrame, cells: DataFrame, eps: float, bridges: DataFrame | None, per_cell: int) -> DataFrame:
    """``(a_id, b_id, penalty, b_n, sure)``: all cells within eps of each probe. A cell holds at most ``per_cell`` probes."""
    own = cells.select(F.col("block").alias("a_block")).distinct()
    blocks = own.select("a_block", F.col("a_block").alias("b_block"), F.lit(0.0).alias("penalty"))
    if bridges is not None:
        there = bridges.select("a_block", "b_block", "penalty")
        back = bridges.select(F.col("b_block").alias("a_block"), F.col("a_block").alias("b_block"), "penalty")
        blocks = blocks.unionByName(there).unionByName(back)
    return _met(probes, cells, blocks, per_cell, eps)
