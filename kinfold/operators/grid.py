"""Who is within eps of whom, answered per grid cell instead of per pair of rows.

The cell side is eps/2 in four dimensions, so all rows of one cell are neighbours. Two cells are compared by the
bounding boxes of their rows: far apart, surely linked, or open. Only open pairs look inside, by halving the boxes
until they are decided or small enough to compare the points of one pair of boxes directly. Work and output grow
with the cells and the rows, never with the square of a cell's population.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.features import AXES, CATEGORIES, Z
from kinfold.sources.scratch import materialize

CELL = [f"c{k}" for k in AXES]
BOX = [f"{edge}{k}" for edge in ("lo", "hi") for k in AXES]

# Rows of different categories are at least sqrt(8) apart, see features.
CROSS_BLOCK_EPS = 8**0.5

# Two boxes with at most this many pairs of points are compared point by point, others are halved. Either way the result
# is exact; the number only bounds the work on one pair.
POINT_PAIRS = 4096

# Slightly below eps/2, so rounding cannot push two rows of one cell beyond eps.
_SHRINK = 1 - 1e-9


def cell_side(eps: float) -> float:
    return eps / 2 * _SHRINK


def with_cells(rows: DataFrame, eps: float) -> DataFrame:
    side = cell_side(eps)
    return rows.withColumns({c: F.floor(F.col(z) / side) for c, z in zip(CELL, Z, strict=True)})


def _boxes() -> list[Column]:
    lows = [F.min(z).alias(f"lo{k}") for k, z in zip(AXES, Z, strict=True)]
    return lows + [F.max(z).alias(f"hi{k}") for k, z in zip(AXES, Z, strict=True)]


def _total(parts: list[Column]) -> Column:
    return reduce(Column.__add__, parts)


def _nearest() -> Column:
    """Squared distance between the boxes of sides ``a`` and ``b``."""
    gaps = [
        F.greatest(
            F.lit(0.0), F.col(f"b_lo{k}") - F.col(f"a_hi{k}"), F.col(f"a_lo{k}") - F.col(f"b_hi{k}")
        )
        for k in AXES
    ]
    return F.col("penalty") + _total([gap * gap for gap in gaps])


def _farthest() -> Column:
    reach = [
        F.greatest(F.col(f"b_hi{k}") - F.col(f"a_lo{k}"), F.col(f"a_hi{k}") - F.col(f"b_lo{k}")) for k in AXES
    ]
    return F.col("penalty") + _total([r * r for r in reach])


def _sided(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in columns])


def occupied_cells(rows: DataFrame) -> DataFrame:
    """One row per occupied cell: population, bounding box, lowest path, and the sums that scoring needs."""
    return rows.groupBy("block", *CELL).agg(
        F.count("*").alias("n"),
        *_boxes(),
        F.min("path").alias("first_path"),
        *[F.sum(F.col(z) * F.col("inv_norm")).alias(f"sum{k}") for k, z in zip(AXES, Z, strict=True)],
        F.sum("inv_norm").alias("sum_inv"),
    )


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs of blocks that eps can bridge, with their penalty.

    A penalty within eps squared needs a category share of at least 1/eps squared, so at most eps**2 values per
    category and eps**4 blocks qualify, whatever the data holds; only those are paired.
    """
    limit = eps * eps
    penalties = dict(zip(CATEGORIES, ("ext_penalty", "class_penalty"), strict=True))
    columns = ["block", *penalties, *penalties.values()]
    steps = []
    for differing in (["extension"], ["size_class"], CATEGORIES):
        usable = blocks
        for category in differing:
            usable = usable.filter(F.col(penalties[category]) <= limit)
        on = [F.col("a_block") < F.col("b_block")]
        for category in CATEGORIES:
            equal = F.col(f"a_{category}") == F.col(f"b_{category}")
            on.append(~equal if category in differing else equal)
        penalty = _total([F.col(f"{side}_{penalties[c]}") for c in differing for side in "ab"])
        steps.append(
            _sided(usable, "a", columns)
            .join(_sided(usable, "b", columns), on)
            .select("a_block", "b_block", penalty.alias("penalty"))
        )
    return reduce(DataFrame.unionByName, steps).filter(F.col("penalty") <= limit)


def _sub_boxes(points: DataFrame, side: str, level: int, eps: float) -> DataFrame:
    """Boxes of the points of each item, cut by halving the cell ``level`` times."""
    step = cell_side(eps) / 2**level
    keyed = points.withColumns({f"k{k}": F.floor(F.col(z) / step) for k, z in zip(AXES, Z, strict=True)})
    keys = [f"k{k}" for k in AXES]
    return _sided(
        keyed.groupBy("id", *keys).agg(F.count("*").alias("n"), F.sum("w").alias("w"), *_boxes()),
        side,
        ["id", *keys, "n", "w", *BOX],
    )


def _still_asked(points: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """The points of the items on one side of the pairs; few items are left after the first boxes."""
    return points.join(pairs.select(F.col(f"{side}_id").alias("id")).distinct(), "id", "left_semi")


def settle_pairs(
    open_pairs: DataFrame,
    a_points: DataFrame,
    b_points: DataFrame,
    eps: float,
    count: bool,
    until: tuple[str, ...] = ("a_id", "b_id"),
) -> DataFrame:
    """Look inside open pairs: ``(*until, hits)`` for pairs with rows within eps.

    Points are distinct vectors ``(id, z1..z4, w)`` with the number of rows ``w``. With ``count``, ``hits`` is the
    number of b's rows within eps of a's single point; without it, a pair stops as soon as one link is found, and with
    columns of the pairs as ``until``, all pairs that share their values stop together.

    Points and their boxes grow with the rows: they are merged, not sent to every task through the driver.
    """
    limit = eps * eps
    keys = [f"k{k}" for k in AXES]
    asked = list(until)
    named = list(dict.fromkeys(["a_id", "b_id", *asked]))
    pairs = open_pairs.select(*named, "penalty")
    ends = {"a": a_points, "b": b_points}
    found: list[DataFrame] = []
    level = 0
    boxes = {side: _sub_boxes(points, side, level, eps) for side, points in ends.items()}
    work = pairs.join(boxes["a"].hint("merge"), "a_id").join(boxes["b"].hint("merge"), "b_id")
    while True:
        near = work.filter(_nearest() <= limit).withColumn("sure", _farthest() <= limit)
        work = materialize(
            near.select(
                *named, "penalty", "sure", "a_n", "b_n", "b_w", *[f"{s}_{k}" for s in "ab" for k in keys]
            ),
            "box-pairs",
        )
        found.append(work.filter("sure").select(*asked, F.col("b_w").alias("hits")))
        todo = work.filter("NOT sure")
        if not count:
            todo = todo.join(work.filter("sure").select(*asked).distinct(), asked, "left_anti")
        small = F.col("a_n") * F.col("b_n") <= POINT_PAIRS
        close = todo.filter(small)
        inside = ends if count else {side: _still_asked(points, close, side) for side, points in ends.items()}
        met = _compare_points(close, inside, level, eps, asked)
        todo = todo.filter(~small).select(*named, "penalty", *[f"{s}_{k}" for s in "ab" for k in keys])
        if not count:
            met = materialize(met, "met-pairs")
            todo = todo.join(met.select(*asked), asked, "left_anti")
        found.append(met)
        if todo.isEmpty():
            break
        level += 1
        work = todo
        for side, points in ends.items():
            boxes = _sub_boxes(points if count else _still_asked(points, todo, side), side, level, eps)
            children = boxes.withColumns({f"_p{k}": F.floor(F.col(f"{side}_k{k}") / 2) for k in AXES})
            parents = work.withColumnsRenamed({f"{side}_k{k}": f"_p{k}" for k in AXES})
            work = parents.join(children.hint("merge"), [f"{side}_id", *[f"_p{k}" for k in AXES]]).drop(
                *[f"_p{k}" for k in AXES]
            )
    hits = reduce(DataFrame.unionByName, found)
    return hits.groupBy(*asked).agg(F.sum("hits").alias("hits"))


def _compare_points(pairs: DataFrame, ends: dict[str, DataFrame], level: int, eps: float, asked: list[str]) -> DataFrame:
    step = cell_side(eps) / 2**level
    named = dict.fromkeys(["a_id", "b_id", *asked])
    work = pairs.select(*named, "penalty", *[f"{s}_k{k}" for s in "ab" for k in AXES])
    for side, points in ends.items():
        keyed = points.select(
            F.col("id").alias(f"{side}_id"),
            *[F.floor(F.col(z) / step).alias(f"{side}_k{k}") for k, z in zip(AXES, Z, strict=True)],
            *[F.col(z).alias(f"{side}_{z}") for z in Z],
            F.col("w").alias(f"{side}_w"),
        )
        work = work.join(keyed.hint("merge"), [f"{side}_id", *[f"{side}_k{k}" for k in AXES]])
    squared = F.col("penalty") + _total(
        [(F.col(f"a_{z}") - F.col(f"b_{z}")) * (F.col(f"a_{z}") - F.col(f"b_{z}")) for z in Z]
    )
    return work.filter(squared <= eps * eps).groupBy(*asked).agg(F.sum("b_w").alias("hits"))
