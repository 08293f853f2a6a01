"""Near copies: density clusters (DBSCAN) of standardised metadata, and each file's mean similarity to its cluster.

Only metadata is compared, never content or names. The rows are read for the statistics, for the cells and for the
final join; everything between works on the table of occupied cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold import labels, schemas
from kinfold.operators import features, grid, tiles
from kinfold.operators.components import connected_components
from kinfold.operators.features import AXES, Z
from kinfold.operators.grid import BOX, CELL
from kinfold.operators.numbering import number_rows
from kinfold.sources.scratch import materialize

_SUMS = [*[f"sum{k}" for k in AXES], "sum_inv"]
_CLUSTER = ["cluster_id", "cluster_size", *[f"total{k}" for k in AXES], "onehot_total"]


@dataclass(frozen=True)
class Grid:
    """Candidates with scores, block and cell; the occupied cells; the blocks; the block pairs eps can bridge."""

    eps: float
    rows: DataFrame
    cells: DataFrame
    blocks: DataFrame
    bridges: DataFrame | None


def build_grid(candidates: DataFrame, eps: float = labels.EPS) -> Grid:
    stats = materialize(features.block_stats(candidates), "block-stats")
    scale = features.scaling(stats)
    blocks = features.category_blocks(stats, max(scale.rows, 1))
    squares = F.col("ext_norm") + F.col("class_norm")
    for z in Z:
        squares = squares + F.col(z) * F.col(z)
    own_blocks = blocks.select(*features.CATEGORIES, "block", "ext_norm", "class_norm")
    rows = (
        features.standardized(candidates, scale)
        .join(own_blocks, features.CATEGORIES)
        .withColumn("inv_norm", F.when(squares > 0, 1 / F.sqrt(squares)).otherwise(0.0))
        .drop("ext_norm", "class_norm")
    )
    rows = grid.with_cells(rows, eps)
    # Ids in the order of the coordinates keep the number of component rounds low.
    placed = grid.occupied_cells(rows).repartitionByRange("block", *CELL).sortWithinPartitions("block", *CELL)
    cells = materialize(placed.withColumn("id", F.monotonically_increasing_id()), "cells")
    bridges = materialize(grid.block_pairs(blocks, eps), "bridges") if eps >= grid.CROSS_BLOCK_EPS else None
    return Grid(eps, rows, cells, blocks, bridges)


def _points(
    space: Grid, pairs: DataFrame, sides: str, cells: DataFrame, single_rows: DataFrame | None = None
) -> DataFrame:
    """Distinct vectors of the ``cells`` that occur in ``pairs``, with the number of rows of each.

    ``single_rows`` adds rows of cells that count only in part.
    """
    ids = pairs.select(F.explode(F.array(*[f"{side}_id" for side in sides])).alias("id")).distinct()
    wanted = materialize(cells.select("block", *CELL, "id").join(ids, "id", "left_semi"), "open-cells")
    inside = space.rows.join(wanted, ["block", *CELL]).select("id", *Z)
    if single_rows is not None:
        inside = inside.unionByName(single_rows.join(ids, "id", "left_semi").select("id", *Z))
    return materialize(inside.groupBy("id", *Z).agg(F.count("*").alias("w")), "points")


def _near_cells(space: Grid, cells: DataFrame, merged: bool) -> DataFrame:
    return materialize(tiles.near_cells(cells, space.eps, space.bridges, merged), "cell-pairs")


def _settled(
    space: Grid,
    open_pairs: DataFrame,
    whole: DataFrame,
    single_rows: DataFrame | None = None,
    until: tuple[str, ...] = ("a_id", "b_id"),
) -> DataFrame:
    points = _points(space, open_pairs, "ab", whole, single_rows)
    return grid.settle_pairs(open_pairs, points, points, space.eps, False, until).select(*until)


def linked_cells(space: Grid) -> DataFrame:
    """All pairs of cells that hold rows within eps of each other (each pair once)."""
    met = _near_cells(space, space.cells, merged=False)
    inside = _settled(space, met.filter("NOT sure"), space.cells)
    return met.filter("sure").select("a_id", "b_id").unionByName(inside)


def _components(space: Grid, cells: DataFrame, whole: DataFrame, single_rows: DataFrame | None = None) -> DataFrame:
    """``(id, root)`` of the cells: the ``whole`` ones and those of ``single_rows``.

    Open pairs are only looked into if the sure links left their cells apart, and until one of the pairs between two
    roots is a link: the others would only say the same.
    """
    met = _near_cells(space, cells, merged=True)
    links, open_pairs = met.filter("sure").select("a_id", "b_id"), met.filter("NOT sure")
    rooted = cells.select("id").join(
        connected_components(links, "a_id", "b_id").withColumnRenamed("node", "id"), "id", "left"
    )
    rooted = rooted.select("id", F.coalesce("root", "id").alias("root"))
    between = ("low_root", "high_root")
    apart = open_pairs.select("a_id", "b_id", "penalty")
    for side in "ab":
        apart = apart.join(
            rooted.select(F.col("id").alias(f"{side}_id"), F.col("root").alias(f"{side}_root")), f"{side}_id"
        )
    ends = {"low_root": F.least("a_root", "b_root"), "high_root": F.greatest("a_root", "b_root")}
    apart = apart.filter("a_root <> b_root").withColumns(ends).select("a_id", "b_id", "penalty", *between)
    bridged = _settled(space, materialize(apart, "open-pairs"), whole, single_rows, between)
    merged = connected_components(bridged, *between).select(
        F.col("node").alias("root"), F.col("root").alias("merged")
    )
    return rooted.join(merged, "root", "left").select("id", F.coalesce("merged", "root").alias("root"))


def _number_clusters(rooted_cells: DataFrame, min_rows: int) -> DataFrame:
    """``(root, cluster_id)``, numbered by the lowest path of a core file, as an index-ordered scan would."""
    clusters = rooted_cells.groupBy("root").agg(F.sum("n").alias("n"), F.min("first_path").alias("first_path"))
    return number_rows(
        clusters.filter(F.col("n") >= min_rows).select("root", "first_path"), ["first_path"], "cluster_id"
    ).select("root", "cluster_id")


def _cluster_totals(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per (cluster, block): size of the cluster and the sums of its unit vectors, seen from that block.

    Units are cells or rows: ``(cluster_id, block, n, sums)``. The one-hot part of the dot product of a row with
    the cluster's sum follows from the weights per category value, see features.
    """
    per_block = (
        units.groupBy("cluster_id", "block").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _SUMS])
    ).join(blocks.drop("n"), "block")
    # A cluster has one block, or for an eps across blocks at most eps**4: these windows stay small.
    cluster = Window.partitionBy("cluster_id")
    weight = F.sum("sum_inv").over(cluster)
    onehot: Column = F.lit(0.0)
    for name, category in zip(("ext", "class"), features.CATEGORIES, strict=True):
        r, same = F.col(f"{name}_r"), F.sum("sum_inv").over(Window.partitionBy("cluster_id", category))
        other_r = F.sum(F.col("sum_inv") * r).over(cluster) - same * r
        onehot = onehot + same * F.col(f"{name}_norm") + (weight - same) * (F.col(f"{name}_total") - r - 2) - other_r
    return per_block.select(
        "cluster_id",
        "block",
        F.sum("n").over(cluster).alias("cluster_size"),
        *[F.sum(f"sum{k}").over(cluster).alias(f"total{k}") for k in AXES],
        onehot.alias("onehot_total"),
    )


def _similarity() -> Column:
    """Mean cosine of a row to the other rows of its cluster, from the cluster's sum of unit vectors."""
    dot = F.col("onehot_total")
    for k, z in zip(AXES, Z, strict=True):
        dot = dot + F.col(z) * F.col(f"total{k}")
    own = F.when(F.col("inv_norm") > 0, 1.0).otherwise(0.0)
    score = (dot * F.col("inv_norm") - own) / (F.col("cluster_size") - 1)
    return F.when(F.col("cluster_size") > 1, F.bround(score, 4))


def _finish(labelled: DataFrame, columns: list[str]) -> DataFrame:
    return labelled.select(
        *columns,
        F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id"),
        F.when(F.col("cluster_id").isNull(), labels.ISOLATED)
        .otherwise(F.concat(F.lit(labels.CLUSTER_PREFIX), F.col("cluster_id").cast("string")))
        .alias("cluster_status"),
        F.coalesce("cluster_size", F.lit(1)).cast("long").alias("cluster_size"),
        _similarity().cast("double").alias("similarity"),
    )


def near_duplicates(exact: DataFrame, eps: float = labels.EPS, min_samples: int = labels.MIN_SAMPLES) -> DataFrame:
    """Cluster the candidates of the exact stage and score every row, at any size."""
    space = build_grid(features.candidates(exact), eps)
    if min_samples <= 2:
        labelled = _cluster_small_core(space, min_samples)
    else:
        labelled = _cluster_by_density(space, min_samples)
    return _finish(labelled, schemas.EXACT.names)


def _cluster_small_core(space: Grid, min_samples: int) -> DataFrame:
    """With min_samples up to 2 every row with a neighbour is core: clusters are components of cells."""
    roots = _components(space, space.cells, space.cells)
    rooted = space.cells.join(roots, "id")
    numbers = _number_clusters(rooted, min_samples)
    cells = rooted.join(numbers, "root").select("block", *CELL, "n", *_SUMS, "cluster_id")
    totals = materialize(_cluster_totals(cells, space.blocks), "cluster-totals")
    cells = materialize(cells.join(totals, ["cluster_id", "block"]).select("block", *CELL, *_CLUSTER), "cell-labels")
    return space.rows.join(cells, ["block", *CELL], "left")


def _cluster_by_density(space: Grid, min_samples: int) -> DataFrame:
    """General DBSCAN. Cells with min_samples rows are all core; the others hold fewer rows and are looked at by row.

    A row that is not core but within eps of core rows joins the lowest-numbered of their clusters.
    """
    dense = space.cells.filter(F.col("n") >= min_samples)
    sparse = materialize(
        space.rows.join(
            space.cells.filter(F.col("n") < min_samples).select("block", *CELL, F.col("id").alias("cell_id")),
            ["block", *CELL],
        )
        .select("path", "block", *CELL, "cell_id", *Z, "inv_norm")
        .withColumn("id", F.monotonically_increasing_id()),
        "sparse-rows",
    )
    probes = sparse.select(
        "*",
        F.lit(1).cast("long").alias("n"),
        *[F.col(z).alias(f"{edge}{k}") for edge in ("lo", "hi") for k, z in zip(AXES, Z, strict=True)],
    )
    single = sparse.select("id", *Z, F.lit(1).cast("long").alias("w"))

    met = materialize(tiles.probed_cells(probes, space.cells, space.eps, space.bridges, min_samples - 1), "row-cells")
    open_pairs = met.filter("NOT sure")
    inside = grid.settle_pairs(open_pairs, single, _points(space, open_pairs, "b", space.cells), space.eps, count=True)
    counts = met.filter("sure").select(F.col("a_id").alias("id"), F.col("b_n").alias("hits"))
    counts = counts.unionByName(inside.select(F.col("a_id").alias("id"), "hits"))
    core_ids = counts.groupBy("id").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= min_samples)
    core_ids = materialize(core_ids.select("id"), "core-rows")

    core_sparse = sparse.join(core_ids, "id", "left_semi").drop("id").withColumnRenamed("cell_id", "id")
    core_cells = materialize(
        dense.unionByName(
            grid.occupied_cells(core_sparse)
            .join(space.cells.select("block", *CELL, "id"), ["block", *CELL])
            .select(*dense.columns)
        ),
        "core-cells",
    )
    roots = _components(space, core_cells, dense, core_sparse)
    rooted = core_cells.join(roots, "id")
    numbers = _number_clusters(rooted, 1)
    cell_numbers = materialize(rooted.join(numbers, "root").select("id", "cluster_id"), "core-labels")

    border = probes.join(core_ids, "id", "left_anti")
    reach = materialize(tiles.probed_cells(border, core_cells, space.eps, space.bridges, min_samples - 1), "border-cells")
    open_pairs = reach.filter("NOT sure")
    core_points = _points(space, open_pairs, "b", dense, core_sparse)
    inside = grid.settle_pairs(open_pairs, single, core_points, space.eps, count=True)
    joined = reach.filter("sure").select("a_id", "b_id").unionByName(inside.select("a_id", "b_id"))
    border_numbers = (
        joined.join(cell_numbers.withColumnRenamed("id", "b_id"), "b_id")
        .groupBy(F.col("a_id").alias("id"))
        .agg(F.min("cluster_id").alias("cluster_id"))
    )
    core_numbers = sparse.join(core_ids, "id", "left_semi").select("id", F.col("cell_id").alias("_cell"))
    core_numbers = core_numbers.join(cell_numbers.withColumnRenamed("id", "_cell"), "_cell").select("id", "cluster_id")
    row_labels = sparse.join(core_numbers.unionByName(border_numbers), "id")

    cell_labels = dense.join(cell_numbers, "id")
    row_sums = [(F.col(z) * F.col("inv_norm")).alias(f"sum{k}") for k, z in zip(AXES, Z, strict=True)]
    units = cell_labels.select("cluster_id", "block", "n", *_SUMS).unionByName(
        row_labels.select(
            "cluster_id", "block", F.lit(1).cast("long").alias("n"), *row_sums, F.col("inv_norm").alias("sum_inv")
        )
    )
    totals = materialize(_cluster_totals(units, space.blocks), "cluster-totals")
    by_cell = cell_labels.join(totals, ["cluster_id", "block"]).select("block", *CELL, *_CLUSTER)
    by_row = row_labels.join(totals, ["cluster_id", "block"]).select("path", *_CLUSTER)
    merged = space.rows.join(materialize(by_cell, "cell-labels"), ["block", *CELL], "left").join(
        materialize(by_row, "row-labels").withColumnsRenamed({c: f"row_{c}" for c in _CLUSTER}), "path", "left"
    )
    return merged.withColumns({c: F.coalesce(c, f"row_{c}") for c in _CLUSTER})


def cluster_sizes(near: DataFrame) -> DataFrame:
    return near.filter("cluster_id <> -1").groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
