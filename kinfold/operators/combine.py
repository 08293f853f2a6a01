"""Exact and near copies as one table, with the repository, unit and owner read from the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import labels, schemas
from kinfold.functions import text

# Path segments that name the repository, the business unit and the owner.
DIMENSIONS = {"depot": 0, "unit": 1, "owner": 2}


def path_dimensions(rows: DataFrame, positions: dict[str, int] = DIMENSIONS) -> DataFrame:
    return rows.withColumns({name: text.segment(F.col("path"), place) for name, place in positions.items()})


def _tagged(rows: DataFrame, dup_type: str, prefix: str, group: Column) -> DataFrame:
    return rows.select(
        "name_key",
        "path",
        "parent_dir",
        "size_bytes",
        "extension",
        F.lit(dup_type).alias("dup_type"),
        F.concat(F.lit(prefix), group.cast("string")).alias("group_key"),
    )


def combined_duplicates(
    exact: DataFrame, near: DataFrame, positions: dict[str, int] = DIMENSIONS
) -> DataFrame:
    """UNION ALL: an original that is also clustered appears once as each type."""
    copies = _tagged(exact.filter("is_exact_dup"), labels.EXACT, labels.EXACT_KEY, F.col("exact_group_id"))
    similar = _tagged(near.filter("cluster_id <> -1"), labels.NEAR, labels.NEAR_KEY, F.col("cluster_id"))
    return copies.unionByName(similar).transform(path_dimensions, positions).select(*schemas.COMBINED.names)
