"""Exact copies: files with equal content hash and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold import labels, schemas
from kinfold.operators.numbering import number_rows
from kinfold.sources.scratch import materialize

KEYS = ["content_md5", "size_bytes"]


def group_counts(cleaned: DataFrame) -> DataFrame:
    """Files per key; partial aggregation makes a hot key one row per map task."""
    return cleaned.groupBy(*KEYS).agg(F.count("*").alias("n_copies"))


def shared_keys(cleaned: DataFrame) -> DataFrame:
    """Keys of more than one file; a file without a hash has no copies."""
    return group_counts(cleaned).na.drop(subset=KEYS).filter("n_copies > 1")


def numbered_groups(cleaned: DataFrame) -> DataFrame:
    """Shared keys in order: ``exact_group_id`` from 0 and ``_start``, the number of copies in earlier groups."""
    return number_rows(shared_keys(cleaned), KEYS, "exact_group_id", running_sum=("n_copies", "_start"))


def number_copies(copies: DataFrame) -> DataFrame:
    """Rows of shared keys with their rank by creation date (then path) in the group.

    All copies are numbered in one global order and the group's start is subtracted. No task ever holds a whole
    group, so a group may be as large as a third of the table.
    """
    placed = number_rows(copies, ["exact_group_id", "created_at", "path"], "_place_in_all")
    return placed.withColumn("copy_rank", F.col("_place_in_all") - F.col("_start") + 1)


def rank_copies(cleaned: DataFrame, groups: DataFrame) -> DataFrame:
    return number_copies(cleaned.join(groups, KEYS))


def with_status(rows: DataFrame) -> DataFrame:
    status = (
        F.when(~F.col("is_exact_dup"), labels.UNIQUE)
        .when(F.col("copy_rank") == 1, labels.ORIGINAL)
        .otherwise(F.concat(F.lit(labels.COPY_PREFIX), (F.col("copy_rank") - 1).cast("string")))
    )
    return rows.withColumn("dup_status", status)


def exact_duplicates(cleaned: DataFrame) -> DataFrame:
    """Every row with group size, rank, group number and status; only rows with a shared key are ranked.

    The groups are a table of their own, so the one join with them is broadcast if they are few, and otherwise Spark
    can split the rows of a hot key. The joined rows are written once and split into copies and single files.
    """
    groups = materialize(numbered_groups(cleaned).select(*KEYS, "n_copies", "exact_group_id", "_start"), "groups")
    joined = materialize(cleaned.join(groups, KEYS, "left"), "grouped-rows")
    copies = number_copies(joined.filter("exact_group_id IS NOT NULL")).withColumn("is_exact_dup", F.lit(True))
    single = joined.filter("exact_group_id IS NULL").withColumns(
        {
            "n_copies": F.lit(1),
            "is_exact_dup": F.lit(False),
            "copy_rank": F.lit(1),
            "exact_group_id": F.lit(-1),
        }
    )
    rows = [
        with_status(part).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.EXACT])
        for part in (single, copies)
    ]
    return rows[0].unionByName(rows[1])
