"""File facts as inventory rows, from any table that has a path and a content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import labels, schemas
from kinfold.functions import text


def in_excluded(path: Column, exclusions: list[str] | None = None) -> Column:
    """Whether a directory of the path has an excluded token in its name. The file name is not tested."""
    tokens = exclusions or labels.EXCLUDED_DIRS
    parts = F.split(path, r"[/\\]")
    directories = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(directories, lambda name: reduce(Column.__or__, [name.contains(token) for token in tokens]))


def drop_excluded(files: DataFrame, exclusions: list[str] | None = None, relative: Column | None = None) -> DataFrame:
    """Drop files below a directory whose name contains an excluded token.

    ``relative`` is the path below the scanned root (default: ``path``), with ``/`` or ``\\`` between its parts.
    """
    return files.filter(~in_excluded(F.col("path") if relative is None else relative, exclusions))


def describe(files: DataFrame) -> DataFrame:
    """Name and suffix of ``path``, added to size, MD5 and dates, as the raw inventory schema."""
    named = files.withColumn("file_name", text.base_name(F.col("path")))
    if "seq" not in files.columns:
        named = named.withColumn("seq", F.lit(None))
    return named.withColumn("extension", text.suffix(F.col("file_name"))).select(
        *[F.col(field.name).cast(field.dataType).alias(field.name) for field in schemas.RAW]
    )
