"""Metadata cleaning and derived features. The order of the steps matters and is that of ``clean_inventory``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold import schemas
from kinfold.functions import dates, text

_REQUIRED = ["file_name", "path", "size_bytes", "content_md5", "created_at_raw", "modified_at_raw"]


def require_fields(raw: DataFrame) -> DataFrame:
    """Six fields must be there, and a non-blank extension."""
    return raw.na.drop(subset=[*_REQUIRED, "extension"]).filter(text.strip(F.col("extension")) != "")


def normalize_names(raw: DataFrame) -> DataFrame:
    return raw.withColumns({name: text.strip(F.lower(name)) for name in ("file_name", "extension")})


def normalize_paths(raw: DataFrame) -> DataFrame:
    return raw.withColumn("path", text.forward_slashes(F.col("path")))


def parse_dates(raw: DataFrame) -> DataFrame:
    """Rows need two readable dates, the creation not after the modification."""
    dated = raw.withColumns(
        {
            "created_at": dates.parsed(F.col("created_at_raw")),
            "modified_at": dates.parsed(F.col("modified_at_raw")),
        }
    )
    return dated.filter(F.col("created_at") <= F.col("modified_at"))


def first_per_path(rows: DataFrame) -> DataFrame:
    """First row of each path by ``seq``; the other columns only break ties.

    Spark limits each map task to one row per path before the shuffle, so a path repeated without end stays cheap.
    Paths share long prefixes; sorting by their hash first decides most comparisons on one number.
    """
    order = [F.asc_nulls_last(name) for name in ["seq", *(c for c in rows.columns if c not in ("seq", "path"))]]
    hashed = rows.withColumn("_hash", F.xxhash64("path"))
    numbered = hashed.withColumn("_n", F.row_number().over(Window.partitionBy("_hash", "path").orderBy(*order)))
    return numbered.filter("_n = 1").drop("_n", "_hash")


def key_names(rows: DataFrame) -> DataFrame:
    """Alphanumeric part of the name without its extension; rows without one are dropped."""
    key = text.alphanumeric(text.without_extension(F.col("file_name")))
    return rows.withColumn("name_key", key).filter(F.col("name_key") != "")


def derive_dirs(rows: DataFrame) -> DataFrame:
    directory = text.parent_dir(F.col("path"))
    return rows.withColumns({"parent_dir": directory, "dir_depth": text.depth(directory)})


def derive_size_class(rows: DataFrame) -> DataFrame:
    return rows.withColumn("size_class", text.size_class(F.col("size_bytes")))


def derive_ages(rows: DataFrame, as_of: str | datetime) -> DataFrame:
    now = dates.ntz(as_of)
    return rows.withColumns(
        {
            "age_days": dates.whole_days(now, F.col("created_at")),
            "idle_days": dates.whole_days(now, F.col("modified_at")),
        }
    )


def derive_size_label(rows: DataFrame) -> DataFrame:
    return rows.withColumn("size_label", text.size_label(F.col("size_bytes")))


def clean_inventory(raw: DataFrame, as_of: str | datetime) -> DataFrame:
    return (
        raw.transform(require_fields)
        .transform(normalize_names)
        .transform(normalize_paths)
        .transform(parse_dates)
        .transform(first_per_path)
        .transform(key_names)
        .transform(derive_dirs)
        .transform(derive_size_class)
        .transform(derive_ages, as_of)
        .transform(derive_size_label)
        .select(*schemas.CLEANED.names)
    )
