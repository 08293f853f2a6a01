"""Report extracts: complete, sorted listings with whole texts; a page renderer may cut them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import labels
from kinfold.functions import text
from kinfold.operators.combine import DIMENSIONS, path_dimensions
from kinfold.operators.listings import Facets


def describe_filters(facets: Facets | None, language: str = "fr") -> str:
    parts = []
    if facets and facets.depot:
        parts.append(labels.DEPOT_FILTER[language] + facets.depot)
    if facets and facets.unit:
        parts.append(labels.UNIT_FILTER[language] + facets.unit)
    if facets and facets.type_selected():
        parts.append(labels.TYPE_FILTER[language] + facets.dup_type)
    return labels.FILTER_SEPARATOR.join(parts) or labels.ALL_DATA[language]


def _narrowed(rows: DataFrame, facets: Facets | None, dup_type: str, apply_filters: bool) -> DataFrame:
    """By default the filters are only described, as in the reports users know; they can also be applied."""
    if not (apply_filters and facets):
        return rows
    if facets.type_selected() and facets.dup_type != dup_type:
        return rows.limit(0)
    placed = path_dimensions(rows, {name: DIMENSIONS[name] for name in ("depot", "unit")})
    if facets.depot:
        placed = placed.filter(F.col("depot") == facets.depot)
    if facets.unit:
        placed = placed.filter(F.col("unit") == facets.unit)
    return placed.select(*rows.columns)


def _common(facets: Facets | None, language: str) -> list[Column]:
    return [
        F.col("name_key").alias("file_name"),
        F.col("path"),
        F.col("size_label"),
        F.lit(describe_filters(facets, language)).alias("filters"),
    ]


def report_exact(
    exact: DataFrame, facets: Facets | None = None, language: str = "fr", apply_filters: bool = False
) -> DataFrame:
    rows = _narrowed(exact.filter("is_exact_dup"), facets, labels.EXACT, apply_filters)
    name, path, size, filters = _common(facets, language)
    return rows.orderBy("exact_group_id", "copy_rank").select(
        F.col("dup_status").alias("status"),
        name,
        path,
        size,
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        filters,
    )


def report_near(
    near: DataFrame, facets: Facets | None = None, language: str = "fr", apply_filters: bool = False
) -> DataFrame:
    rows = _narrowed(near.filter("cluster_id <> -1"), facets, labels.NEAR, apply_filters)
    name, path, size, filters = _common(facets, language)
    return rows.orderBy("cluster_id", "path").select(
        F.col("cluster_status").alias("cluster"),
        name,
        path,
        size,
        text.score_label(F.col("similarity")).alias("score"),
        filters,
    )


def write_report(report: DataFrame, location: str, format: str = "csv") -> None:
    report.write.mode("overwrite").format(format).option("header", True).save(location)
