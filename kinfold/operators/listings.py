"""Interactive queries: facets, chart data, searchable listings, indicator cards.

Filters are plain predicates on the stage tables, so they reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import labels
from kinfold.functions import text


@dataclass(frozen=True)
class Facets:
    """Selected values; an empty one (or the type "Tous") filters nothing."""

    depot: str | None = None
    unit: str | None = None
    dup_type: str | None = None

    def type_selected(self) -> bool:
        return bool(self.dup_type) and self.dup_type != labels.ANY_TYPE


def facet_filter(combined: DataFrame, facets: Facets) -> DataFrame:
    if facets.depot:
        combined = combined.filter(F.col("depot") == facets.depot)
    if facets.unit:
        combined = combined.filter(F.col("unit") == facets.unit)
    if facets.type_selected():
        combined = combined.filter(F.col("dup_type") == facets.dup_type)
    return combined


def facet_options(combined: DataFrame) -> DataFrame:
    """Choices per facet, from the unfiltered rows."""
    options = [
        combined.select(F.lit(facet).alias("facet"), F.col(facet).alias("value")) for facet in ("depot", "unit")
    ]
    both = options[0].unionByName(options[1])
    return both.filter(F.col("value").isNotNull()).distinct().orderBy("facet", "value")


def space_by_unit(combined: DataFrame, shown: int = labels.UNITS_SHOWN) -> DataFrame:
    return (
        combined.groupBy("unit")
        .agg(F.sum("size_bytes").alias("total_bytes"))
        .orderBy(F.desc("total_bytes"), F.asc("unit"))
        .limit(shown)
        .withColumn("mb", F.col("total_bytes") / F.lit(1048576.0))
    )


def _with_share(grouped: DataFrame, measure: str) -> DataFrame:
    """Share of the whole. The number of groups has no bound, so the total is a scalar and not a global window."""
    total = grouped.agg(F.sum(measure).alias("total")).scalar()
    return grouped.withColumn("share", F.col(measure) / total)


def space_share_by_depot(combined: DataFrame) -> DataFrame:
    return _with_share(combined.groupBy("depot").agg(F.sum("size_bytes").alias("total_bytes")), "total_bytes")


def files_by_extension(combined: DataFrame, shown: int = labels.EXTENSIONS_SHOWN) -> DataFrame:
    return (
        combined.groupBy("extension")
        .agg(F.count("path").alias("n_files"))
        .orderBy(F.desc("n_files"), F.asc("extension"))
        .limit(shown)
    )


def rows_by_type(combined: DataFrame, language: str = "fr") -> DataFrame:
    legend = labels.TYPE_LEGEND[language]
    counts = combined.groupBy("dup_type").agg(F.count("*").alias("n_files"))
    label = F.when(F.col("dup_type") == labels.EXACT, legend[labels.EXACT]).when(
        F.col("dup_type") == labels.NEAR, legend[labels.NEAR]
    )
    return _with_share(counts, "n_files").withColumn("label", label)


def hotspot_listing(hotspots: DataFrame, shown: int = labels.HOTSPOTS_KEPT) -> DataFrame:
    return hotspots.filter(F.col("rank") <= shown).select(
        "rank", "depot", "unit", text.spaced_thousands(F.col("n_files")).alias("n_files_label"), "total_label"
    ).orderBy("rank")


def search(rows: DataFrame, term: str | None, mode: str = "regex") -> DataFrame:
    """Rows whose name or path contains the lower-cased term, a regular expression or a literal."""
    if not term:
        return rows
    if mode not in ("regex", "literal"):
        raise ValueError(f"unknown search mode: {mode}")

    def hit(column: str) -> Column:
        value = F.lower(column)
        return value.rlike(term.lower()) if mode == "regex" else value.contains(term.lower())

    return rows.filter(hit("name_key") | hit("path"))


def _selection(rows: DataFrame, depot: str | None, term: str | None, mode: str) -> DataFrame:
    """The repository is looked for anywhere in the path, literally."""
    if depot:
        rows = rows.filter(F.col("path").contains(depot))
    return search(rows, term, mode)


def exact_selection(exact: DataFrame, depot=None, term=None, mode: str = "regex") -> DataFrame:
    return _selection(exact.filter("is_exact_dup"), depot, term, mode)


def near_selection(near: DataFrame, depot=None, term=None, mode: str = "regex") -> DataFrame:
    return _selection(near.filter("cluster_id <> -1"), depot, term, mode)


EXACT_ORDER = ["exact_group_id", "copy_rank"]
NEAR_ORDER = ["cluster_id", "path"]


def _page(selection: DataFrame, order: list[str], rows: int, after: tuple | None) -> DataFrame:
    """The next ``rows`` rows behind the key ``after``: a filter, so far pages cost no more than the first."""
    if after is not None:
        first, second = (F.col(c) for c in order)
        selection = selection.filter((first > after[0]) | ((first == after[0]) & (second > after[1])))
    return selection.orderBy(*order).limit(rows)


def exact_lines(selection: DataFrame, *keys: str) -> DataFrame:
    """The whole selection as text cells, with the keys that order it and start the next page, and further ``keys``."""
    return selection.select(
        F.col("dup_status").alias("status"),
        F.col("name_key").alias("file"),
        F.col("path"),
        F.col("size_label").alias("size"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"),
        *EXACT_ORDER,
        *keys,
    )


def exact_page(selection: DataFrame, rows: int = labels.PAGE_ROWS, after: tuple[int, int] | None = None) -> DataFrame:
    """One page by group and rank; ``after`` is the (exact_group_id, copy_rank) of the last row seen."""
    return exact_lines(_page(selection, EXACT_ORDER, rows, after))


def near_lines(selection: DataFrame, *keys: str) -> DataFrame:
    return selection.select(
        F.col("cluster_status").alias("cluster"),
        F.col("name_key").alias("file"),
        F.col("path"),
        F.col("size_label").alias("size"),
        text.score_label(F.col("similarity")).alias("score"),
        "cluster_id",
        *keys,
    )


def near_page(selection: DataFrame, rows: int = labels.PAGE_ROWS, after: tuple[int, str] | None = None) -> DataFrame:
    """One page by cluster and path; ``after`` is the (cluster_id, path) of the last row seen."""
    return near_lines(_page(selection, NEAR_ORDER, rows, after))


def selection_count(selection: DataFrame) -> DataFrame:
    """Size of the whole selection, not of the page, also as shown."""
    counted = selection.agg(F.count("*").alias("n"))
    return counted.withColumn("shown", text.spaced_thousands(F.col("n")))


def kpi_cards(kpis: DataFrame, language: str = "fr") -> DataFrame:
    """Five formatted indicators; one that is missing shows as 0."""
    metrics = [labels.KPI_FILES, labels.KPI_GROUPS, labels.KPI_SPACE, labels.KPI_DEPOTS, labels.KPI_UNITS]
    cards = kpis.sparkSession.createDataFrame(
        [
            (place, label, metric, metric not in (labels.KPI_DEPOTS, labels.KPI_UNITS))
            for place, (label, metric) in enumerate(zip(labels.CARD_LABELS[language], metrics, strict=True), 1)
        ],
        "card long, label string, metric string, spaced boolean",
    )
    number = F.format_number(F.coalesce("value", F.lit(0.0)), 0)
    shown = F.when(F.col("spaced"), F.replace(number, F.lit(","), F.lit(" "))).otherwise(number)
    # Both sides are fixed lists: five cards, seven indicators.
    return cards.join(F.broadcast(kpis), "metric", "left").select("card", "label", shown.alias("shown"))


def dashboard(
    combined: DataFrame, kpis: DataFrame, hotspots: DataFrame, facets: Facets, language: str = "fr"
) -> dict[str, DataFrame]:
    """All charts for one selection. Cards and hot spots are never filtered."""
    rows = facet_filter(combined, facets)
    return {
        "facet_options": facet_options(combined),
        "space_by_unit": space_by_unit(rows),
        "space_share_by_depot": space_share_by_depot(rows),
        "files_by_extension": files_by_extension(rows),
        "rows_by_type": rows_by_type(rows, language),
        "hotspots": hotspot_listing(hotspots),
        "kpi_cards": kpi_cards(kpis, language),
    }

