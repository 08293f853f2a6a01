"""Aggregations of the combined duplicates: hot spots, breakdowns, indicators, stage counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold import labels, schemas
from kinfold.functions import text
from kinfold.operators.numbering import number_rows

BREAKDOWNS = ["depot", "unit", "extension", "owner"]


def _is(dup_type: str) -> Column:
    return F.col("dup_type") == dup_type


def all_hotspots(combined: DataFrame) -> DataFrame:
    """All (repository, unit) pairs by bytes, ranked without a window over all of them."""
    groups = combined.groupBy("depot", "unit").agg(
        F.count("path").alias("n_files"), F.sum("size_bytes").alias("total_bytes")
    )
    placed = number_rows(groups.withColumn("_less", -F.col("total_bytes")), ["_less", "depot", "unit"], "_place")
    return (
        placed.withColumn("rank", F.col("_place") + 1)
        .withColumn("total_label", text.size_label(F.col("total_bytes")))
        .select(*schemas.HOTSPOTS.names)
    )


def hotspots(combined: DataFrame, kept: int = labels.HOTSPOTS_KEPT) -> DataFrame:
    """The ``kept`` pairs with the most bytes. The limit comes first, so the rank sees ``kept`` rows."""
    order = [F.desc("total_bytes"), F.asc("depot"), F.asc("unit")]
    top = (
        combined.groupBy("depot", "unit")
        .agg(F.count("path").alias("n_files"), F.sum("size_bytes").alias("total_bytes"))
        .orderBy(*order)
        .limit(kept)
    )
    return (
        top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
        .withColumn("total_label", text.size_label(F.col("total_bytes")))
        .select(*schemas.HOTSPOTS.names)
    )


def _measures() -> list[Column]:
    return [
        F.count("path").alias("n_files"),
        F.count_distinct("group_key").alias("n_groups"),
        F.sum("size_bytes").alias("total_bytes"),
        F.count_if(_is(labels.EXACT)).alias("n_exact"),
        F.count_if(_is(labels.NEAR)).alias("n_near"),
    ]


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("total_label", text.size_label(F.col("total_bytes")))


def breakdown(combined: DataFrame, dimension: str) -> DataFrame:
    """Files, groups, bytes and types per value of one dimension, largest first."""
    return (
        combined.groupBy(dimension)
        .agg(*_measures())
        .transform(_labelled)
        .orderBy(F.desc("total_bytes"), F.asc(dimension))
    )


def breakdown_all(combined: DataFrame) -> DataFrame:
    """All four breakdowns in one pass, as (dimension, value, measures).

    Files of one group below one owner are summed first, so the four-fold expansion meets fewer rows.
    """
    sums = ["n_files", "total_bytes", "n_exact", "n_near"]
    merged = combined.groupBy(*BREAKDOWNS, "group_key").agg(
        F.count("path").alias("n_files"),
        F.sum("size_bytes").alias("total_bytes"),
        F.count_if(_is(labels.EXACT)).alias("n_exact"),
        F.count_if(_is(labels.NEAR)).alias("n_near"),
    )
    grouped = merged.groupingSets([[name] for name in BREAKDOWNS], *BREAKDOWNS).agg(
        F.grouping_id().alias("_set"),
        F.count_distinct("group_key").alias("n_groups"),
        *[F.sum(name).cast("long").alias(name) for name in sums],
    )
    # Bit k of the grouping id is 0 for the column that is grouped by; the first column has the highest bit.
    full = 2 ** len(BREAKDOWNS) - 1
    bits = {full - 2 ** (len(BREAKDOWNS) - 1 - i): name for i, name in enumerate(BREAKDOWNS)}
    dimension = reduce(lambda c, bit: c.when(F.col("_set") == bit, bits[bit]), bits, F)
    value = reduce(lambda c, bit: c.when(F.col("_set") == bit, F.col(bits[bit])), bits, F)
    return (
        grouped.withColumns({"dimension": dimension, "value": value})
        .transform(_labelled)
        .select("dimension", "value", "n_files", "n_groups", "total_bytes", "n_exact", "n_near", "total_label")
    )


def kpis_wide(combined: DataFrame) -> DataFrame:
    """The seven indicators as one row; all 0 without duplicates.

    Files of one group in one place are summed first, so the distinct counts expand grouped rows only.
    """
    combined = combined.groupBy("group_key", "depot", "unit").agg(
        F.count("*").alias("n_files"),
        F.count_if(_is(labels.EXACT)).alias("n_exact"),
        F.count_if(_is(labels.NEAR)).alias("n_near"),
        F.sum("size_bytes").alias("size_bytes"),
    )
    values = [
        F.coalesce(F.sum("n_files"), F.lit(0)),
        F.count_distinct("group_key"),
        F.coalesce(F.sum("n_exact"), F.lit(0)),
        F.coalesce(F.sum("n_near"), F.lit(0)),
        F.coalesce(text.megabytes(F.sum("size_bytes")), F.lit(0)),
        F.count_distinct("depot"),
        F.count_distinct("unit"),
    ]
    return combined.agg(
        *[value.cast("double").alias(name) for value, name in zip(values, labels.KPI_NAMES, strict=True)]
    )


def kpis_long(wide: DataFrame) -> DataFrame:
    return wide.unpivot([], labels.KPI_NAMES, "metric", "value")


def kpi_map(long: DataFrame) -> DataFrame:
    """The long table (seven rows) as one map."""
    return long.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("kpis"))


def kpis(combined: DataFrame) -> DataFrame:
    return kpis_long(kpis_wide(combined))


def stage_counts(raw: DataFrame, cleaned: DataFrame, exact: DataFrame, near: DataFrame, combined: DataFrame):
    """Rows each stage reports when it is done."""

    def counter(df: DataFrame, name: str, value: Column | None = None) -> DataFrame:
        return df.agg((F.count("*") if value is None else value).alias("n")).select(
            F.lit(name).alias("counter"), "n"
        )

    in_cluster = F.col("cluster_id") != -1
    return reduce(
        DataFrame.unionByName,
        [
            counter(raw, "indexed_files"),
            counter(cleaned, "valid_files"),
            counter(exact, "exact_duplicate_files", F.count_if("is_exact_dup")),
            counter(near, "clustered_files", F.count_if(in_cluster)),
            counter(near, "clusters", F.count_distinct(F.when(in_cluster, F.col("cluster_id")))),
            counter(combined, "combined_files"),
        ],
    )


_CELL_SUMS = ["n_files", "total_bytes", "n_exact", "n_near"]
SKETCH_BITS = 14


def group_cells(combined: DataFrame) -> DataFrame:
    """Measures by (depot, unit, extension, owner) and range of group numbers, with the set of groups as a bitmap and as a
    sketch. Cells of any selection can be merged, so this small table serves every breakdown of it.

    Group numbers are dense, so a bitmap of 32,768 of them is well filled where a cell has many groups.
    """
    prefix = F.when(_is(labels.EXACT), labels.EXACT_KEY).otherwise(labels.NEAR_KEY)
    number = F.replace("group_key", prefix, F.lit("")).cast("long") * 2 + F.when(_is(labels.EXACT), 0).otherwise(1)
    rows = combined.withColumn("_group", number)
    return rows.groupBy(*BREAKDOWNS, F.bitmap_bucket_number("_group").alias("bucket")).agg(
        F.count("path").alias("n_files"),
        F.sum("size_bytes").alias("total_bytes"),
        F.count_if(_is(labels.EXACT)).alias("n_exact"),
        F.count_if(_is(labels.NEAR)).alias("n_near"),
        F.bitmap_construct_agg(F.bitmap_bit_position("_group")).alias("groups"),
        F.hll_sketch_agg("_group", SKETCH_BITS).alias("sketch"),
    )


def _merged(cells: DataFrame, dimensions: list[str]) -> DataFrame:
    """Sums and the exact number of groups by any dimensions, by two aggregations and no row more than there are cells."""
    ranges = cells.groupBy(*dimensions, "bucket").agg(
        *[F.sum(c).alias(c) for c in _CELL_SUMS], F.bitmap_count(F.bitmap_or_agg("groups")).alias("n_groups")
    )
    return ranges.groupBy(*dimensions).agg(*[F.sum(c).cast("long").alias(c) for c in [*_CELL_SUMS, "n_groups"]])


def cell_breakdown(cells: DataFrame, dimension: str) -> DataFrame:
    """``breakdown`` of the files in some cells."""
    return _merged(cells, [dimension]).transform(_labelled).select(
        dimension, "n_files", "n_groups", "total_bytes", "n_exact", "n_near", "total_label"
    )


def cell_breakdowns(cells: DataFrame) -> DataFrame:
    """``breakdown_all`` of the files in some cells."""
    parts = [cell_breakdown(cells, name).withColumnRenamed(name, "value").withColumn("dimension", F.lit(name)) for name in BREAKDOWNS]
    columns = ["dimension", "value", "n_files", "n_groups", "total_bytes", "n_exact", "n_near", "total_label"]
    return reduce(DataFrame.unionByName, parts).select(*columns)


def cell_kpis(cells: DataFrame) -> DataFrame:
    """``kpis_wide`` of the files in some cells; places are counted where they are values already."""
    totals = _merged(cells, [])
    places = [cells.select(name).distinct().agg(F.count(name).alias(f"n_{name}")) for name in ("depot", "unit")]
    # One row each.
    row = totals.join(F.broadcast(places[0])).join(F.broadcast(places[1]))
    zero = F.lit(0)
    values = [
        F.coalesce("n_files", zero), F.coalesce("n_groups", zero), F.coalesce("n_exact", zero), F.coalesce("n_near", zero),
        F.coalesce(text.megabytes(F.col("total_bytes")), zero), F.col("n_depot"), F.col("n_unit"),
    ]
    return row.select(*[value.cast("double").alias(name) for value, name in zip(values, labels.KPI_NAMES, strict=True)])


def approximate_groups(cells: DataFrame, dimension: str) -> DataFrame:
    """The number of groups by value from sketches, within about 2 %; a sketch has a fixed size whatever the groups."""
    merged = cells.groupBy(dimension).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(dimension, F.hll_sketch_estimate("sketch").alias("n_groups"))
