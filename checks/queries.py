"""Every operator as a query over the given tables.

The inventory is derived from ``documents`` (see checks.fixture). Queries on later stages read the stage
tables of one pipeline run per session and data folder, as an interactive session does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import clean, combine, exact, features, grid, incremental, listings, near, pages, path_index, reports, rollups
from kinfold.operators.listings import Facets
from checks import fixture
from kinfold.plans.pipeline import read_counters, run_pipeline
from kinfold.sources import stages
from kinfold.sources.folder import scan_folder
from kinfold.sources.folder_source import read_folder
from kinfold.sources.inventory import describe, drop_excluded
from kinfold.sources.payloads import accepted_payloads, payload_inventory, payload_outcomes, rejected_payloads
from kinfold.sources.scratch import materialize, new_location

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = fixture.AS_OF
DENSITY = 5
WIDE_EPS = 3.5
STATE_BUCKETS = 16
FACETS = Facets(depot="src1", unit="en", dup_type="Quasi")
REPORT_FACETS = Facets(depot="src1", unit="en")
TERM = "SRC1[0-4]/.*/u[13]/"

_runs: dict[tuple[str, str], tuple[str, str]] = {}


def run_of(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        root, run_id = new_location(spark, "runs"), "base"
        run_pipeline(raw(spark, sf_dir), AS_OF, root, run_id)
        _runs[key] = (root, run_id)
    return _runs[key]


def stage(name: str) -> Query:
    return lambda spark, sf_dir: stages.read_stage(spark, *run_of(spark, sf_dir), name)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_excluded(fixture.inventory_raw(spark, sf_dir))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two uploads per name; some without a comma, with broken padding, or with foreign characters."""
    doc = F.col("doc_id")
    body = F.base64("text")
    noisy = F.concat(F.lit("!"), F.substring(body, 1, 10), F.lit(" \n-"), F.substr(body, F.lit(11)))
    data = F.when(doc % 11 == 4, "QUJD").when(doc % 13 == 5, noisy).when(doc % 17 == 6, "YQ").otherwise(body)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        doc.alias("upload_seq"),
        F.concat("source", F.lit("\\"), F.when(doc % 19 < 2, "node_modules").otherwise(F.col("lang")), F.lit("/f"), F.floor(doc / 2).cast("string"), F.lit(".txt")).alias(
            "name"
        ),
        F.concat(F.lit("data:text/plain;base64"), F.when(doc % 7 == 3, ";").otherwise(","), data).alias("data_uri"),
    )


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.candidates(stage("exact")(spark, sf_dir))


def _scaled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, features.Scaling]:
    blocks = features.block_stats(_candidates(spark, sf_dir))
    return blocks, features.scaling(blocks)


def near_category_stats(spark, sf_dir):
    blocks, scale = _scaled(spark, sf_dir)
    return features.category_stats(blocks, scale.rows).select(
        "feature", "value", "n", *[F.round(c, 9).alias(c) for c in ("p", "penalty", "norm")]
    )


def near_features(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    values = zip(features.NUMBERS, features.numbers(rows), strict=True)
    return rows.select("path", *features.CATEGORIES, *[value.alias(name) for name, value in values])


def near_zscores(spark, sf_dir):
    _, scale = _scaled(spark, sf_dir)
    rows = features.standardized(_candidates(spark, sf_dir), scale)
    return rows.select("path", *[F.round(z, 6).alias(z) for z in features.Z])


def near_cell_links(spark, sf_dir):
    space = near.build_grid(_candidates(spark, sf_dir))
    named = space.cells.join(space.blocks.select("block", *features.CATEGORIES), "block")
    links = near.linked_cells(space)
    columns = [*features.CATEGORIES, *grid.CELL]
    for side in "ab":
        links = links.join(named.select(F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns]), f"{side}_id")
    return links.select(*[f"{side}_{c}" for side in "ab" for c in columns])


def near_min5(spark, sf_dir):
    rows = near.near_duplicates(stage("exact")(spark, sf_dir), min_samples=DENSITY)
    return rows.select("path", "cluster_id", "cluster_size", "similarity")


def near_wide_eps(spark, sf_dir):
    rows = near.near_duplicates(stage("exact")(spark, sf_dir), eps=WIDE_EPS)
    return rows.select("path", "cluster_id", "cluster_size", "similarity")


def exact_rank(spark, sf_dir):
    cleaned = stage("cleaned")(spark, sf_dir)
    return exact.rank_copies(cleaned, exact.numbered_groups(cleaned)).select("path", "copy_rank")


def exact_group_ids(spark, sf_dir):
    groups = exact.numbered_groups(stage("cleaned")(spark, sf_dir))
    return groups.select(*exact.KEYS, "n_copies", "exact_group_id")


def scan_inventory(spark, sf_dir):
    return scan_folder(spark, sf_dir).select("file_name", "size_bytes", "extension", "content_md5")


def scan_source(spark, sf_dir):
    """The folder by the data source; the same files as ``scan_inventory``."""
    return read_folder(spark, sf_dir).select("file_name", "size_bytes", "extension", "content_md5")


def exact_next_scan(spark, sf_dir):
    """The state of an earlier scan, brought up to date with this one."""
    location = new_location(spark, "exact-state")
    before = clean.clean_inventory(drop_excluded(fixture.inventory_before(spark, sf_dir)), AS_OF)
    incremental.start(materialize(before, "earlier-scan"), location, STATE_BUCKETS)
    incremental.update(stage("cleaned")(spark, sf_dir), location)
    return incremental.exact_rows(spark, location, AS_OF)


def _indexed(rows: DataFrame, term: str, mode: str) -> DataFrame:
    location = new_location(rows.sparkSession, "path-index")
    path_index.build(rows, location)
    return path_index.indexed_search(rows.sparkSession, location, term, mode).select("path", "name_key")


def _paged(rows: DataFrame, order: list[str]) -> DataFrame:
    location = new_location(rows.sparkSession, "pages")
    pages.store(rows, order, location)
    return pages.stored(rows.sparkSession, location, rows.schema)


def exact_numbered_page(spark, sf_dir):
    """The fourth page of 25 rows of all exact copies."""
    rows = listings.exact_selection(stage("exact")(spark, sf_dir))
    found = pages.page(_paged(rows, listings.EXACT_ORDER), 3, 25)
    return listings.exact_lines(found, pages.POSITION)


def near_selected_page(spark, sf_dir):
    """40 rows of one repository, from row 30 of all clustered files on."""
    table = _paged(listings.near_selection(stage("near")(spark, sf_dir)), listings.NEAR_ORDER)
    found = pages.page_from(table, 30, lambda rows: listings.near_selection(rows, "src1"), 40)
    return listings.near_lines(found, pages.POSITION)


def run_history(spark, sf_dir):
    """Three writes of two runs; the third replaces the first."""
    root = new_location(spark, "history")
    hotspots = stage("hotspots")(spark, sf_dir)
    for run_id, rows in (("monday", hotspots.filter("rank > 1")), ("tuesday", hotspots), ("monday", hotspots)):
        stages.write_run_rows(rows, root, run_id, "hotspots")
    return stages.read_runs(spark, root, "hotspots")


def near_single(spark, sf_dir):
    """The one largest file alone: nothing to cluster."""
    largest = stage("exact")(spark, sf_dir).filter("dup_status IN ('Unique', 'Original')").orderBy(F.desc("size_bytes"), "path").limit(1)
    return near.near_duplicates(largest).select("path", "cluster_id", "cluster_status", "cluster_size", "similarity")


def _cells(spark, sf_dir) -> DataFrame:
    return materialize(rollups.group_cells(stage("combined")(spark, sf_dir)), "group-cells")


def approximate_groups(spark, sf_dir):
    """The sketches' estimates beside the exact numbers of groups: are they within 2 %?"""
    cells = _cells(spark, sf_dir)
    close = rollups.approximate_groups(cells, "unit").select(F.col("unit").alias("_unit"), F.col("n_groups").alias("estimate"))
    both = rollups.cell_breakdown(cells, "unit").join(close, F.col("unit").eqNullSafe(F.col("_unit")))
    within = F.abs(F.col("estimate") - F.col("n_groups")) <= 0.02 * F.col("n_groups")
    return both.select("unit", "n_groups", within.alias("within_bound"))


def stage_roundtrip(spark, sf_dir):
    root, run_id = run_of(spark, sf_dir)
    if not stages.has_results(spark, root, run_id):
        raise RuntimeError("the run has no results")
    return stages.read_run(spark, root, run_id)["cleaned"]


def _stage_query(operator: Callable[[DataFrame], DataFrame], name: str) -> Query:
    return lambda spark, sf_dir: operator(stage(name)(spark, sf_dir))


def _raw_query(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(raw(spark, sf_dir))


def _on_combined(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _stage_query(operator, "combined")


def _pathed(*steps: Callable[[DataFrame], DataFrame], columns: list[str]) -> Query:
    def query(spark, sf_dir):
        rows = raw(spark, sf_dir)
        for step in steps:
            rows = rows.transform(step)
        return rows.select(*columns)

    return query


def _listing_counts(spark, sf_dir):
    exact_rows = listings.exact_selection(stage("exact")(spark, sf_dir), "src1", TERM)
    near_rows = listings.near_selection(stage("near")(spark, sf_dir), "src1", TERM)
    return (
        listings.selection_count(exact_rows)
        .withColumn("listing", F.lit("exact"))
        .unionByName(listings.selection_count(near_rows).withColumn("listing", F.lit("near")))
    )


def _stage_counts(spark, sf_dir):
    names = ("raw", "cleaned", "exact", "near", "combined")
    return rollups.stage_counts(*[stage(name)(spark, sf_dir) for name in names])


def all_queries() -> dict[str, Query]:
    return {
        # sources and sinks
        "scan_inventory": scan_inventory,
        "scan_source": scan_source,
        "scan_exclusions": _pathed(columns=["seq", "path"]),
        "scan_metadata": lambda spark, sf_dir: describe(
            fixture.document_files(spark, sf_dir).withColumn("content_md5", F.md5("text"))
        ).drop("seq"),
        "content_md5": lambda spark, sf_dir: fixture.document_files(spark, sf_dir).select(
            "doc_id", F.md5("text").alias("content_md5")
        ),
        "payload_inventory": lambda spark, sf_dir: payload_inventory(payloads(spark, sf_dir), AS_OF),
        "payload_accepted": lambda spark, sf_dir: accepted_payloads(payload_outcomes(payloads(spark, sf_dir)), AS_OF),
        "payload_rejects": lambda spark, sf_dir: rejected_payloads(payload_outcomes(payloads(spark, sf_dir))),
        "stage_roundtrip": stage_roundtrip,
        "kpi_long": _on_combined(rollups.kpis),
        "report_exact": _stage_query(lambda df: reports.report_exact(df, REPORT_FACETS), "exact"),
        "report_near": _stage_query(lambda df: reports.report_near(df, REPORT_FACETS, "en"), "near"),
        "report_exact_filtered": _stage_query(
            lambda df: reports.report_exact(df, REPORT_FACETS, apply_filters=True), "exact"
        ),
        "report_near_filtered": _stage_query(
            lambda df: reports.report_near(df, REPORT_FACETS, apply_filters=True), "near"
        ),
        # cleaning
        "clean_required": _pathed(clean.require_fields, columns=["seq", "path", "extension", "content_md5"]),
        "clean_names": _pathed(clean.normalize_names, columns=["seq", "file_name", "extension"]),
        "clean_paths": _pathed(clean.normalize_paths, columns=["seq", "path"]),
        "clean_dates": _pathed(clean.parse_dates, columns=["seq", "created_at", "modified_at"]),
        "clean_distinct_path": _pathed(clean.normalize_paths, clean.first_per_path, columns=["seq", "path"]),
        "clean_name_key": _pathed(clean.normalize_names, clean.key_names, columns=["seq", "name_key"]),
        "derive_dir": _pathed(
            clean.normalize_paths, clean.derive_dirs, columns=["seq", "path", "parent_dir", "dir_depth"]
        ),
        "derive_size_class": _pathed(clean.derive_size_class, columns=["seq", "size_bytes", "size_class"]),
        "derive_age": _pathed(
            clean.parse_dates, lambda df: clean.derive_ages(df, AS_OF), columns=["seq", "age_days", "idle_days"]
        ),
        "derive_size_label": _pathed(clean.derive_size_label, columns=["seq", "size_bytes", "size_label"]),
        "clean_inventory": _raw_query(lambda df: clean.clean_inventory(df, AS_OF)),
        # exact copies
        "exact_group_counts": _stage_query(exact.group_counts, "cleaned"),
        "exact_flags": _stage_query(
            lambda df: exact.exact_duplicates(df).select("path", "n_copies", "is_exact_dup"), "cleaned"
        ),
        "exact_rank": exact_rank,
        "exact_group_ids": exact_group_ids,
        "exact_status": _stage_query(
            lambda df: exact.exact_duplicates(df).select("path", "copy_rank", "exact_group_id", "dup_status"), "cleaned"
        ),
        "exact_duplicates": _stage_query(exact.exact_duplicates, "cleaned"),
        "exact_next_scan": exact_next_scan,
        # near copies
        "near_candidates": _stage_query(lambda df: features.candidates(df).select("path", "dup_status"), "exact"),
        "near_category_stats": near_category_stats,
        "near_features": near_features,
        "near_zscores": near_zscores,
        "near_cell_links": near_cell_links,
        "near_clusters": _stage_query(lambda df: df.select("path", "cluster_id", "cluster_status"), "near"),
        "near_cluster_sizes": _stage_query(near.cluster_sizes, "near"),
        "near_similarity": _stage_query(lambda df: df.select("path", "similarity"), "near"),
        "near_duplicates": _stage_query(near.near_duplicates, "exact"),
        "near_min5": near_min5,
        "near_single": near_single,
        "near_wide_eps": near_wide_eps,
        # combination and roll-ups
        "combined_duplicates": lambda spark, sf_dir: combine.combined_duplicates(
            stage("exact")(spark, sf_dir), stage("near")(spark, sf_dir)
        ),
        "path_dimensions": _stage_query(
            lambda df: combine.path_dimensions(df).select("path", "depot", "unit", "owner"), "cleaned"
        ),
        "hotspots_top20": _on_combined(rollups.hotspots),
        "hotspots_all": stage("hotspots"),
        "kpis": _on_combined(rollups.kpis_wide),
        "breakdown_depot": _on_combined(lambda df: rollups.breakdown(df, "depot")),
        "breakdown_unit": _on_combined(lambda df: rollups.breakdown(df, "unit")),
        "breakdown_extension": _on_combined(lambda df: rollups.breakdown(df, "extension")),
        "breakdown_owner": _on_combined(lambda df: rollups.breakdown(df, "owner")),
        "breakdown_all": _on_combined(rollups.breakdown_all),
        "cell_breakdowns": lambda spark, sf_dir: rollups.cell_breakdowns(_cells(spark, sf_dir)),
        "cell_breakdown_selected": lambda spark, sf_dir: rollups.cell_breakdown(
            _cells(spark, sf_dir).filter("depot = 'src1' AND unit = 'en'"), "extension"
        ),
        "cell_kpis": lambda spark, sf_dir: rollups.cell_kpis(_cells(spark, sf_dir)),
        "approximate_groups": approximate_groups,
        "stage_counts": _stage_counts,
        "observed_counts": lambda spark, sf_dir: read_counters(spark, *run_of(spark, sf_dir)),
        # interactive queries
        "facet_filter": _on_combined(lambda df: listings.facet_filter(df, FACETS)),
        "facet_options": _on_combined(listings.facet_options),
        "space_by_unit_top10": _on_combined(listings.space_by_unit),
        "space_share_by_depot": _on_combined(listings.space_share_by_depot),
        "files_by_extension_top8": _on_combined(listings.files_by_extension),
        "rows_by_type": _on_combined(lambda df: listings.rows_by_type(df, "en")),
        "hotspot_listing": _stage_query(listings.hotspot_listing, "hotspots"),
        "exact_listing": _stage_query(
            lambda df: listings.exact_lines(listings.exact_selection(df, "src1")), "exact"
        ),
        "near_listing": _stage_query(lambda df: listings.near_lines(listings.near_selection(df, "src")), "near"),
        "exact_listing_page": _stage_query(
            lambda df: listings.exact_page(listings.exact_selection(df, "src1"), 10, after=(2, 1)), "exact"
        ),
        "near_listing_page": _stage_query(
            lambda df: listings.near_page(listings.near_selection(df, "src"), 100, after=(0, "/src1")), "near"
        ),
        "exact_numbered_page": exact_numbered_page,
        "near_selected_page": near_selected_page,
        "listing_counts": _listing_counts,
        "search_exact": _stage_query(
            lambda df: listings.search(df.filter("is_exact_dup"), TERM).select("path", "name_key"), "exact"
        ),
        "search_near": _stage_query(
            lambda df: listings.search(df.filter("cluster_id <> -1"), "7V1", "literal").select("path", "name_key"),
            "near",
        ),
        "search_exact_indexed": _stage_query(lambda df: _indexed(df.filter("is_exact_dup"), TERM, "regex"), "exact"),
        "search_near_indexed": _stage_query(
            lambda df: _indexed(df.filter("cluster_id <> -1"), "7V1", "literal"), "near"
        ),
        "run_history": run_history,
        "kpi_cards": _stage_query(listings.kpi_cards, "kpis"),
    }
