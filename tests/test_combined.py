"""Combination, roll-ups, listings and reports on hand-made stage tables."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from kinfold import labels, schemas
from kinfold.operators import combine, listings, reports, rollups
from kinfold.operators.listings import Facets
from tests.makers import START, exact_rows

MB = 1048576


@pytest.fixture(scope="module")
def exact(spark):
    copy = {"is_exact_dup": True, "n_copies": 2, "exact_group_id": 0}
    return exact_rows(
        spark,
        [
            {"path": "/r1/u1/o1/B-1.TXT", "name_key": "b1", "size_bytes": MB, "copy_rank": 1, "dup_status": "Original", **copy},
            {"path": "/r2/u1/o2/x.txt", "name_key": "x", "size_bytes": MB, "copy_rank": 2, "dup_status": "Doublon #1", **copy},
            {"path": "/root.txt", "name_key": "root", "size_bytes": 3 * MB, "extension": ".md"},
            {"path": "/r1/u2/y.txt", "name_key": "y", "size_bytes": 7},
        ],
    )


@pytest.fixture(scope="module")
def near(spark, exact):
    rows = exact.filter("copy_rank = 1")
    clustered = F.col("path") != "/r1/u2/y.txt"
    return rows.select(
        "*",
        F.when(clustered, 3).otherwise(-1).cast("long").alias("cluster_id"),
        F.when(clustered, "Cluster #3").otherwise("Isolé").alias("cluster_status"),
        F.when(clustered, 2).otherwise(1).cast("long").alias("cluster_size"),
        F.when(clustered, 0.6435).alias("similarity"),
    )


@pytest.fixture(scope="module")
def combined(exact, near):
    return combine.combined_duplicates(exact, near)


def test_an_original_in_a_cluster_appears_twice(combined):
    rows = sorted((r.path, r.dup_type, r.group_key, r.depot, r.unit, r.owner) for r in combined.collect())
    assert rows == [
        ("/r1/u1/o1/B-1.TXT", "Exact", "EXACT_0", "r1", "u1", "o1"),
        ("/r1/u1/o1/B-1.TXT", "Quasi", "QUASI_3", "r1", "u1", "o1"),
        ("/r2/u1/o2/x.txt", "Exact", "EXACT_0", "r2", "u1", "o2"),
        ("/root.txt", "Quasi", "QUASI_3", "root.txt", "Inconnu", "Inconnu"),
    ]
    assert combined.schema.names == schemas.COMBINED.names


def test_positions_can_be_moved(exact, near):
    moved = combine.combined_duplicates(exact, near, {"depot": 1, "unit": 2, "owner": 0})
    row = moved.filter("path = '/r2/u1/o2/x.txt'").first()
    assert (row.depot, row.unit, row.owner) == ("u1", "o2", "r2")


def test_hotspots(combined):
    rows = [(r.rank, r.depot, r.unit, r.n_files, r.total_label) for r in rollups.hotspots(combined).collect()]
    assert rows == [
        (1, "root.txt", "Inconnu", 1, "3.0 MB"),
        (2, "r1", "u1", 2, "2.0 MB"),
        (3, "r2", "u1", 1, "1.0 MB"),
    ]
    assert [r.depot for r in rollups.hotspots(combined, kept=1).collect()] == ["root.txt"]
    listed = listings.hotspot_listing(rollups.hotspots(combined)).first()
    assert (listed["rank"], listed.n_files_label) == (1, "1")


def test_kpis(spark, combined):
    expected = [4.0, 2.0, 2.0, 2.0, 6.0, 3.0, 2.0]
    long = rollups.kpis(combined)
    assert [tuple(r) for r in long.collect()] == list(zip(labels.KPI_NAMES, expected))
    assert rollups.kpi_map(long).first().kpis == dict(zip(labels.KPI_NAMES, expected))
    empty = rollups.kpis(spark.createDataFrame([], schemas.COMBINED))
    assert [tuple(r) for r in empty.collect()] == [(name, 0.0) for name in labels.KPI_NAMES]


def test_one_pass_equals_the_four_breakdowns(combined):
    columns = ["n_files", "n_groups", "total_bytes", "n_exact", "n_near", "total_label"]
    one_pass = {(r.dimension, r.value): tuple(r[c] for c in columns) for r in rollups.breakdown_all(combined).collect()}
    single = {
        (name, r[name]): tuple(r[c] for c in columns)
        for name in rollups.BREAKDOWNS
        for r in rollups.breakdown(combined, name).collect()
    }
    assert one_pass == single
    assert single[("depot", "r1")] == (2, 2, 2 * MB, 1, 1, "2.0 MB")


def test_facets(combined):
    assert listings.facet_filter(combined, Facets()).count() == 4
    assert listings.facet_filter(combined, Facets(dup_type="Tous", depot="")).count() == 4
    assert listings.facet_filter(combined, Facets(depot="r1", unit="u1", dup_type="Exact")).count() == 1
    options = [tuple(r) for r in listings.facet_options(combined).collect()]
    assert options == [("depot", "r1"), ("depot", "r2"), ("depot", "root.txt"), ("unit", "Inconnu"), ("unit", "u1")]


def test_charts(combined):
    space = [(r.unit, r.mb) for r in listings.space_by_unit(combined).collect()]
    assert space == [("Inconnu", 3.0), ("u1", 3.0)]
    assert {r.depot: r.share for r in listings.space_share_by_depot(combined).collect()}["root.txt"] == 0.5
    assert [tuple(r) for r in listings.files_by_extension(combined, 1).collect()] == [(".txt", 3)]
    assert {(r.dup_type, r.label, r.share) for r in listings.rows_by_type(combined, "en").collect()} == {
        ("Exact", "Exact", 0.5),
        ("Quasi", "Near", 0.5),
    }


def test_search_modes(exact):
    assert [r.path for r in listings.search(exact, "B.*t").collect()] == ["/r1/u1/o1/B-1.TXT"]
    assert listings.search(exact, "b.*t", "literal").isEmpty()
    assert listings.search(exact, "").count() == 4
    with pytest.raises(ValueError):
        listings.search(exact, "a", "fuzzy")


def test_listings(exact, near):
    page = listings.exact_page(listings.exact_selection(exact, "r2")).collect()
    assert [tuple(r) for r in page] == [("Doublon #1", "x", "/r2/u1/o2/x.txt", "0.0 MB", "2024-01-01 00:00:00", 0, 2)]
    selection = listings.near_selection(near)
    assert [r.score for r in listings.near_page(selection).collect()] == ["0.643", "0.643"]
    first = listings.near_page(selection, rows=1).collect()
    rest = listings.near_page(selection, rows=5, after=(first[-1].cluster_id, first[-1].path)).collect()
    assert [r.path for r in first + rest] == [r.path for r in listings.near_lines(selection).orderBy("cluster_id", "path").collect()]
    assert tuple(listings.selection_count(selection).first()) == (2, "2")


def test_cards(spark, combined):
    shown = [(r.label, r.shown) for r in listings.kpi_cards(rollups.kpis(combined), "en").orderBy("card").collect()]
    assert shown == list(zip(labels.CARD_LABELS["en"], ["4", "2", "6", "3", "2"]))
    big = spark.createDataFrame([(labels.KPI_FILES, 1234567.0), (labels.KPI_DEPOTS, 4321.0)], schemas.KPIS)
    shown = [r.shown for r in listings.kpi_cards(big).orderBy("card").collect()]
    assert shown == ["1 234 567", "0", "0", "4,321", "0"]


def test_dashboard(combined):
    parts = listings.dashboard(combined, rollups.kpis(combined), rollups.hotspots(combined), Facets(depot="r2"))
    assert [r.unit for r in parts["space_by_unit"].collect()] == ["u1"]
    assert parts["hotspots"].count() == 3


def test_filter_descriptions():
    assert reports.describe_filters(None) == "Toutes les données"
    assert reports.describe_filters(Facets(dup_type="Tous"), "en") == "All data"
    assert reports.describe_filters(Facets("d", "u", "Exact")) == "Dépôt: d · Unité: u · Type: Exact"
    assert reports.describe_filters(Facets(unit="u"), "en") == "Unit: u"


def test_reports(spark, exact, near, tmp_path):
    long = exact.withColumns({"name_key": F.repeat(F.lit("n"), 50), "path": F.repeat(F.lit("p"), 80)})
    rows = reports.report_exact(long).collect()
    assert [(r.status, len(r.file_name), len(r.path), r.created) for r in rows] == [
        ("Original", 50, 80, "2024-01-01"),
        ("Doublon #1", 50, 80, "2024-01-01"),
    ]
    unscored = near.withColumn("similarity", F.lit(None).cast("double"))
    assert {r.score for r in reports.report_near(unscored).collect()} == {"—"}
    facets = Facets(depot="r2")
    # filters are described; they narrow the rows only on request
    assert reports.report_exact(exact, facets).count() == 2
    narrowed = reports.report_exact(exact, facets, apply_filters=True).collect()
    assert [(r.path, r.filters) for r in narrowed] == [("/r2/u1/o2/x.txt", "Dépôt: r2")]
    assert reports.report_near(near, Facets(dup_type="Exact"), apply_filters=True).isEmpty()
    target = str(tmp_path / "report")
    reports.write_report(reports.report_exact(exact), target)
    assert spark.read.option("header", True).csv(target).count() == 2


def test_stage_counts(exact, near, combined):
    counts = {r.counter: r.n for r in rollups.stage_counts(exact, exact, exact, near, combined).collect()}
    assert counts == {
        "indexed_files": 4,
        "valid_files": 4,
        "exact_duplicate_files": 2,
        "clustered_files": 2,
        "clusters": 1,
        "combined_files": 4,
    }


def test_dates_of_the_page_keep_the_time(spark):
    rows = exact_rows(spark, [{"is_exact_dup": True, "created_at": START + timedelta(hours=5)}])
    assert listings.exact_page(rows).first().created == "2024-01-01 05:00:00"
