import os

import pytest
from pyspark.sql import functions as F

from checks import compare
from checks.oracle import all_sql
from checks.queries import all_queries, raw
from kinfold import labels, schemas
from kinfold.plans.pipeline import run_pipeline
from kinfold.sources import stages
from kinfold.sources.folder import scan_folder

SF = "/root/testdata/sf0.001"
AS_OF = "2025-01-01 00:00:00"

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
# Clustering queries run for a while each; they are compared with brute force in test_near. The scan SQL reads sf0.01.
SLOW = {"near_duplicates", "near_min5", "near_wide_eps", "near_cell_links"}
#: Their SQL names the files of another data folder than the one of the tests.
OTHER_FOLDER = {"scan_inventory", "scan_source"}


@needs_data
def test_fixture_counts(spark):
    rows = raw(spark, SF)
    assert rows.count() == 202


@needs_data
@pytest.mark.parametrize("key", [key for key in all_sql() if key not in SLOW | OTHER_FOLDER])
def test_query_equals_sql(spark, key):
    assert compare.compare(spark, compare.duck(SF), SF, key) is None


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


def test_empty_inventory(spark, tmp_path):
    root = str(tmp_path)
    out = run_pipeline(spark.createDataFrame([], schemas.RAW), AS_OF, root, "empty")
    for stage, schema in schemas.STAGES.items():
        assert out[stage].schema.names == schema.names
        assert out[stage].count() == (7 if stage == "kpis" else 0)
    assert {r.value for r in out["kpis"].collect()} == {0.0}
    assert stages.has_results(spark, root, "empty")


def test_folder_to_indicators(spark, tmp_path):
    """A real folder with one pair of copies, scanned and analysed."""
    root = tmp_path / "files"
    for name, content in {"a/x/1.txt": "same", "b/y/2.txt": "same", "b/y/3.md": "other"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    # a change of the inode's data after the modification time makes the creation time the later one
    inventory = scan_folder(spark, str(root)).withColumn("created_at_raw", F.col("modified_at_raw"))
    run_pipeline(inventory, AS_OF, str(tmp_path / "runs"), "r")
    run = stages.read_run(spark, str(tmp_path / "runs"), "r")
    assert sorted(r.dup_status for r in run["exact"].collect()) == ["Doublon #1", "Original", "Unique"]
    values = {r.metric: r.value for r in run["kpis"].collect()}
    assert values[labels.KPI_EXACT] == 2.0
    assert run["hotspots"].schema.names == schemas.HOTSPOTS.names
