"""Indexed search against the scan of all rows."""

import random

import pyarrow.parquet as pq
import pytest

from kinfold.operators import listings, path_index
from kinfold.sources.scratch import new_location
from tests.makers import cleaned_rows


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    words = ["Report", "invoice", "été", "src", "b-1", "a+b", "x.y", "日本語", "tmp", "AB", "q"]
    table = []
    for i in range(900):
        path = "/" + "/".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + f"/file{i}"
        table.append({"path": path, "name_key": rng.choice([f"rapport{i}v1", "ab", "", f"Z{i}"])})
    return cleaned_rows(spark, table)


@pytest.fixture(scope="module")
def index(spark, rows):
    location = new_location(spark, "index")
    path_index.build(rows, location, part_rows=50, chunk=32)
    return location


TERMS = [
    "report", "REPORT", "src/tmp", "file77", "rapport12v1", "été", "日本語", "ab", "q", "nowhere", "x.y", "a+b", "", "z1", "file1.*",
    "src.*tmp", "(report|invoice)", "rep(ort)+/", "file[0-9]{3}$", "^/src", "x\\.y", "a\\+b", "report/?src", "rapport\\d+v1", "(?i)tmp",
    "/b-1/.{0,3}tmp", "été|src", "fi(le)?8", "(src/){2}", "[[a-b]]b/", "rapp.rt5",
]


@pytest.mark.parametrize("mode", ["regex", "literal"])
def test_finds_what_a_scan_finds(spark, rows, index, mode):
    for term in TERMS:
        if mode == "regex" and term == "[[a-b]]b/":
            assert not path_index.required_grams(term)
        want = sorted(r.path for r in listings.search(rows, term, mode).collect())
        got = path_index.indexed_search(spark, index, term, mode)
        assert got.columns == rows.columns
        assert sorted(r.path for r in got.collect()) == want, term


def rows_in(df):
    return sum(pq.ParquetFile(f.removeprefix("file://")).metadata.num_rows for f in df.inputFiles())


def test_reads_few_rows(spark, rows, index):
    everything = spark.read.parquet(f"{index}/rows")
    hits = path_index.candidates(spark, index, path_index.required_grams("file77"))
    parts = {r.row_no // 50 for r in hits.collect()}
    found = path_index.indexed_search(spark, index, "file77")
    assert rows_in(everything) == 900 and found.count() >= 1
    assert len(parts) <= 12 and 50 * len(parts) < 900
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan and "PartitionFilters: [" in plan


def test_no_list_is_longer_than_a_chunk(spark, index):
    postings = spark.read.parquet(f"{index}/postings")
    assert max(r.n for r in postings.collect()) <= 32
    assert postings.groupBy("gram", "field", "chunk").count().filter("count > 1").isEmpty()


def test_required_grams():
    need = path_index.required_grams
    assert need("abcd") == {"abc", "bcd"} and need("ABCD", "literal") == {"abc", "bcd"}
    assert need("ab.cde") == {"cde"} and need("abc|abd") == set() and need("(abc)+d") == {"abc"} and need("(abc)?def") == {"def"}
    assert need("a(?:bcd)") == set() and need("\\x41bcd") == set() and need("x\\.yz") == {"x.y", ".yz"} and need("[abc]defg") == {"def", "efg"}
    assert need("abc{2}") == set() or "abc" not in need("abc{0}") and need("(") == set()


def test_index_of_nothing(spark, rows):
    location = new_location(spark, "index")
    path_index.build(rows.limit(0), location)
    assert path_index.indexed_search(spark, location, "report").collect() == []
