from kinfold import schemas
from kinfold.operators import clean
from tests.makers import raw_rows

AS_OF = "2025-01-01 00:00:00"


def test_required_fields_and_blank_extension(spark):
    rows = raw_rows(
        spark,
        {"path": "/ok"},
        *[{name: None, "extension": ".txt"} for name in clean._REQUIRED],
        {"path": "/n", "extension": None},
        {"path": "/b", "extension": " \t"},
    )
    assert [r.path for r in clean.require_fields(rows).collect()] == ["/ok"]


def test_dates(spark):
    good = ("2024-01-01 00:00:00", "2024-01-01 00:00:00")
    bad = [("2024-01-02 00:00:00", "2024-01-01 00:00:00"), ("2023-02-30 00:00:00", "2024-01-01 00:00:00")]
    rows = raw_rows(spark, *[{"created_at_raw": c, "modified_at_raw": m} for c, m in [good, *bad]])
    assert [r.seq for r in clean.parse_dates(rows).collect()] == [0]


def test_first_row_of_a_path_wins(spark):
    rows = raw_rows(
        spark,
        {"path": "C:\\a\\b.txt", "size_bytes": 1, "seq": 7},
        {"path": "C:/a/b.txt", "size_bytes": 2, "seq": 3},
        {"path": "C:/a/b.txt", "size_bytes": 3, "seq": None},
    )
    out = clean.clean_inventory(rows, AS_OF).collect()
    assert [(r.path, r.size_bytes) for r in out] == [("C:/a/b.txt", 2)]


def test_a_bad_row_does_not_hide_a_good_one_of_its_path(spark):
    rows = raw_rows(spark, {"created_at_raw": "never"}, {"size_bytes": 5})
    assert [r.size_bytes for r in clean.clean_inventory(rows, AS_OF).collect()] == [5]


def test_an_empty_name_still_hides_its_path(spark):
    # paths are made unique before nameless rows are dropped
    rows = raw_rows(spark, {"file_name": "___.txt", "path": "/x"}, {"file_name": "ok.txt", "path": "/x"})
    assert clean.clean_inventory(rows, AS_OF).collect() == []


def test_whole_stage(spark):
    rows = raw_rows(
        spark,
        {
            "file_name": " Été-1.V2.TXT\u3000",
            "path": "\\d\\e\\Été-1.V2.TXT",
            "extension": ".TXT ",
            "size_bytes": 131072,
            "created_at_raw": "2025-01-01 06:00:00",
            "modified_at_raw": "2025-01-03 00:00:00",
        },
    )
    out = clean.clean_inventory(rows, AS_OF)
    assert out.schema.names == schemas.CLEANED.names
    assert [f.dataType for f in out.schema] == [f.dataType for f in schemas.CLEANED]
    row = out.first()
    assert (row.name_key, row.path, row.parent_dir, row.dir_depth) == ("t1v2", "/d/e/Été-1.V2.TXT", "/d/e", 2)
    assert (row.size_label, row.size_class, row.extension) == ("0.12 MB", "Petit", ".txt")
    assert (row.age_days, row.idle_days) == (-1, -2)


def test_empty(spark):
    out = clean.clean_inventory(spark.createDataFrame([], schemas.RAW), AS_OF)
    assert out.schema.names == schemas.CLEANED.names and out.isEmpty()
