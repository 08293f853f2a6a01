"""Small inputs for the stage operators."""

from __future__ import annotations

from datetime import datetime, timedelta

from kinfold import schemas

START = datetime(2024, 1, 1)


def raw_rows(spark, *rows: dict):
    base = {
        "seq": 0,
        "file_name": "a.txt",
        "path": "/d/a.txt",
        "size_bytes": 10,
        "extension": ".txt",
        "content_md5": "h",
        "created_at_raw": "2024-01-01 00:00:00",
        "modified_at_raw": "2024-01-02 00:00:00",
    }
    table = [tuple({**base, "seq": i, **row}[name] for name in schemas.RAW.names) for i, row in enumerate(rows)]
    return spark.createDataFrame(table, schemas.RAW)


def cleaned_rows(spark, rows: list[dict]):
    def full(i, row):
        path = row.get("path", f"/repo/unit/file{i:05d}.txt")
        values = {
            "name_key": f"file{i}",
            "path": path,
            "parent_dir": path.rsplit("/", 1)[0],
            "dir_depth": 2,
            "size_bytes": 100,
            "size_label": "0.0 MB",
            "size_class": "Petit",
            "extension": ".txt",
            "content_md5": f"h{i}",
            "created_at": START,
            "modified_at": START + timedelta(days=1),
            "age_days": 100,
            "idle_days": 50,
        }
        return tuple({**values, **row, "path": path}[name] for name in schemas.CLEANED.names)

    return spark.createDataFrame([full(i, row) for i, row in enumerate(rows)], schemas.CLEANED)


def exact_rows(spark, rows: list[dict]):
    """Cleaned rows as if they had passed the exact stage; unique unless told otherwise."""
    extra = {"n_copies": 1, "is_exact_dup": False, "copy_rank": 1, "exact_group_id": -1, "dup_status": "Unique"}
    base = cleaned_rows(spark, [{k: v for k, v in r.items() if k not in extra} for r in rows]).collect()
    table = [tuple(b) + tuple({**extra, **r}[k] for k in extra) for b, r in zip(base, rows, strict=True)]
    return spark.createDataFrame(table, schemas.EXACT)
