import hashlib
import os
import time

import pytest

from kinfold import schemas
from kinfold.sources import folder, folder_source


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "Windows root"
    for i in range(30):
        path = root / f"d{i % 3}" / ("x/y" if i % 2 else "") / f"f{i}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"%d" % (i % 7))
    for name in (".hidden", "empty.md", "d0/node_modules/gone.txt"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"")
    (root / "broken").symlink_to(root / "nowhere")
    (root / "again").symlink_to(root / "d1")
    return root


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("tasks", [1, 3, 64])
def test_equals_the_scan(spark, tree, tasks, monkeypatch):
    monkeypatch.setattr(folder_source, "MANY", 4)
    read = folder_source.read_folder(spark, str(tree), tasks=tasks)
    assert read.schema == folder.scan_folder(spark, str(tree)).schema
    assert rows(read) == rows(folder.scan_folder(spark, str(tree)))


def test_plan_covers_each_entry_once(tmp_path, monkeypatch):
    """A flat directory becomes shares; the driver keeps no names of it."""
    monkeypatch.setattr(folder_source, "MANY", 10)
    for i in range(100):
        (tmp_path / f"f{i}").write_bytes(b"")
    (tmp_path / "sub" / "below").mkdir(parents=True)
    (tmp_path / "sub" / "below" / "g").write_bytes(b"g")
    source = folder_source._Folder(str(tmp_path), ["none"], 8)
    parts = source.plan()
    assert len(parts) == 8 and {p.directory for p in parts} == {str(tmp_path)}
    found = [os.path.basename(r[0]) for p in parts for r in source.rows(p)]
    assert sorted(found) == sorted([f"f{i}" for i in range(100)] + ["g"])
    monkeypatch.setattr(folder_source, "MANY", 1000)
    assert [(p.directory, p.deep) for p in source.plan()] == [
        (str(tmp_path), False), (f"{tmp_path}/sub", False), (f"{tmp_path}/sub/below", False)
    ]


def test_options_and_errors(spark, tree, tmp_path):
    names = {r.file_name for r in folder_source.read_folder(spark, str(tree), exclusions="d1,d2").collect()}
    assert "gone.txt" in names and "f0.txt" in names and "f1.txt" not in names
    (tmp_path / "nothing").mkdir()
    empty = folder_source.read_folder(spark, str(tmp_path / "nothing"))
    assert empty.columns == schemas.RAW.names and empty.collect() == []
    for bad in (str(tmp_path / "missing"), str(tree / "empty.md")):
        with pytest.raises(Exception, match="FileNotFoundError"):
            folder_source.read_folder(spark, bad).collect()


def test_stream_gives_each_arrival_once(spark, tmp_path):
    root, out, marks = (str(tmp_path / name) for name in ("root", "out", "marks"))
    os.makedirs(root)

    def put(name, content):
        with open(f"{root}/{name}", "wb") as stream:
            stream.write(content)

    def step():
        time.sleep(2.5)
        files = folder_source.stream_folder(spark, root, lag=1)
        query = files.writeStream.format("parquet").option("checkpointLocation", marks).trigger(once=True).start(out)
        query.awaitTermination()
        got = spark.read.schema(files.schema).parquet(out).collect()
        return sorted((r.file_name, r.content_md5) for r in got)

    def md5(content):
        return hashlib.md5(content).hexdigest()

    put("a.txt", b"a")
    put("b.txt", b"b")
    first = [("a.txt", md5(b"a")), ("b.txt", md5(b"b"))]
    assert step() == first
    put("c.txt", b"c")
    os.utime(f"{root}/c.txt", (0, 0))  # an old date does not hide an arrival
    put("b.txt", b"changed")
    assert step() == sorted([*first, ("b.txt", md5(b"changed")), ("c.txt", md5(b"c"))])
    assert len(step()) == 4
