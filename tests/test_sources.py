import base64
import binascii
import hashlib
import os

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold import labels, schemas
from kinfold.sources import folder, stages
from kinfold.sources.inventory import drop_excluded
from kinfold.sources.payloads import (
    _FOREIGN,
    accepted_payloads,
    decode_base64,
    decoded_payloads,
    payload_files,
    payload_inventory,
    payload_outcomes,
    rejected_payloads,
)
from kinfold.sources.scratch import materialize, scratch_root


def python_decode(text):
    try:
        return base64.b64decode(text)
    except binascii.Error:
        return None


BASE64_CASES = ["aGk=", "aG k=", "aGk", "", "!!!", "YQ==YQ", "YQ=YQ", "=YWJj", "YWI==", "YWJj=YWJj", "Y", "Y===", "YQ=",
                "YQ=\n=", "aGVsbG8-", "YWJjZA==", "YW=Jj", "=", "YWJjYQ====", "YQ=a=", "ab=cd==="]


def test_base64_is_lenient_like_python(spark, values):
    decoded = values(lambda c: F.get(decode_base64(c), 0), BASE64_CASES, "string")
    assert [None if d is None else bytes(d) for d in decoded] == [python_decode(c) for c in BASE64_CASES]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="YWJj= \n-", max_size=12), min_size=100, max_size=100))
def test_base64_random_texts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    got = rows.select("i", F.get(decode_base64(F.col("v")), 0).alias("d")).orderBy("i").collect()
    assert [None if r.d is None else bytes(r.d) for r in got] == [python_decode(t) for t in texts]


def test_payloads(spark):
    uploads = spark.createDataFrame(
        [
            (1, "d\\a.txt", "data:;base64,aGk="),
            (2, "b.txt", "data:;base64,aGk"),
            (3, "c.txt", "no comma"),
            (4, "d/a.txt", "data:;base64,aGV5,"),
            (5, "d/a.txt", "data:;base64,Y"),
        ],
        "upload_seq long, name string, data_uri string",
    )
    assert [(r.seq, r.path, r.content_md5) for r in payload_files(uploads).collect()] == [(4, "d/a.txt", hashlib.md5(b"hey").hexdigest())]
    inventory = payload_inventory(uploads, "2024-01-01 00:00:00")
    assert inventory.schema.names == schemas.RAW.names
    row = inventory.first()
    assert (row.file_name, row.extension, row.size_bytes) == ("a.txt", ".txt", 3)
    assert row.content_md5 == hashlib.md5(b"hey").hexdigest()


def test_payloads_are_decoded_once(spark):
    uploads = spark.createDataFrame([(1, "a", "data:;base64,aGk=")], "upload_seq long, name string, data_uri string")
    plan = decoded_payloads(uploads)._jdf.queryExecution().executedPlan().toString()
    # Ordinary texts and others, each at one place: no filter decodes as well.
    assert plan.count("unbase64") == 2


def test_foreign_characters_are_all_but_the_alphabet(spark):
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kept = spark.createDataFrame([(every,)], "c string").select(F.regexp_replace("c", _FOREIGN, "")).first()[0]
    assert kept == "+/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def test_broken_lines_and_foreign_characters_of_uploads(spark):
    contents = [b"", b"x" * 500, bytes(range(256)) * 3]
    bodies = [base64.encodebytes(c).decode().replace("\n", end) for c in contents for end in ("\r\n", "\n", "\r", " \u2028-", "\U0001F600")]
    cases = [*BASE64_CASES, *bodies]
    uploads = spark.createDataFrame(
        [(i, f"f{i}", "data:;base64," + c) for i, c in enumerate(cases)], "upload_seq long, name string, data_uri string"
    )
    got = {r.seq: bytes(r.content) for r in decoded_payloads(uploads).collect()}
    assert got == {i: d for i, c in enumerate(cases) if (d := python_decode(c.encode("ascii", "ignore"))) is not None}


def test_excluded_directories(spark):
    paths = ["/MyWindowsBackup/a", "/x/Windows.txt", "/windows/a", "C:\\.git\\a", "/x/.venv/y/a", "/.gitignore"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = {r.path for r in drop_excluded(rows).collect()}
    assert kept == {"/x/Windows.txt", "/windows/a", "/.gitignore"}
    assert {r.path for r in drop_excluded(rows, []).collect()} == kept
    assert drop_excluded(rows, ["x"]).count() == 4


@pytest.fixture
def tree(tmp_path):
    # the root's own name holds an excluded token, which must not matter
    root = tmp_path / "Windows root"
    files = {
        "a.txt": b"same",
        "sub/b.txt": b"same",
        "sub/deep/c.tar.gz": b"x" * 5000,
        "sub/node_modules/d.txt": b"pruned",
        "sub/.hidden": b"h",
        "empty.md": b"",
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return root, files


def facts(df):
    return {(r.path, r.file_name, r.size_bytes, r.extension, r.content_md5) for r in df.collect()}


def expected(root, files, names):
    return {
        (f"{root}/{n}", os.path.basename(n), len(files[n]), os.path.splitext(n)[1], hashlib.md5(files[n]).hexdigest())
        for n in names
    }


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_scan_folder(spark, tree, scheme):
    root, files = tree
    (root / "broken").symlink_to(root / "nowhere")
    (root / "again").symlink_to(root / "sub")
    (root / "self").symlink_to(root / "self")
    (root / "sub" / "up").symlink_to(root)
    names = ["a.txt", "sub/b.txt", "sub/deep/c.tar.gz", "sub/.hidden", "empty.md"]
    scanned = folder.scan_folder(spark, scheme + str(root).replace(" ", "%20") if scheme else str(root))
    assert scanned.schema.names == schemas.RAW.names
    found = {(path.removeprefix(scheme), *rest) for path, *rest in facts(scanned)}
    assert found == expected(root, files, names)
    assert len(scanned.first().created_at_raw) == len("2024-01-01 00:00:00")


def test_large_flat_folder(spark, tmp_path, monkeypatch):
    """Listings leave a task in pieces; an unreadable sub-folder costs only itself."""
    monkeypatch.setattr(folder, "ENTRIES_AT_ONCE", 100)
    for i in range(1050):
        (tmp_path / f"f{i}.txt").write_bytes(b"%d" % (i % 7))
    (tmp_path / "closed").mkdir(mode=0)
    rows = folder.scan_folder(spark, str(tmp_path))
    assert rows.count() == 1050 and rows.select("content_md5").distinct().count() == 7


def test_unreadable_file_stays_without_hash(spark, tmp_path):
    os.mkfifo(tmp_path / "pipe.txt")
    row = folder.scan_folder(spark, str(tmp_path)).first()
    assert (row.file_name, row.content_md5) == ("pipe.txt", None)


def test_scan_errors_and_empty(spark, tmp_path):
    with pytest.raises(ValueError):
        folder.scan_folder(spark, "  ")
    with pytest.raises(FileNotFoundError):
        folder.scan_folder(spark, str(tmp_path / "missing"))
    empty = folder.scan_folder(spark, str(tmp_path))
    assert empty.schema.names == schemas.RAW.names and empty.collect() == []


def test_stage_store(spark, tmp_path):
    root = str(tmp_path)
    assert not stages.has_results(spark, root, "r1")
    empty = stages.read_stage(spark, root, "r1", "exact")
    assert empty.schema == schemas.EXACT and empty.isEmpty()
    kpis = spark.createDataFrame([("m", 1.0)], schemas.KPIS)
    stages.write_stage(kpis, root, "r1", "kpis")
    assert stages.has_results(spark, root, "r1") and not stages.has_results(spark, root, "r2")
    assert stages.read_stage(spark, root, "r1", "kpis").collect() == kpis.collect()
    stages.reopen_run(spark, root, "r1")
    assert not stages.has_results(spark, root, "r1")


def test_scratch_uses_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert scratch_root(spark) == configured
    assert materialize(spark.range(3), "t").count() == 3
    assert materialize(spark.range(0), "t").collect() == []


def test_scan_rejects(spark, tree):
    """Files met = files of the inventory and files that vanished; everything not taken has one reason."""
    root, files = tree
    (root / "broken").symlink_to(root / "nowhere")
    (root / "again").symlink_to(root / "sub")
    os.mkfifo(root / "pipe.txt")
    inventory, rejects = folder.scan_with_rejects(spark, str(root))
    assert facts(inventory) == facts(folder.scan_folder(spark, str(root)))
    found = {(os.path.relpath(r.path, root), r.is_dir, r.reason) for r in rejects.collect()}
    assert found == {
        ("broken", False, labels.VANISHED),
        ("again", True, labels.LINKED_DIR),
        ("sub/node_modules", True, labels.EXCLUDED),
        ("pipe.txt", False, labels.UNREAD),
    }


def test_unlisted_directory_is_told(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_bytes(b"a")
    lister = folder._lister(str(tmp_path), labels.EXCLUDED_DIRS)
    batches = list(lister(iter([pd.DataFrame({"path": [str(tmp_path), str(tmp_path / "gone")]})])))
    rows = {(r.path, r.is_dir, r.reason) for b in batches for r in b.itertuples()}
    assert rows == {(f"{tmp_path}/a.txt", False, None), (f"{tmp_path}/gone", True, labels.UNLISTED_DIR)}


def test_payload_outcomes(spark):
    rows = [
        (1, "d\\a.txt", "data:;base64,aGk="),
        (2, "b.txt", "data:;base64,aGk"),
        (3, "c.txt", "no comma"),
        (4, "d/a.txt", "data:;base64,aGV5"),
        (4, "d/a.txt", "data:;base64,aGV5"),  # the same upload twice: one stays
        (5, "d/a.txt", "data:;base64,Y"),
        (6, ".git/x", "data:;base64,Y"),
        (7, None, "data:;base64,aGk="),
        (8, "e.txt", None),
        (9, "f.txt", "data:,"),
        (None, "g.txt", "data:;base64,aGk="),
    ]
    uploads = spark.createDataFrame(rows, "upload_seq long, name string, data_uri string")
    outcomes = payload_outcomes(uploads)
    accepted, rejected = accepted_payloads(outcomes, "2024-01-01 00:00:00"), rejected_payloads(outcomes)
    assert accepted.count() + rejected.count() == len(rows)
    assert accepted.orderBy("path").collect() == payload_inventory(uploads, "2024-01-01 00:00:00").orderBy("path").collect()
    assert sorted((r.seq or 0, r.reason) for r in rejected.collect()) == [
        (1, labels.REPLACED), (2, labels.NOT_DECODABLE), (3, labels.NO_DATA), (4, labels.REPLACED), (5, labels.NOT_DECODABLE),
        (6, labels.EXCLUDED), (7, labels.NO_NAME), (8, labels.NO_DATA),
    ]
    assert payload_outcomes(uploads.limit(0)).collect() == []
