"""Groups kept from scan to scan against whole recomputation; cells against breakdowns; tables across runs."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from kinfold import labels, schemas
from kinfold.operators import exact, incremental, rollups
from kinfold.sources import stages
from kinfold.sources.scratch import new_location
from tests.makers import START, cleaned_rows

AS_OF = START + timedelta(days=200)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def whole(cleaned):
    """What a full run gives, with ages at AS_OF."""
    from kinfold.operators.clean import derive_ages

    return rows_of(exact.exact_duplicates(derive_ages(cleaned, AS_OF).select(*schemas.CLEANED.names)))


def scan(spark, files):
    return cleaned_rows(spark, [{"path": path, **values} for path, values in sorted(files.items())])


def test_equals_whole_recomputation_over_many_scans(spark):
    rng = random.Random(4)

    def file():
        return {"content_md5": f"h{rng.randrange(25)}", "size_bytes": rng.choice([5, 6]), "created_at": START + timedelta(hours=rng.randrange(4))}

    files = {f"/d/u/{i}": file() for i in range(120)}
    location = new_location(spark, "state")
    incremental.start(scan(spark, files), location, 8)
    for _ in range(3):
        assert rows_of(incremental.exact_rows(spark, location, AS_OF)) == whole(scan(spark, files))
        for path in rng.sample(sorted(files), 12):
            del files[path]
        files |= {path: file() for path in rng.sample(sorted(files), 8)}
        files |= {f"/d/new{rng.random()}": file() for _ in range(10)}
        incremental.update(scan(spark, files), location)
    assert rows_of(incremental.exact_rows(spark, location, AS_OF)) == whole(scan(spark, files))
    assert incremental.update(scan(spark, files), location) == []
    incremental.update(scan(spark, {}), location)
    assert incremental.exact_rows(spark, location, AS_OF).collect() == []
    incremental.update(scan(spark, files), location)
    assert rows_of(incremental.exact_rows(spark, location, AS_OF)) == whole(scan(spark, files))


def folders(spark, location):
    """The data files of each bucket."""
    out = {}
    for name in spark.read.parquet(location).inputFiles():
        folder, _, file = name.rpartition("/")
        out.setdefault(int(folder.rpartition("=")[2]), set()).add(file)
    return out


def test_touches_only_buckets_of_changed_keys(spark):
    files = {f"/d/{i}": {"content_md5": f"h{i % 200}"} for i in range(400)}
    location = new_location(spark, "state")
    incremental.start(scan(spark, files), location, 32)
    before = folders(spark, f"{location}/files"), folders(spark, f"{location}/groups")
    files["/d/7"] = {"content_md5": "other"}
    touched = incremental.update(scan(spark, files), location)
    assert 1 <= len(touched) <= 2
    after = folders(spark, f"{location}/files"), folders(spark, f"{location}/groups")
    for was, now in zip(before, after, strict=True):
        assert {b for b in was | now if was.get(b) != now.get(b)} <= set(touched)
    assert rows_of(incremental.exact_rows(spark, location, AS_OF)) == whole(scan(spark, files))


@pytest.mark.parametrize("moves", [0, 1, 3])
def test_an_update_that_died_is_carried_on(spark, monkeypatch, moves):
    files = {f"/d/{i}": {"content_md5": f"h{i % 5}"} for i in range(20)}
    location = new_location(spark, "state")
    incremental.start(scan(spark, files), location, 4)
    files["/d/20"] = {"content_md5": "h3"}
    del files["/d/2"]
    move, done = incremental.move_path, []

    def dies(session, place, target):
        if len(done) == moves:
            raise OSError("lost")
        done.append(target)
        move(session, place, target)

    with monkeypatch.context() as patch:
        patch.setattr(incremental, "move_path", dies)
        with pytest.raises(OSError):
            incremental.update(scan(spark, files), location)
    assert len(done) == moves
    assert rows_of(incremental.exact_rows(spark, location, AS_OF)) == whole(scan(spark, files))
    assert incremental.update(scan(spark, files), location) == []


def combined(spark, n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        kind = rng.choice([(labels.EXACT, labels.EXACT_KEY), (labels.NEAR, labels.NEAR_KEY)])
        group = rng.choice([rng.randrange(40), 40_000 + rng.randrange(5)])
        place = rng.choice("ab"), rng.choice("xyz"), rng.choice("mn")
        rows.append((f"n{i}", "/".join(place) + f"/{i}", "/".join(place), rng.randrange(10**7), rng.choice([".t", ".u"]), kind[0], f"{kind[1]}{group}", *place))
    return spark.createDataFrame(rows, schemas.COMBINED)


def test_cells_give_every_breakdown_without_expand(spark):
    rows = combined(spark)
    cells = rollups.group_cells(rows)
    got = rollups.cell_breakdowns(cells)
    assert rows_of(got) == rows_of(rollups.breakdown_all(rows))
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    some = F.col("depot") == "a"
    assert rows_of(rollups.cell_breakdown(cells.filter(some), "unit")) == rows_of(rollups.breakdown(rows.filter(some), "unit"))
    assert rows_of(rollups.cell_kpis(cells)) == rows_of(rollups.kpis_wide(rows))
    empty = rollups.group_cells(rows.limit(0))
    assert rows_of(rollups.cell_kpis(empty)) == rows_of(rollups.kpis_wide(rows.limit(0))) and rollups.cell_breakdowns(empty).collect() == []


def test_sketches_are_close(spark):
    rows = spark.range(120_000).selectExpr(
        "concat('n', id) AS name_key", "concat('/a/b/c/', id) AS path", "'/a/b/c' AS parent_dir", "id AS size_bytes", "'.t' AS extension",
        f"'{labels.EXACT}' AS dup_type", f"concat('{labels.EXACT_KEY}', id % 50000) AS group_key", "'a' AS depot", "concat('u', id % 2) AS unit", "'c' AS owner",
    )
    cells = rollups.group_cells(rows)
    exact_n = {r.unit: r.n_groups for r in rollups.cell_breakdown(cells, "unit").collect()}
    close = {r.unit: r.n_groups for r in rollups.approximate_groups(cells, "unit").collect()}
    assert exact_n == {"u0": 25_000, "u1": 25_000} and all(abs(close[u] / n - 1) < 0.02 for u, n in exact_n.items())


def test_tables_across_runs(spark):
    root = new_location(spark, "history")
    assert stages.read_runs(spark, root, "kpis").collect() == []
    kpis = [spark.createDataFrame([("files", float(k))], schemas.KPIS) for k in range(4)]
    for run_id, rows in (("a", kpis[0]), ("b", kpis[1]), ("a", kpis[2]), ("c/d e", kpis[3])):
        assert [r.value for r in stages.write_run_rows(rows, root, run_id, "kpis").collect()] == [rows.first().value]
    every = {r.run_id: r.value for r in stages.read_runs(spark, root, "kpis").collect()}
    assert every == {"a": 2.0, "b": 1.0, "c/d e": 3.0}
    one = stages.read_runs(spark, root, "kpis", ["b"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
