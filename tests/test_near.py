import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold import schemas
from kinfold.operators import features, grid, near, tiles
from kinfold.operators.components import connected_components
from kinfold.sources.scratch import materialize
from tests import brute
from tests.makers import exact_rows

NUMBERS = features.NUMBERS


def dataset(seed, n, extensions=(".a", ".b", ".c"), spread=20, heavy=False):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        size = draw.randrange(spread) * (10_000 if not heavy or draw.random() < 0.9 else 10_000_000)
        numbers = [size, draw.randrange(5), draw.randrange(spread), draw.randrange(spread)]
        rows.append(
            {
                "path": f"/p{i:04d}",
                "numbers": numbers,
                "extension": draw.choice(extensions),
                "size_class": "Petit" if draw.random() < 0.7 else "Moyen",
            }
        )
    return rows


def frame(spark, rows):
    return exact_rows(
        spark,
        [
            {**dict(zip(NUMBERS, r["numbers"], strict=True)), **{k: r[k] for k in ("path", "extension", "size_class")}}
            for r in rows
        ],
    )


def check(spark, rows, eps=1.5, min_samples=2, partitions=None):
    df = frame(spark, rows)
    if partitions:
        df = df.repartition(partitions)
    x = brute.vectors(rows)
    labels = brute.dbscan(x, eps, min_samples)
    scores = brute.similarities(x, labels)
    out = {r.path: r for r in near.near_duplicates(df, eps, min_samples).collect()}
    assert len(out) == len(rows)
    sizes = {label: int((labels == label).sum()) for label in labels}
    for row, label, score in zip(rows, labels, scores, strict=True):
        got = out[row["path"]]
        assert got.cluster_id == label, row
        assert got.cluster_size == (1 if label == -1 else sizes[label])
        assert got.cluster_status == ("Isolé" if label == -1 else f"Cluster #{label}")
        assert (got.similarity is None) == (score is None)
        if score is not None:
            assert abs(got.similarity - score) <= 1e-4


@pytest.mark.parametrize(
    ("seed", "n", "eps", "min_samples"),
    [(1, 120, 1.5, 2), (2, 120, 0.6, 2), (3, 120, 1.0, 4), (5, 100, 3.6, 2), (6, 100, 3.3, 6), (7, 40, 1.5, 1)],
)
def test_against_all_pairs(spark, seed, n, eps, min_samples):
    extensions = (".a", ".b") if eps > 2.8 else (".a", ".b", ".c")
    check(spark, dataset(seed, n, extensions), eps, min_samples)


def test_result_does_not_depend_on_the_partitions(spark):
    check(spark, dataset(11, 100, heavy=True), 0.8, 2, partitions=17)


def test_boxes_are_split_when_cells_are_full(spark, monkeypatch):
    """With hardly any direct comparisons allowed, open pairs go through several halvings."""
    monkeypatch.setattr(grid, "POINT_PAIRS", 1)
    check(spark, dataset(21, 140, extensions=(".a",), spread=60), 0.7, 2)
    check(spark, dataset(22, 140, extensions=(".a",), spread=60), 0.7, 5)


def test_zero_one_and_two_rows(spark):
    empty = near.near_duplicates(spark.createDataFrame([], schemas.EXACT))
    assert empty.schema.names == schemas.NEAR.names and empty.isEmpty()
    one = near.near_duplicates(frame(spark, dataset(1, 1))).first()
    assert (one.cluster_id, one.cluster_status, one.cluster_size, one.similarity) == (-1, "Isolé", 1, None)
    check(spark, dataset(2, 2))


def test_identical_rows_are_one_cluster_without_similarity(spark):
    rows = [{"path": f"/p{i}", "numbers": [1, 1, 1, 1], "extension": ".a", "size_class": "Petit"} for i in range(5)]
    out = near.near_duplicates(frame(spark, rows)).collect()
    assert {(r.cluster_id, r.cluster_size, r.similarity) for r in out} == {(0, 5, 0.0)}


def test_null_numbers_count_as_zero(spark):
    rows = dataset(3, 20)
    for row in rows[:5]:
        row["numbers"][2] = 0
    df = frame(spark, rows).withColumn("age_days", F.when(F.col("age_days") != 0, F.col("age_days")))
    scores = [features.scaling(features.block_stats(each)) for each in (df, frame(spark, rows))]
    assert scores[0] == scores[1]
    assert features.standardized(df, scores[0]).filter("z3 IS NULL").isEmpty()


def test_candidates_leave_out_later_copies(spark):
    rows = exact_rows(
        spark,
        [
            {"path": "/u"},
            {"path": "/o", "is_exact_dup": True, "copy_rank": 1, "dup_status": "Original"},
            {"path": "/d", "is_exact_dup": True, "copy_rank": 2, "dup_status": "Doublon #1"},
        ],
    )
    assert {r.path for r in features.candidates(rows).collect()} == {"/u", "/o"}


def points_space(points):
    """Pairs of single-point cells for settle_pairs."""
    return [(i, *p) for i, p in enumerate(points)]


def test_distance_equal_to_eps_counts(spark):
    rows = points_space([(0.0, 0.0, 0.0, 0.0), (1.5, 0.0, 0.0, 0.0), (3.0000001, 0.0, 0.0, 0.0)])
    points = spark.createDataFrame([(*r, 1) for r in rows], "id long, z1 double, z2 double, z3 double, z4 double, w long")
    pairs = spark.createDataFrame([(0, 1, 0.0), (1, 2, 0.0), (0, 2, 0.0)], "a_id long, b_id long, penalty double")
    hits = grid.settle_pairs(pairs, points, points, 1.5, count=False).collect()
    assert [(r.a_id, r.b_id) for r in hits] == [(0, 1)]


def test_counting_inside_a_full_cell(spark, monkeypatch):
    monkeypatch.setattr(grid, "POINT_PAIRS", 8)
    rng = np.random.default_rng(4)
    cloud = rng.uniform(0, 0.74, size=(400, 4))
    probes = rng.uniform(-0.9, -0.2, size=(6, 4))
    b = spark.createDataFrame([(100, *map(float, p), 2) for p in cloud], "id long, z1 double, z2 double, z3 double, z4 double, w long")
    a = spark.createDataFrame(
        [(i, *map(float, p), 1) for i, p in enumerate(probes)], "id long, z1 double, z2 double, z3 double, z4 double, w long"
    )
    pairs = spark.createDataFrame([(i, 100, 0.0) for i in range(6)], "a_id long, b_id long, penalty double")
    got = {r.a_id: r.hits for r in grid.settle_pairs(pairs, a, b, 1.5, count=True).collect()}
    distances = np.linalg.norm(probes[:, None] - cloud[None], axis=2)
    assert got == {i: 2 * int(n) for i, n in enumerate((distances <= 1.5).sum(axis=1)) if n}


def test_steps_cover_all_cells_within_eps():
    assert len(tiles.steps()) == 841


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    draw = random.Random(9)
    ids = list(range(120))
    draw.shuffle(ids)
    edges = {
        "path": list(zip(ids, ids[1:])),
        "star": [(ids[0], i) for i in ids[1:]],
        "random": [(draw.randrange(200), draw.randrange(200)) for _ in range(120)],
        "none": [],
    }[shape]
    root = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in connected_components(df).collect()} == {n: find(n) for n in root}


def two_sides(spark, n, items):
    """Points of ``items`` items on each of two sides, some pairs of which are within 1.5."""
    draw = random.Random(5)
    points = [
        (side * items + i % items, draw.random(), side * 2.0 + draw.random() * 0.8, draw.random() * 3, draw.random() * 3, 1)
        for side in (0, 1)
        for i in range(n)
    ]
    return spark.createDataFrame(points, "id long, z1 double, z2 double, z3 double, z4 double, w long")


def test_settling_stops_when_one_pair_of_what_is_asked_is_a_link(spark):
    points = two_sides(spark, 400, 20)
    pairs = spark.range(20).crossJoin(spark.range(20, 40).toDF("b_id")).selectExpr("id AS a_id", "b_id", "0D AS penalty", "1L AS low", "2L AS high")
    each = grid.settle_pairs(pairs, points, points, 1.5, count=False)
    assert each.columns == ["a_id", "b_id", "hits"] and each.count() > 1
    both = grid.settle_pairs(pairs, points, points, 1.5, count=False, until=("low", "high"))
    assert [(r.low, r.high) for r in both.collect()] == [(1, 2)]
    assert grid.settle_pairs(pairs, points, points, 0.1, count=False, until=("low", "high")).isEmpty()


def test_points_are_not_sent_through_the_driver(spark, monkeypatch):
    """Joins with points are merged, although they are far below the size that Spark broadcasts."""
    written = []
    monkeypatch.setattr(grid, "materialize", lambda df, name: written.append((name, df._jdf.queryExecution().executedPlan().toString())) or materialize(df, name))
    points = two_sides(spark, 100, 1)
    pairs = spark.createDataFrame([(0, 1, 0.0)], "a_id long, b_id long, penalty double")
    assert grid.settle_pairs(pairs, points, points, 1.5, count=False).count() == 1
    plans = [plan for name, plan in written if name in ("box-pairs", "met-pairs")]
    assert len(plans) > 1 and all(plan.count("SortMergeJoin") >= 2 for plan in plans)
    assert not any("Inner, Build" in plan for plan in plans)
