import numpy as np
import pytest

from kinfold.operators import tiles
from kinfold.operators.components import connected_components

EPS = 1.5
SIDE = EPS / 2 * (1 - 1e-9)


def cells_of(cells, seed, block=0):
    """Occupied cells with random boxes inside them, ids in the order of the coordinates."""
    rng = np.random.default_rng(seed)
    rows = []
    for i, cell in enumerate(sorted({tuple(map(int, c)) for c in cells})):
        ends = np.sort(rng.uniform(0, SIDE, size=(2, 4)), axis=0) + np.array(cell) * SIDE
        rows.append((block, i, int(rng.integers(1, 9)), *cell, *map(float, ends[0]), *map(float, ends[1])))
    return rows


def frame(spark, rows):
    doubles = ", ".join(f"{c}{k} double" for c in ("lo", "hi") for k in range(1, 5))
    longs = ", ".join(f"c{k} long" for k in range(1, 5))
    return spark.createDataFrame(rows, f"block long, id long, n long, {longs}, {doubles}")


def near(a, b, penalty=0.0):
    low_a, high_a, low_b, high_b = (np.array(x) for x in (a[7:11], a[11:15], b[7:11], b[11:15]))
    gap = np.maximum(0, np.maximum(low_b - high_a, low_a - high_b))
    reach = np.maximum(high_b - low_a, high_a - low_b)
    return penalty + (gap**2).sum() <= EPS**2, bool(penalty + (reach**2).sum() <= EPS**2)


def pairs_of(rows):
    out = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            close, sure = near(a, b)
            if close:
                out[a[1], b[1]] = sure
    return out


@pytest.fixture(params=["spread", "dense", "line"])
def rows(request):
    rng = np.random.default_rng(5)
    if request.param == "spread":  # many tiles, either sign
        return cells_of(rng.integers(-40, 40, size=(700, 4)) // np.array([1, 8, 8, 8]), 1)
    if request.param == "dense":  # all corners of a tile's border
        return cells_of(rng.integers(5, 11, size=(500, 4)), 2)
    return cells_of([(c, 0, 0, 0) for c in range(-60, 60)], 3)  # one cluster through eight tiles


def test_pairs_against_all_pairs(spark, rows):
    found = tiles.near_cells(frame(spark, rows), EPS, None, merged=False).collect()
    assert len(found) == len({(r.a_id, r.b_id) for r in found})
    assert {(r.a_id, r.b_id): r.sure for r in found} == pairs_of(rows)
    numbers = {r[1]: r[2] for r in rows}
    assert all(r.b_n == numbers[r.b_id] for r in found)


def test_merged_links_connect_the_same_cells(spark, rows):
    wanted = pairs_of(rows)
    found = tiles.near_cells(frame(spark, rows), EPS, None, merged=True)
    links = found.filter("sure").collect()
    copies = 16
    assert len(links) <= copies * len(rows)

    def roots(pairs):
        df = spark.createDataFrame([(min(p), max(p)) for p in pairs] or [], "a long, b long")
        return {r.node: r.root for r in connected_components(df).collect()}

    root = roots(pair for pair, sure in wanted.items() if sure)
    assert roots((r.a_id, r.b_id) for r in links) == root
    # Open pairs between clusters are all there, and no pair that is not open.
    still = {tuple(sorted((r.a_id, r.b_id))) for r in found.filter("NOT sure").collect()}
    opened = {pair for pair, sure in wanted.items() if not sure}
    assert still <= opened
    assert {p for p in opened if root.get(p[0], p[0]) != root.get(p[1], p[1])} <= still


@pytest.mark.parametrize("share", [16, 1])
def test_probes_meet_all_cells(spark, rows, share, monkeypatch):
    monkeypatch.setattr(tiles, "SHARE", share)
    rng = np.random.default_rng(8)
    probes = []
    for i in range(150):
        cell = rows[rng.integers(len(rows))][3:7]
        point = (np.array(cell) + rng.uniform(0, 1, 4)) * SIDE
        probes.append((0, 10_000 + i, 1, *cell, *map(float, point), *map(float, point)))
    found = tiles.probed_cells(frame(spark, probes), frame(spark, rows), EPS, None, per_cell=4).collect()
    wanted = {(p[1], c[1]): near(p, c)[1] for p in probes for c in rows if near(p, c)[0]}
    assert len(found) == len(wanted)
    assert {(r.a_id, r.b_id): r.sure for r in found} == wanted


def test_blocks_meet_where_they_are_bridged(spark):
    rng = np.random.default_rng(9)
    one, two, far = (cells_of(rng.integers(-12, 12, size=(120, 4)) // 3, s, block=s) for s in range(3))
    shifted = [[(r[0], r[1] + 1000 * r[0], *r[2:]) for r in part] for part in (one, two, far)]
    bridges = spark.createDataFrame([(0, 1, 1.25)], "a_block long, b_block long, penalty double")
    cells = frame(spark, [r for part in shifted for r in part])
    found = tiles.near_cells(cells, EPS, bridges, merged=False).filter("penalty > 0").collect()
    wanted = {(a[1], b[1]): near(a, b, 1.25)[1] for a in shifted[0] for b in shifted[1] if near(a, b, 1.25)[0]}
    assert wanted and {(r.a_id, r.b_id): r.sure for r in found} == wanted
    assert {r.penalty for r in found} == {1.25}


def test_no_cells(spark):
    empty = frame(spark, [])
    assert tiles.near_cells(empty, EPS, None, merged=True).isEmpty()
    assert tiles.probed_cells(empty, empty, EPS, None, 1).isEmpty()
