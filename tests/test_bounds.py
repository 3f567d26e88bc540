"""Bounds of colours: early stop against the full grid and against plain loops."""

import itertools

import numpy as np
import pytest

from ethoframe.operators import bounds

GRID = list(itertools.product((0.0, 3.0), (5.0, 8.0), (0.0, 2.0, 4.0), (0.0, 3.0, 6.0)))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = [(f, int(rng.integers(0, 4)), int(rng.integers(0, 10)), int(rng.integers(0, 8)), int(rng.integers(0, 9)), int(rng.random() < 0.6)) for f in range(60) for _ in range(int(rng.integers(1, 50)))]
    return rows, spark.createDataFrame(rows, "frame int, blob int, h int, s int, v int, body int").cache()


def plain(rows, area, weights):
    frames = sorted({r[0] for r in rows})
    out = []
    for c in GRID:
        cheap, share, none, over = [], [], 0, 0
        for f in frames:
            own = [r for r in rows if r[0] == f and c[0] <= r[2] <= c[1] and r[3] >= c[2] and r[4] >= c[3]]
            cheap.append(sum(r[5] for r in own) / len(own) if own else 0.0)
            sizes = [sum(r[5] for r in own if r[1] == b) for b in {r[1] for r in own}]
            sizes = [n for n in sizes if area[0] <= n <= area[1]]
            share.append(max(sizes) / sum(sizes) if sizes else 0.0)
            none, over = none + (not sizes), over + (len(sizes) > 1)
        n = len(frames)
        out.append((np.mean(cheap), (weights[0] * sum(share) - weights[1] * none - weights[2] * over) / n, sum(share) / n, none / n, over / n))
    return out


@pytest.mark.parametrize("area, weights, top", [((2, 6), (1.0, 2.0, 2.0), 500), ((1, 3), (1.0, 0.2, 0.1), 500), ((3, 30), (2.0, 1.0, 0.5), 12)])
def test_early_stop_finds_the_best_of_the_full_grid(points, area, weights, top):
    rows, df = points
    each = plain(rows, area, weights)
    most = max(e[0] for e in each)
    kept = sorted((k for k in range(len(GRID)) if each[k][0] >= 0.2 * most), key=lambda k: (-each[k][0], k))[:top]
    best = max(kept, key=lambda k: (round(each[k][1], 9), -kept.index(k)))
    found = bounds.search(df, GRID, area=area, weights=weights, top=top)
    assert found.best == GRID[best] and np.allclose((found.score, found.precision, found.no_detection, found.over_detection), each[best][1:])
    full = bounds.search(df, GRID, area=area, weights=weights, top=top, early_stop=False)
    assert full.best == found.best and full.scored == full.full == found.full >= found.scored and found.tried == len(kept)


def test_work_is_saved_where_one_candidate_is_clear(spark):
    """One candidate takes whole blobs, the others several or none: half the blocks suffice."""
    rows = [(f, b, 5 if b == 0 else 9, 5, 5, 1) for f in range(80) for b in range(3) for _ in range(4)]
    df = spark.createDataFrame(rows, "frame int, blob int, h int, s int, v int, body int")
    grid = [(0.0, 6.0, 0.0, 0.0), *[(0.0, 10.0, 0.0, float(v)) for v in range(6)], *[(7.0, 10.0, 0.0, float(v)) for v in range(6)]]
    found = bounds.search(df, grid, area=(2, 9))
    assert found.best == grid[0] and found.score == 1 and found.scored < 0.4 * found.full


def test_no_points(spark):
    df = spark.createDataFrame([], "frame int, blob int, h int, s int, v int, body int")
    assert bounds.search(df, GRID).best is None


def test_only_sums_by_candidate_are_shuffled(points):
    cells = bounds.counted(points[1], GRID, "frame", 4)
    cells = cells.sparkSession.createDataFrame(cells.collect(), cells.schema)
    needs = bounds._needs(GRID, list(range(len(GRID))))
    for df in (bounds.cheap_scores(cells, needs, 60), bounds.exact_sums(cells, needs, (2, 6))):
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        dealt = [x for x in plan if "Exchange hashpartitioning" in x]
        assert len(dealt) == 1 and "hashpartitioning(k#" in dealt[0]
