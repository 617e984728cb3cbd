"""Exact neighbours against comparing all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import fitted, nearest


def plainly(x, k, method):
    scale = np.where(x.std(0) > 0, x.std(0), 1)
    x = (x - x.mean(0)) / scale
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    k = min(k, len(x) - 1)
    reach = np.sort(d, axis=1)[:, k - 1]
    if method == "knn":
        return reach
    near = d <= reach[:, None] * (1 + 1e-9)
    far = np.where(near, np.maximum(d, reach[None, :]), 0).sum(1) / near.sum(1)
    density = 1 / np.maximum(far, 1e-12)
    return (near * density[None, :]).sum(1) / near.sum(1) / density


@pytest.mark.parametrize("method", ["knn", "lof"])
@pytest.mark.parametrize("cell", [10_000, 40])
def test_scores_equal_all_pairs(spark, monkeypatch, method, cell):
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(nearest, "LOOKING", 50)
    monkeypatch.setattr(nearest, "HELD", 3000)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(8, 0.1, (150, 3)), rng.integers(0, 3, (200, 3)) * 1.5, np.tile([[2.0, 2.0, 2.0]], (60, 1)), [[40.0, -9.0, 3.0]]])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    got = {r.i: r.score for r in nearest.neighbour_scores(spark.createDataFrame(rows, "i long, a double, b double, c double"), ["a", "b", "c"], ["i"], method, 10, cell=cell).collect()}
    assert np.allclose([got[i] for i in range(len(x))], plainly(x, 10, method), rtol=1e-7, atol=1e-12)


def test_missing_few_and_no_rows(spark):
    schema = "i long, a double, b double, p int, score string"
    one = nearest.neighbour_scores(spark.createDataFrame([(1, 2.0, 3.0, 0, "x")], schema), ["a", "b"], ["i"], k=3).collect()
    assert [tuple(r) for r in one] == [(1, None)]
    assert nearest.neighbour_scores(spark.createDataFrame([], schema), ["a", "b"], ["i"], k=3).count() == 0
    rows = [(1, 2.0, None, 0, "x"), (2, float("nan"), 1.0, 0, "x"), (3, 2.0, 1.0, 0, "x"), (3, 2.0, 5.0, 0, "x")]
    got = nearest.neighbour_scores(spark.createDataFrame(rows, schema), ["a", "b"], ["i"], k=9).collect()
    assert len(got) == 4 and sorted(r.score > 0 for r in got) == [True] * 4


def test_smote_lies_between_neighbours_whatever_the_partitioning(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 3, (800, 2)), 6)
    x[790:] = x[789]
    rows = [(i, *map(float, v), 1) for i, v in enumerate(x)] + [(i, 50.0, 50.0, 0) for i in range(5000)] + [(7000, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "i long, a double, b double, y int")
    out = [fitted.smote(part, "y", ["a", "b"], 1, 0.5, k=5, cell=60) for part in (df.repartition(3), df.repartition(7, "b"))]
    one, two = (sorted(map(tuple, o.where("y = 1 AND a IS NOT NULL").collect())) for o in out)
    assert one == two and len(one) == 2500 - 1
    own = {tuple(map(float, v)) for v in x}
    made = np.array([r[:2] for r in one if r[:2] not in own])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    a, b = np.repeat(x, 5, 0), x[near.ravel()]
    for s in made:
        along, off = b - a, s - a
        u = (off * along).sum(1) / np.maximum((along**2).sum(1), 1e-300)
        apart = np.abs(off - u[:, None] * along).max(1)
        assert ((apart < 1e-9) & (u > -1e-9) & (u < 1 + 1e-9)).any()
    assert fitted.smote(df.where(F.col("i") < 1), "y", ["a", "b"], 1).count() == 2


def test_boxes_stay_small_and_a_row_looks_into_few():
    """Cells grow no further with the rows, hold each point once, and no box in reach is missed; lines of equal values are cut along."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, 50, 60_000) * 0.07, rng.uniform(-2, 2, 60_000), rng.integers(0, 11, 60_000) * 0.3], axis=1)
    tree = nearest._Boxes(x, 10)
    cells = tree.cell(x)
    ids, n = np.unique(cells, return_counts=True)
    assert tree.cells > 5000 and n.max() <= 10 and n.sum() == len(x)
    order = np.argsort(cells, kind="stable")
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    low, high = np.minimum.reduceat(x[order], first), np.maximum.reduceat(x[order], first)
    tree.fill(ids, low, high, n, 4)
    some, reach = x[:40], np.full(40, 0.1)
    row, cell = tree.near(some, reach)
    off = np.maximum(0, np.maximum(low[None] - some[:, None], some[:, None] - high[None]))
    want = {(r, ids[c]) for r, c in zip(*np.nonzero(np.sqrt((off**2).sum(2)) <= 0.1), strict=True)}
    assert set(zip(row.tolist(), cell.tolist(), strict=True)) == want and len(want) < 40 * 100
    d = np.sqrt(((some[:, None] - x[None]) ** 2).sum(2))
    assert (np.sort(d, axis=1)[:, 3] <= tree.within(some, cells[:40]) + 1e-12).all()
