"""DBSCAN over cells against comparing all rows, dense cells, components."""

import numpy as np
import pytest

from quillon.operators import density
from quillon.operators.graph import components


def plainly(rows, eps, least):
    """(key, segment) by the definition."""
    rows = [(k, np.array(v, float)) for k, *v in rows]
    x = np.array([v for _, v in rows])
    near = sum((x[:, None, c] - x[None, :, c]) ** 2 for c in range(x.shape[1])) <= eps * eps
    core, group = near.sum(1) >= least, {}
    for i in sorted(np.flatnonzero(core), key=lambda i: rows[i][0]):
        todo = [i] if i not in group else []
        while todo:
            j = todo.pop()
            if j not in group:
                group[j] = rows[i][0]
                todo += [m for m in np.flatnonzero(near[j] & core) if m not in group]
    edge = lambda i: min((group[j] for j in np.flatnonzero(near[i] & core)), default=-1)
    return sorted((k, group[i] if i in group else edge(i)) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize(("d", "blocks"), [(1, 20_000), (2, 20_000), (2, 3), (3, 7)])
def test_groups_equal_the_definition(spark, monkeypatch, d, blocks):
    monkeypatch.setattr(density, "BLOCK", blocks)
    monkeypatch.setattr(density, "TRIED", 2)
    monkeypatch.setattr(density, "HELD", 500)
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.uniform(0, 12, (160, d)), rng.normal(3, 0.15, (90, d)), rng.normal(5, 0.4, (60, d)), np.round(rng.uniform(0, 4, (40, d)))])
    x = np.concatenate([x, x[:15]])
    keys = rng.permutation(len(x)).tolist()
    rows = [(k, *map(float, v)) for k, v in zip(keys, x, strict=True)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"v{i} double" for i in range(d)))
    for eps, least in ((0.5, 4), (0.9, 7)):
        assert sorted(map(tuple, density.dbscan(df, "k", [f"v{i}" for i in range(d)], eps, least).collect())) == plainly(rows, eps, least)


def test_dense_cell_missing_values_and_no_rows(spark):
    crowd = spark.range(300_000).selectExpr("id AS k", "(id % 1000) / 100000 AS a", "(id div 1000) / 100000 AS b")
    odd = spark.createDataFrame([(900_001, None, 1.0), (900_002, 0.5, 0.0), (900_003, 90.0, 0.0)], "k long, a double, b double")
    got = density.dbscan(crowd.unionByName(odd), "k", ["a", "b"], 0.5, 10)
    assert {r.segment: r["count"] for r in got.groupBy("segment").count().collect()} == {0: 300_001, -1: 2}
    assert density.dbscan(odd.limit(0), "k", ["a", "b"], 1.0, 2).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (8, 7), (7, 9)] + [(100, i) for i in range(101, 160)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {2: 1, 3: 1, 8: 7, 9: 7} | {i: 100 for i in range(101, 160)}
