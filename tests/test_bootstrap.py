"""Bootstrap intervals: draws, brute force, any partitioning, edges."""

import numpy as np
import pytest

from quillon.operators.bootstrap import METRICS, bootstrap, draws


def test_draws_are_poisson():
    place = np.arange(4_000)
    for mean in (1, 3, 12, 29, 30, 400):
        w = draws(np.full(4_000, mean), place, 50, 1, 42)[:, 1:]
        assert w.mean() == pytest.approx(mean, rel=0.01) and w.var() == pytest.approx(mean, rel=0.03)
        assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[:-1, 3], w[1:, 3])[0, 1]) < 0.06
    one = draws(np.ones(4_000, int), place, 1, 1, 42)[:, 1]
    assert (one == 0).mean() == pytest.approx(np.exp(-1), abs=0.02) and (draws(np.zeros(5, int), place[:5], 3, 1, 42) == 0).all()
    assert (draws(np.ones(9, int), place[:9], 9, 1, 42) != draws(np.ones(9, int), place[:9], 9, 3, 42)).any()


def brute(s, pos, neg, resamples, threshold):
    """Metrics of every resample from plain loops over the distinct scores."""
    place = np.arange(len(s))
    p, n = draws(pos, place, resamples, 1, 42), draws(neg, place, resamples, 3, 42)
    out = {m: [] for m in METRICS}
    for b in range(resamples + 1):
        P, N, hit = p[:, b].sum(), n[:, b].sum(), s >= threshold
        tp, fp = p[hit, b].sum(), n[hit, b].sum()
        pairs = sum(n[i, b] * (p[i + 1 :, b].sum() + p[i, b] / 2) for i in range(len(s)))
        ap = sum(p[i, b] * p[i:, b].sum() / max(p[i:, b].sum() + n[i:, b].sum(), 1) for i in range(len(s)))
        out["precision"].append(tp / (tp + fp))
        out["recall"].append(tp / P)
        out["f1"].append(2 * tp / (tp + fp + P))
        out["alert_rate"].append((tp + fp) / (P + N))
        out["brier"].append((p[:, b] * (1 - s) ** 2 + n[:, b] * s**2).sum() / (P + N))
        out["roc_auc"].append(pairs / (P * N))
        out["average_precision"].append(ap / P)
    return {m: (v[0], np.quantile(v[1:], 0.025), np.quantile(v[1:], 0.975)) for m, v in out.items()}


def test_equals_brute_force_for_any_ranges(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 1500)
    s = np.round(np.clip(0.25 * y + 0.75 * rng.random(1500), 0, 1), 2)
    s[:200], y[:200] = 0.5, rng.random(200) < 0.8  # a tie of many rows
    rows = [(int(a), float(b)) for a, b in zip(y, s, strict=True)] + [(None, 0.4), (1, None)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = {r.metric: (r.value, r.low, r.high) for r in bootstrap(df, "y", "s", 80).collect()}
    values = np.unique(s)
    want = brute(values, np.array([((s == v) & (y == 1)).sum() for v in values]), np.array([((s == v) & (y == 0)).sum() for v in values]), 80, 0.5)
    assert set(got) == set(METRICS)
    for m in METRICS:
        assert got[m] == pytest.approx(want[m], abs=1e-9), m
    again = {r.metric: (r.value, r.low, r.high) for r in bootstrap(df.repartition(7), "y", "s", 80, range_rows=3).collect()}
    for m in METRICS:
        assert again[m] == pytest.approx(got[m], abs=1e-9), m


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.7), (0, 0.7)], "y int, s double")
    got = {r.metric: r for r in bootstrap(df, "y", "s", 20).collect()}
    assert got["roc_auc"].value is None and got["recall"].value is None and got["recall"].low is None
    assert got["alert_rate"].value == pytest.approx(2 / 3) and got["precision"].value == 0
    assert bootstrap(df.where("false"), "y", "s", 20).count() == 0
