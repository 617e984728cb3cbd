"""Holt-Winters by likelihood: the recursion, better than a grid, recovered weights, panels of unequal series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import forecast, smoothing


def simulate(rng, n, m, a, b, g, phi=1.0, noise=1.0):
    level, trend, s, out = 50.0, 0.2, 5 * np.sin(2 * np.pi * np.arange(m) / m), []
    for t in range(n):
        e = rng.normal() * noise
        out.append(level + phi * trend + s[t % m] + e)
        level, trend = level + phi * trend + a * e, phi * trend + a * b * e
        s[t % m] += g * e
    return np.array(out)


def errors_from(y, m, a, b, g, phi, level, trend, season):
    """Squared errors, forecasts' states: the recursion as a plain loop from given states."""
    s, sse = np.array(season, float), 0.0
    for t, v in enumerate(y):
        e = v - (level + phi * trend + s[t % m])
        sse += e * e
        level, trend = level + phi * trend + a * e, phi * trend + a * b * e
        s[t % m] += g * e
    return sse, level, trend, s


def test_states_are_the_likeliest(m=4):
    rng = np.random.default_rng(1)
    y = simulate(rng, 60, m, 0.3, 0.1, 0.2)
    w = np.array([[[0.4, 0.2, 0.1, 0.9]]])
    errors, _ = smoothing.paths(y[None], np.array([60]), w, m)
    sse, state = smoothing.initial_states(errors)
    start = state[0, 0]
    plain = errors_from(y, m, 0.4, 0.2, 0.1, 0.9, start[0], start[1], start[2:])[0]
    assert plain == pytest.approx(sse[0, 0], rel=1e-6)
    for _ in range(200):
        other = start + rng.normal(size=len(start)) * 0.3
        assert errors_from(y, m, 0.4, 0.2, 0.1, 0.9, other[0], other[1], other[2:])[0] >= plain * (1 - 1e-9)


def test_never_worse_than_the_grid_and_the_same_alone_or_together():
    rng = np.random.default_rng(2)
    series = [simulate(rng, n, 7, a, 0.1, 0.1, noise=k) for n, a, k in ((30, 0.2, 1), (90, 0.7, 3), (55, 0.05, 0.5), (90, 0.9, 1))]
    series += [np.full(40, 3.0), np.arange(30.0), rng.integers(0, 2, 35).astype(float)]
    together = smoothing.fit(series, 7)
    for y, got in zip(series, together, strict=True):
        alone = smoothing.fit([y], 7)[0]
        assert alone["aic"] == pytest.approx(got["aic"], rel=1e-5, abs=1e-3) or max(alone["aic"], got["aic"]) < -500
        season = y[:7] - y[:7].mean()
        for damped in (False, True):
            for a, b, g, phi in smoothing.starts(7, damped):
                sse = errors_from(y, 7, a, b, g, phi, y[:7].mean(), 0.0, season)[0]
                assert got["aic"] <= smoothing.aic(np.array([sse]), np.array([len(y)]), 7, damped)[0] + 1e-6
        assert np.isfinite(smoothing.ahead(got, 10)).all()


def test_weights_are_recovered():
    rng = np.random.default_rng(3)
    for a, g in ((0.15, 0.05), (0.5, 0.3)):
        got = smoothing.fit([simulate(rng, 1500, 4, a, 0.1, g) for _ in range(6)], 4)
        assert np.median([w["alpha"] for w in got]) == pytest.approx(a, abs=0.06)
        assert np.median([w["gamma"] for w in got]) == pytest.approx(g, abs=0.06)


def test_panel(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{i}", t, float(v)) for i in range(70) for t, v in enumerate(simulate(rng, 60 + i % 5, 4, 0.3, 0.1, 0.2))]
    rows += [("short", t, float(t)) for t in range(5)] + [(None, t, float(10 + t % 4)) for t in range(40)] + [("empty", t, None) for t in range(30)]
    df = spark.createDataFrame(rows, "name string, t int, y double")
    out = forecast.likelihood_smoothing(df, ["name"], "t", "y", 4, 6)
    got = {}
    for r in out.collect():
        got.setdefault(r.name, []).append((r.step, r.forecast))
    assert len(got) == 73 and all(len(v) == 6 for v in got.values())
    assert [f for _, f in sorted(got["short"])] == [1, 2, 3, 4, 1, 2]
    assert [f for _, f in sorted(got[None])] == pytest.approx([10, 11, 12, 13, 10, 11], abs=0.05)
    weights = forecast.smoothing_weights(df, ["name"], "t", "y", 4)
    assert weights.count() == 71 and weights.where("alpha <= 0 OR alpha >= 1 OR gamma > 1 - alpha + 1e-9").count() == 0
    again = forecast.likelihood_smoothing(df.repartition(5).where("name = 's3'"), ["name"], "t", "y", 4, 6).agg(F.sum("forecast")).first()[0]
    assert again == pytest.approx(sum(f for _, f in got["s3"]), rel=1e-3)
    assert forecast.likelihood_smoothing(df.where("false"), ["name"], "t", "y", 4, 6).count() == 0


def test_backtest_against_naive_and_grid():
    """Over 100 series of a fixed season and noise the mean error is below the grid's and the naive's."""
    errors = []
    for seed in range(25):
        rng = np.random.default_rng(seed + 10)
        series = [np.array([20 + i + 5 * np.sin(2 * np.pi * d / 7) + rng.normal() * 0.3 for d in range(140)]) for i in range(4)]
        for y, model in zip(series, smoothing.fit([y[:126] for y in series], 7), strict=True):
            level, trend, phi, s, n = min((forecast.smooth(y[:126], 7, d) for d in (False, True)), key=lambda x: x[0])[1]
            steps = np.arange(1, 15)
            grid = level + trend * np.cumsum(phi**steps) + s[(n + steps - 1) % 7]
            errors.append([np.abs(f - y[126:]).mean() for f in (smoothing.ahead(model, 14), grid, np.tile(y[119:126], 2))])
    likely, grid, naive = np.mean(errors, axis=0)
    assert likely < grid < naive
