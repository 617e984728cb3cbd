"""Additive Holt-Winters by maximum likelihood, for many series and weights at once.

In the innovations form the errors are linear in the states before the first row.  So for given weights the likeliest initial
level, trend and season are a least-squares solution: the recursion runs once over the rows from zero states and once for each
unit state over zeros, all as columns of one array, beside all series and candidate weights.  Only the weights are searched.
"""

from __future__ import annotations

import itertools

import numpy as np

STARTS = {"a": (0.1, 0.3, 0.6), "b": (0.01, 0.1), "g": (0.05, 0.2), "phi": (0.9,)}
LOW, HIGH = np.array([1e-4, 1e-4, 0.0, 0.8]), np.array([0.9999, 0.9999, 0.9999, 0.98])
MEMORY = 16_000_000  # doubles that one pass holds


def starts(season: int, damped: bool) -> np.ndarray:
    """Weights (a, b, g, phi) from which the search begins; b is the share of the level's weight that the trend takes."""
    grid = itertools.product(STARTS["a"], STARTS["b"], STARTS["g"] if season > 1 else (0.0,), STARTS["phi"] if damped else (1.0,))
    return np.array(list(grid))


def paths(rows: np.ndarray, lengths: np.ndarray, weights: np.ndarray, m: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(errors [time, series, candidate, column], last states) for rows [series, time], the longest series first.

    Column 0 follows the rows from zero states; the others follow zeros from a state of one: level, trend, seasons.
    """
    s, c = weights.shape[:2]
    columns = 3 + (m if m > 1 else 0)
    a, b, g, phi = (weights[..., i, None] for i in range(4))
    level, trend, season = np.zeros((s, c, columns)), np.zeros((s, c, columns)), np.zeros((m, s, c, columns))
    level[..., 1], trend[..., 2] = 1.0, 1.0
    if m > 1:
        for k in range(m):
            season[k, ..., 3 + k] = 1.0
    errors = np.zeros((rows.shape[1], s, c, columns))
    for t in range(rows.shape[1]):
        n = int(np.searchsorted(-lengths, -t, "left"))  # series that reach row t
        moved, k = phi[:n] * trend[:n], t % m
        ahead = level[:n] + moved
        e = -(ahead + season[k, :n])
        e[..., 0] += rows[:n, t, None]
        errors[t, :n] = e
        level[:n], trend[:n] = ahead + a[:n] * e, moved + (a[:n] * b[:n]) * e
        if m > 1:
            season[k, :n] += g[:n] * e
    return errors, (level, trend, season)


def initial_states(errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of squared errors [series, candidate], likeliest initial states [series, candidate, column - 1])."""
    by = errors.transpose(1, 2, 0, 3)
    gram = by.transpose(0, 1, 3, 2) @ by
    inner, cross = gram[..., 1:, 1:], gram[..., 1:, 0]
    size = np.trace(inner, axis1=-2, axis2=-1)[..., None, None] / inner.shape[-1]
    state = -np.linalg.solve(inner + 1e-10 * size * np.eye(inner.shape[-1]), cross[..., None])[..., 0]
    left = by[..., 0] + np.einsum("sctj,scj->sct", by[..., 1:], state)
    return (left**2).sum(axis=-1), state


def _likelihood(rows: np.ndarray, lengths: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """Squared errors [series, candidate], in slices that fit the memory."""
    each = max(1, int(MEMORY / (rows.shape[0] * (rows.shape[1] + m) * (3 + m))))
    return np.concatenate([initial_states(paths(rows, lengths, weights[:, i : i + each], m)[0])[0] for i in range(0, weights.shape[1], each)], axis=1)


def search(rows: np.ndarray, lengths: np.ndarray, m: int, damped: bool, rounds: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(weights [series, 4], squared errors): from the best start of each series, single weights and pairs of the
    first three move by a step; a step that helps nothing is halved.  Squared errors never exceed those of the starts."""
    grid = np.repeat(starts(m, damped)[None], len(rows), axis=0)
    sse = _likelihood(rows, lengths, grid, m)
    at = sse.argmin(axis=1)
    best, found = grid[np.arange(len(rows)), at], sse.min(axis=1)
    free = [0, 1, *([2] if m > 1 else []), *([3] if damped else [])]
    moves = [v for i in free for v in (np.eye(4)[i], -np.eye(4)[i])]
    if m > 1:
        moves += [np.array(v, float) for v in ((1, 0, 1, 0), (-1, 0, 1, 0), (1, 0, -1, 0), (-1, 0, -1, 0))]
    moves = np.array(moves) * np.array([1.0, 1.0, 1.0, 0.2])
    step = np.full(len(rows), 0.15)
    for _ in range(rounds):
        tried = np.clip(best[:, None] + step[:, None, None] * moves[None], LOW, HIGH)
        tried[..., 2] = np.minimum(tried[..., 2], 1 - tried[..., 0]) if m > 1 else 0.0
        if not damped:
            tried[..., 3] = 1.0
        sse = _likelihood(rows, lengths, tried, m)
        at, least = sse.argmin(axis=1), sse.min(axis=1)
        better = least < found
        best[better], found[better] = tried[np.arange(len(rows)), at][better], least[better]
        step[~better] /= 2
    return best, found


def aic(sse: np.ndarray, lengths: np.ndarray, m: int, damped: bool) -> np.ndarray:
    return lengths * np.log(np.maximum(sse, 1e-12) / lengths) + 2 * (3 + damped + m)


def fit(series: list[np.ndarray], m: int) -> list[dict]:
    """For each series without gaps: weights, phi, aic, and the level, trend and seasons after its last row; damped or not by AIC."""
    order = sorted(range(len(series)), key=lambda i: -len(series[i]))
    lengths = np.array([len(series[i]) for i in order])
    shift = np.array([series[i].mean() for i in order])
    scale = np.array([series[i].std() or 1.0 for i in order])
    rows = np.zeros((len(order), lengths[0]))
    for j, i in enumerate(order):
        rows[j, : lengths[j]] = (series[i] - shift[j]) / scale[j]
    made: list[dict] = [{} for _ in series]
    for damped in (False, True):
        weights, sse = search(rows, lengths, m, damped)
        scores = aic(sse * scale**2, lengths, m, damped)
        for j, i in enumerate(order):
            if made[i] and scores[j] >= made[i]["aic"]:
                continue
            errors, (level, trend, season) = paths(rows[j : j + 1, : lengths[j]], lengths[j : j + 1], weights[j : j + 1, None], m)
            mix = np.concatenate([[1.0], initial_states(errors)[1][0, 0]])
            a, b, g, phi = weights[j]
            made[i] = {
                "alpha": a, "beta": b, "gamma": g, "phi": phi, "damped": damped, "aic": float(scores[j]), "level": float(level[0, 0] @ mix * scale[j] + shift[j]),
                "trend": float(trend[0, 0] @ mix * scale[j]), "seasons": (season[:, 0, 0] @ mix * scale[j]) if m > 1 else np.zeros(1), "n": int(lengths[j]),
            }
    return made


def ahead(model: dict, horizon: int) -> np.ndarray:
    """The model's forecasts of the next `horizon` rows."""
    steps = np.arange(1, horizon + 1)
    s = model["seasons"]
    return model["level"] + model["trend"] * np.cumsum(model["phi"] ** steps) + s[(model["n"] + steps - 1) % len(s)]
