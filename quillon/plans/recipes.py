"""Named feature recipes: lists of specs for aggregate_events and entity_features, with the caller's column names."""

from __future__ import annotations

from collections.abc import Callable


def gaps() -> list[dict]:
    return [
        {"name": "gap_mean", "agg": "mean", "column": "_gap"},
        {"name": "gap_median", "agg": "median", "column": "_gap"},
        {"name": "gap_max", "agg": "max", "column": "_gap"},
        {"name": "gap_cv", "agg": "cv", "column": "_gap"},
        {"name": "gap_periodicity", "agg": "periodicity", "column": "_gap"},
        {"name": "gap_below_10s", "agg": "below", "column": "_gap", "value": 10},
        {"name": "recency_days", "agg": "recency_days"},
        {"name": "span_days", "agg": "span_days"},
    ]


def rhythm() -> list[dict]:
    return [
        {"name": "hour_entropy", "agg": "entropy", "column": "_hour"},
        {"name": "night_share", "agg": "share", "where": "_hour < 6"},
        {"name": "weekend_share", "agg": "share", "where": "_dow >= 5"},
        {"name": "active_days", "agg": "nunique", "column": "_day"},
    ]


def counterparties(other: str, inbound: str | None = None) -> list[dict]:
    out = [{"name": f"{other}_{k}", "agg": k, "column": other} for k in ("nunique", "top_share", "entropy")]
    return out + ([{"name": "inbound_share", "agg": "share", "where": inbound}] if inbound else [])


def outcomes(duration: str, answered: str, cause: str | None = None) -> list[dict]:
    out = [
        {"name": "unanswered_share", "agg": "share", "where": f"NOT ({answered})"},
        {"name": "duration_mean", "agg": "mean", "column": duration, "where": answered},
        {"name": "duration_cv", "agg": "cv", "column": duration, "where": answered},
    ]
    return out + ([{"name": "cause_top_share", "agg": "top_share", "column": cause}] if cause else [])


def mobility(place: str, premium: str | None = None, volume: str | None = None) -> list[dict]:
    out = [{"name": f"{place}_{k}", "agg": k, "column": place} for k in ("nunique", "top_share", "entropy")]
    out += [{"name": "premium_share", "agg": "share", "where": premium}] if premium else []
    return out + ([{"name": f"{volume}_cv", "agg": "cv", "column": volume}, {"name": f"{volume}_periodicity", "agg": "periodicity", "column": volume}] if volume else [])


def pairing(other: str) -> list[dict]:
    return [{"name": f"{other}_nunique", "agg": "nunique", "column": other}]


def baseline(amount: str) -> list[dict]:
    """Window specs: own baseline, trend and velocity."""
    return [
        {"name": f"{amount}_vs_7d", "op": "vs_roll_mean", "column": amount, "window": "7D"},
        {"name": f"{amount}_change", "op": "pct_change", "column": amount},
        {"name": f"{amount}_std_90d", "op": "roll_std", "column": amount, "window": "90D"},
        {"name": "n_1h", "op": "roll_count", "window": "1h"},
        {"name": "n_24h", "op": "roll_count", "window": "24h"},
        {"name": "gap_prev", "op": "gap_prev"},
    ]


def fraud(amount: str, payee: str, device: str | None = None) -> list[dict]:
    """Window specs: amount against own month, velocity, new counterparties."""
    out = [
        {"name": f"{amount}_vs_30d", "op": "vs_roll_mean", "column": amount, "window": "30D"},
        {"name": "n_1h", "op": "roll_count", "window": "1h"},
        {"name": f"{amount}_24h", "op": "roll_sum", "column": amount, "window": "24h"},
        {"name": f"{payee}_seen", "op": "prior_count", "column": payee},
    ]
    return out + ([{"name": f"{device}_seen", "op": "prior_count", "column": device}] if device else [])


def credit(late: str, on_time: str, used: str) -> list[dict]:
    """Window specs: time since delinquency, unbroken payments, utilisation trend."""
    return [
        {"name": "since_late", "op": "since", "column": late},
        {"name": "on_time_streak", "op": "streak", "column": on_time},
        {"name": f"{used}_vs_3", "op": "vs_roll_mean", "column": used, "n": 3},
    ]


RECIPES: dict[str, Callable[..., list[dict]]] = {f.__name__: f for f in (gaps, rhythm, counterparties, outcomes, mobility, pairing, baseline, fraud, credit)}


def recipe(name: str, **columns: str) -> list[dict]:
    """The specs of a recipe for the given columns."""
    return RECIPES[name](**columns)
