"""Aggregates registered by name: partial aggregates of the rows, how two of them merge, and the value read off them.

A registered aggregate works in aggregate_events (batch) and stream_aggregates alike, in the one shuffle of the others, and
its partials may be kept per period and merged into longer periods without the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.basics import holds, micros, span

MERGES = {"sum": F.sum, "min": F.min, "max": F.max, "or": F.bool_or, "and": F.bool_and}


@dataclass(frozen=True)
class Aggregate:
    """`partials` maps a name to (aggregate of a row's value, merge); `final` reads the value off the merged partials.

    A partial is made from (x, hit, t): the value where the row counts, else null; whether it counts; its time in micros,
    null where it doesn't.
    """

    partials: dict[str, tuple[Callable[[Column, Column, Column], Column], str]]
    final: Callable[[dict[str, Column]], Column]
    column: bool = True


REGISTERED: dict[str, Aggregate] = {}
BUILT_IN = ("count", "share", "sum", "mean", "median", "std", "min", "max", "nunique", "cv", "below", "span_days", "recency_days", "entropy", "top_share", "periodicity")


def register(name: str, partials: dict[str, tuple[Callable[[Column, Column, Column], Column], str]], final: Callable[[dict[str, Column]], Column], column: bool = True) -> None:
    """Makes an aggregate known by name; `column` says whether a feature of it names one.  Names of the library's own, and
    merges other than sum, min, max, or, and, are refused; registering a name again replaces it."""
    if name in BUILT_IN:
        raise ValueError(f"{name} is an aggregate of the library")
    wrong = [m for _, m in partials.values() if m not in MERGES]
    if wrong or not partials:
        raise ValueError(f"{name}: a partial merges by one of {', '.join(MERGES)}")
    REGISTERED[name] = Aggregate(dict(partials), final, column)


def unregister(name: str) -> None:
    REGISTERED.pop(name, None)


def expression(name: str, x: Column | None, hit: Column, t: Column) -> Column:
    """The registered aggregate as one expression over rows."""
    made = REGISTERED[name]
    return made.final({k: part(x, hit, t) for k, (part, _) in made.partials.items()})


def partial_rows(df: DataFrame, entity: str, time: str, features: list[dict], period: str) -> DataFrame:
    """(entity, period_start, n_events, feature__partial ...): the partials of registered features {name, agg, column, where}
    per entity and period; rows without an entity or time are left out.  Append new periods to those kept before."""
    base = df.withColumn("_t", micros(df, time)).where(F.col("_t").isNotNull() & F.col(entity).isNotNull())
    size, made = span(period), []
    for s in features:
        hit = holds(s.get("where"))
        x = F.when(hit, F.col(s["column"])) if s.get("column") else None
        made += [part(x, hit, F.when(hit, F.col("_t"))).alias(f"{s['name']}__{k}") for k, (part, _) in REGISTERED[s["agg"]].partials.items()]
    start = F.timestamp_micros(F.floor(F.col("_t") / size) * size).alias("period_start")
    return base.groupBy(entity, start).agg(F.count("*").alias("n_events"), *made)


def merged(partials: DataFrame, keys: list[str], features: list[dict]) -> DataFrame:
    """(keys, n_events, features) from rows of partial_rows, of any number of periods or parts of one."""
    made = []
    for s in features:
        a = REGISTERED[s["agg"]]
        made.append(a.final({k: MERGES[how](f"{s['name']}__{k}") for k, (_, how) in a.partials.items()}).alias(s["name"]))
    return partials.groupBy(*keys).agg(F.sum("n_events").alias("n_events"), *made)
