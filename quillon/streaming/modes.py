"""Streaming modes of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.functions.basics import holds, span, stacked
from quillon.operators.aggregates import REGISTERED, expression
from quillon.operators.drift import _binned, _shares, psi_sum, quantile_edges, severity
from quillon.session import discard, materialise


def stream_aggregates(df: DataFrame, entity: str, time: str, features: list[dict], period: str, late: str = "1 hour") -> DataFrame:
    """Per entity and period, the aggregates that need no second pass, with rows later than `late` left out.

    A feature is {name, agg, column, where} with agg count, share, sum, mean, std, min, max, cv, span_days or a registered one.
    """
    base = df.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    made = []
    for s in features:
        hit = holds(s.get("where"))
        x = F.when(hit, F.col(s["column"])) if s.get("column") else None
        t = F.when(hit, F.unix_micros("_at"))
        if s["agg"] in REGISTERED:
            made.append(expression(s["agg"], x, hit, t).alias(s["name"]))
            continue
        made.append(
            {
                "count": lambda: F.count_if(hit), "share": lambda: F.avg(hit.cast("double")), "sum": lambda: F.coalesce(F.sum(x), F.lit(0)), "mean": lambda: F.avg(x),
                "std": lambda: F.stddev_samp(x), "min": lambda: F.min(x), "max": lambda: F.max(x), "cv": lambda: F.stddev_samp(x) / (F.abs(F.avg(x)) + 1e-9),
                "span_days": lambda: (F.max(t) - F.min(t)) / span("D"),
            }[s["agg"]]().alias(s["name"])
        )
    out = base.groupBy(F.window("_at", f"{span(period) // 1_000_000} seconds"), entity).agg(F.count("*").alias("n_events"), *made)
    return out.select(entity, F.col("window.start").alias("period_start"), "n_events", *(s["name"] for s in features))


def score_stream(df: DataFrame, transform, path: str, checkpoint: str):
    """Scores a stream with transform(rows) and appends it to a table; returns the started query."""
    return transform(df).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).start(path)


def drift_stream(df: DataFrame, reference: DataFrame, column: str, time: str, period: str, path: str, checkpoint: str):
    """Keeps (period, psi, n) of a text column, for each period over all its rows so far, against the reference's shares.

    Counts per period and value are the stream's state; each trigger writes the whole small table anew, so a repeated batch
    changes nothing.
    """
    shares = reference.where(F.col(column).isNotNull()).groupBy(column).count()
    total = shares.agg(F.sum("count")).first()[0]
    shares = shares.select(F.col(column).alias("v"), (F.col("count") / total).alias("a"))

    def batch(counts: DataFrame, _: int) -> None:
        n = counts.groupBy("period").agg(F.sum("count").alias("n"))
        grid = n.crossJoin(shares).join(counts, ["period", "v"], "full").fillna(0.0, ["a"])
        grid = grid.drop("n").join(n, "period").withColumn("b", F.coalesce("count", F.lit(0)) / F.col("n"))
        grid.groupBy("period").agg(psi_sum(F.col("a"), F.col("b")).alias("psi"), F.max("n").alias("n")).write.mode("overwrite").parquet(path)

    counts = df.groupBy(F.date_trunc(period, F.col(time).cast("timestamp")).alias("period"), F.col(column).alias("v")).count()
    return counts.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def numeric_drift_stream(
    df: DataFrame, reference: DataFrame, columns: list[str], time: str, period: str, path: str, checkpoint: str, late: str = "1 hour", bins: int = 10, least: int = 100
):
    """Appends (period, column_name, psi, n_cur, severity) of number columns once a period is over, as drift_over_time gives them
    for the periods with `least` rows or more; returns the started query.

    The state holds a count for each open period, column and bin of the reference's quantiles, however many rows and values
    there are; tasks count before the shuffle.  A period closes when the watermark, `late` behind the latest row, passes its
    end: its counts leave the state in one batch, and rows that come later are left out.  Each batch writes a folder of its
    own, so a repeated one changes nothing.  Rows without a time are left out, missing values count as rows only.
    """
    spark = reference.sparkSession
    edges = quantile_edges(reference, columns, bins)
    shares = _shares(_binned(reference, columns, edges, []), [], "ref").select("column_name", "bin", "share_ref").collect()  # at most `bins` rows a column
    found = {r.column_name: list(r.edges) for r in edges.collect()}
    known = {(r.column_name, r.bin): r.share_ref for r in shares}
    grid = spark.createDataFrame([(c, b, known.get((c, b), 0.0)) for c in columns for b in range(len(found[c]) + 1)], "column_name string, bin int, share_ref double")
    cuts = spark.createDataFrame([*found.items(), ("_rows", [])], "column_name string, edges array<double>")

    def batch(closed: DataFrame, number: int) -> None:
        counts = materialise(closed, "closed")  # read three times; the stream's own work is done once
        rows = counts.where("column_name = '_rows'").groupBy("period").agg(F.sum("n").alias("_rows")).where(F.col("_rows") >= least).select("period")
        held = counts.where("column_name != '_rows'").join(rows, "period")
        cur = _shares(held, ["period"], "cur")
        periods = held.select("period", "column_name").distinct()
        every = periods.join(F.broadcast(grid), "column_name").join(cur, ["period", "column_name", "bin"], "left").fillna(0, ["share_cur"])  # a few rows for each column
        out = every.groupBy("period", "column_name").agg(psi_sum(F.col("share_ref"), F.col("share_cur")).alias("psi"), F.max("n_cur").alias("n_cur"))
        out.withColumn("severity", severity(F.col("psi"), F.lit(0.0))).write.mode("overwrite").parquet(f"{path}/batch={number}")
        discard(counts)

    base = df.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late).withColumn("_rows", F.lit(0.0))
    long = stacked(base, [*columns, "_rows"], ["_at"]).where("value IS NOT NULL AND NOT isnan(value)").join(F.broadcast(cuts), "column_name")  # one row for each column
    at = F.size(F.filter("edges", lambda e: e <= F.col("value"))).alias("bin")
    counts = long.groupBy(F.window("_at", f"{span(period) // 1_000_000} seconds"), "column_name", at).agg(F.count("*").alias("n"))
    counts = counts.select(F.col("window.start").alias("period"), "column_name", "bin", "n")
    return counts.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def velocity_stream(df: DataFrame, entity: str, time: str, key: str, window: str, late: str = "1 hour") -> DataFrame:
    """(entity, key, n): for each event, the entity's events in [t - window, t); the state holds times of one window only.

    Events that arrive after later ones of their entity count those already seen; those later than `late` are left out.
    An entity's state goes once the watermark is a window past its last event.
    """
    width = span(window)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def count(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = np.array(state.get[0] if state.exists else [], np.int64)
        for pdf in frames:
            pdf = pdf.sort_values(["_us", key])
            t = pdf["_us"].to_numpy(np.int64)
            n = sum(np.searchsorted(s, t, "left") - np.searchsorted(s, t - width, "left") for s in (times, t))
            times = np.sort(np.concatenate([times, t]))
            times = times[times >= times[-1] - width]
            yield pd.DataFrame({entity: [group[0]] * len(pdf), key: pdf[key], "n": n.astype("int64")})
        state.update((times.tolist(),))
        state.setTimeoutTimestamp(max(int(times[-1] + width) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    base = df.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late).withColumn("_us", F.unix_micros("_at")).select(entity, key, "_at", "_us")
    return base.groupBy(entity).applyInPandasWithState(count, f"{entity} {kinds[entity]}, {key} {kinds[key]}, n long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
