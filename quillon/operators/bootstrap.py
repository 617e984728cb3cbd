"""Bootstrap intervals of binary metrics by Poisson weights, one row of sums for each range of scores and no row for each score and resample."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import discard, materialise

PRIME = 2**31 - 1
EXACT = 30  # means below it are drawn from the distribution function, others from the normal one
SUMS = ("pos", "neg", "inner", "brier", "tp", "fp")
METRICS = ("precision", "recall", "f1", "alert_rate", "brier", "roc_auc", "average_precision")


def uniform(place: np.ndarray, resample: np.ndarray, tag: int, seed: int) -> np.ndarray:
    """Numbers between 0 and 1 for places (down) and resamples (across), from whole-number arithmetic that SQL repeats."""
    p, b = place.astype(np.int64)[:, None], resample.astype(np.int64)[None, :]
    x = (p % PRIME + 48_271 * b + 1_000_003 * tag + seed) % PRIME
    for add in (b, tag, 16_807):
        x = (x * x + 48_271 * x + add) % PRIME
    return (x + 0.5) / PRIME


def _distributions() -> np.ndarray:
    k, x = np.arange(EXACT)[:, None].astype(float), np.arange(120)
    log = np.array([math.lgamma(v + 1) for v in x])
    return np.cumsum(np.exp(-k + x * np.log(np.maximum(k, 1e-300)) - log), axis=1)


def draws(mean: np.ndarray, place: np.ndarray, resamples: int, tag: int, seed: int) -> np.ndarray:
    """Poisson weights of whole means for each place and resample; resample 0 has the means themselves."""
    b, cdf = np.arange(resamples + 1), _distributions()
    u = uniform(place, b, tag, seed)
    out = np.zeros(u.shape)
    for k in np.unique(mean[(mean > 0) & (mean < EXACT)]):
        rows = mean == k
        out[rows] = np.searchsorted(cdf[int(k)], u[rows], "left")
    rows = mean >= EXACT
    if rows.any():
        k, v = mean[rows].astype(float)[:, None], uniform(place[rows], b, tag + 1, seed)
        out[rows] = np.maximum(0, np.floor(k + np.sqrt(k) * np.sqrt(-2 * np.log(u[rows])) * np.cos(2 * math.pi * v) + 0.5))
    out[:, 0] = mean
    return out


def _slices(rows: pd.DataFrame, start: int, resamples: int, seed: int, size: int = 2_000):
    """(scores, positives, negatives) of slices of a range from its greatest score down, weights drawn."""
    rows = rows.sort_values("score", ascending=False)
    place = start + len(rows) - 1 - np.arange(len(rows))
    for i in range(0, len(rows), size):
        part, at = rows.iloc[i : i + size], place[i : i + size]
        yield part["score"].to_numpy(float), draws(part["pos"].to_numpy(), at, resamples, 1, seed), draws(part["neg"].to_numpy(), at, resamples, 3, seed)


def bootstrap(df: DataFrame, label: str, score: str, resamples: int = 500, seed: int = 42, threshold: float = 0.5, range_rows: int = 1_000_000) -> DataFrame:
    """(metric, value, low, high): precision, recall, F1 and alert rate at the threshold, Brier score, ROC AUC and average
    precision on all rows, with their 95 % percentile intervals from Poisson resampling.

    Rows are counted by distinct score; the weight of a score's positives or negatives in a resample is one Poisson draw of
    their number, made from the score's place in ascending order, so any partitioning gives the same.  Each range of at most
    about `range_rows` scores gives one row of sums for all resamples; what stands above a range is added up over the ranges,
    and a second pass reads average precision off it.  Rows without a label or score are left out; a metric that no
    resample defines is null, and no rows at all give none.
    """
    spark = df.sparkSession
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )
    counts = materialise(counts, "counts")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(counts.count() / range_rows))
    ranged = materialise(counts.repartitionByRange(parts, "score").withColumn("_part", F.spark_partition_id()), "ranges")
    discard(counts)
    earlier = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))

    def sums(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        total = {c: np.zeros(resamples + 1) for c in SUMS}
        for s, p, n in _slices(rows, int(start["_start"].iloc[0]), resamples, seed):
            above = total["pos"] + np.cumsum(p, axis=0) - p / 2
            total["inner"] += (n * above).sum(axis=0)
            total["brier"] += (p * ((1 - s) ** 2)[:, None] + n * (s**2)[:, None]).sum(axis=0)
            total["tp"] += p[s >= threshold].sum(axis=0)
            total["fp"] += n[s >= threshold].sum(axis=0)
            total["pos"] += p.sum(axis=0)
            total["neg"] += n.sum(axis=0)
        return pd.DataFrame([{"_part": rows["_part"].iloc[0], "_start": start["_start"].iloc[0]} | {c: v.tolist() for c, v in total.items()}])

    arrays = ", ".join(f"{c} array<double>" for c in SUMS)
    first = materialise(ranged.groupBy("_part").cogroup(starts.groupBy("_part")).applyInPandas(sums, f"_part int, _start long, {arrays}"), "sums")
    each = first.select("_part", "_start", F.posexplode(F.arrays_zip(*SUMS)).alias("b", "x")).select("_part", "_start", "b", "x.*")
    higher = Window.partitionBy("b").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({f"_{c}": F.coalesce(F.sum(c).over(higher), F.lit(0.0)) for c in ("pos", "neg")})
    offsets = each.groupBy("_part", "_start").agg(F.sort_array(F.collect_list(F.struct("b", "_pos", "_neg"))).alias("_o"))
    offsets = offsets.select("_part", "_start", F.col("_o._pos").alias("_pos"), F.col("_o._neg").alias("_neg"))

    def precise(rows: pd.DataFrame, offset: pd.DataFrame) -> pd.DataFrame:
        tp, fp = (np.array(offset[c].iloc[0], float) for c in ("_pos", "_neg"))
        total = np.zeros(resamples + 1)
        for _, p, n in _slices(rows, int(offset["_start"].iloc[0]), resamples, seed):
            t, f = tp + np.cumsum(p, axis=0), fp + np.cumsum(n, axis=0)
            total += (p * t / np.maximum(t + f, 1)).sum(axis=0)
            tp, fp = t[-1], f[-1]
        return pd.DataFrame([{"ap": total.tolist()}])

    second = ranged.groupBy("_part").cogroup(offsets.groupBy("_part")).applyInPandas(precise, "ap array<double>")
    ap = second.select(F.posexplode("ap").alias("b", "ap")).groupBy("b").agg(F.sum("ap").alias("ap"))
    per = each.groupBy("b").agg(F.sum(F.col("inner") + F.col("neg") * F.col("_pos")).alias("u"), *(F.sum(c).alias(c) for c in SUMS if c != "inner")).join(ap, "b")
    rows, said = F.col("pos") + F.col("neg"), F.col("tp") + F.col("fp")
    made = {
        "precision": F.try_divide("tp", said), "recall": F.try_divide("tp", F.col("pos")), "f1": F.try_divide(2 * F.col("tp"), said + F.col("pos")),
        "alert_rate": F.try_divide(said, rows), "brier": F.try_divide("brier", rows), "roc_auc": F.try_divide("u", F.col("pos") * F.col("neg")), "average_precision": F.try_divide("ap", F.col("pos")),
    }
    long = per.select("b", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), made[m].alias("x")) for m in METRICS))).alias("m")).select("b", "m.*")
    again = F.when(F.col("b") > 0, F.col("x"))
    return long.groupBy("metric").agg(F.max(F.when(F.col("b") == 0, F.col("x"))).alias("value"), *(F.percentile(again, F.lit(q)).alias(c) for c, q in (("low", 0.025), ("high", 0.975))))
