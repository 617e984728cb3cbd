"""Running sums, exact quantiles and ranks over any number of distinct values, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.basics import stacked
from quillon.session import materialise


def running(counts: DataFrame, order: str, sums: list[str], keys: list[str] | None = None) -> DataFrame:
    """Adds, for each column c of sums, c_before (the sum over the rows of the keys' group that come before in ascending
    order) and c_all (the group's sum); rows of a group must differ in `order`.

    Rows are range-partitioned by keys and order and written, so that the ranges stay as they are; sums inside a range are
    offset by those of the ranges before it, of which there is one row for each range and group.
    """
    keys = keys or []
    ranged = materialise(counts.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_part", *keys).agg(*(F.sum(c).alias(f"_s_{c}") for c in sums))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    offsets = totals.select(
        F.col("_part").alias("_o_part"), *(F.col(k).alias(f"_o_{k}") for k in keys),
        *(F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums), *(F.sum(f"_s_{c}").over(every).alias(f"{c}_all") for c in sums),
    )
    inside = Window.partitionBy("_part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"_l_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    same = local["_part"] == offsets["_o_part"]
    for k in keys:
        same &= local[k].eqNullSafe(offsets[f"_o_{k}"])
    joined = local.join(offsets, same)
    return joined.select(*counts.columns, *((F.col(f"_l_{c}") + F.col(f"_b_{c}")).alias(f"{c}_before") for c in sums), *(f"{c}_all" for c in sums))


def quantiles(values: DataFrame, probabilities: list[float], keys: list[str], value: str = "value") -> DataFrame:
    """(keys, q array, n): the exact quantiles of the non-null values of each group, linear between neighbours, as percentile() gives them.

    Values are counted first; each quantile is then read off the two values that cover its place.
    """
    v = F.col(value).cast("double")
    counts = values.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n"))
    placed = running(counts, "_v", ["_n"], keys)
    made = []
    for i, p in enumerate(probabilities):
        at = F.lit(p) * (F.col("_n_all") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            covers = (F.col("_n_before") <= place) & (place < F.col("_n_before") + F.col("_n"))
            made.append(F.max(F.when(covers, F.col("_v"))).alias(f"_{side}{i}"))
    out = placed.groupBy(*keys).agg(F.max("_n_all").alias("n"), *made)
    read = []
    for i, p in enumerate(probabilities):
        at = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        read.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi))
    return out.select(*keys, F.array(*read).alias("q"), "n")


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, column_name, q array, n) of several columns in one pass."""
    return quantiles(stacked(df, columns, keys or []), probabilities, [*(keys or []), "column_name"])


def column_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the median of each column under its name (null where it has no value)."""
    found = column_quantiles(df, columns, [0.5])
    return found.agg(*(F.max(F.when(F.col("column_name") == c, F.col("q")[0])).alias(c) for c in columns))


def average_ranks(df: DataFrame, column: str, name: str, share: bool = False) -> DataFrame:
    """Adds each row's average rank (of n, if `share`) among the non-null values of the column; rows without one are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    rank = F.col("_n_before") + (F.col("_n") + 1) / 2.0
    ranks = running(counts, "_v", ["_n"]).select("_v", (rank / F.col("_n_all") if share else rank).alias(name))
    return df.join(ranks, df[column] == ranks["_v"]).drop("_v")
