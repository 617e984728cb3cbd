"""Conditional quantiles from the leaves of a forest."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ranking import running
from quillon.session import discard, materialise, spread

#: Ranges of labels by which a leaf's rows are counted before those of one range are put in order, and leaves that are broadcast.
RANGES, BROADCAST_LEAVES = 128, 1 << 20


def leaf_rows(model: RandomForestRegressionModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, tree, leaf): the leaf of each row in each tree."""
    leaves = model.copy({model.leafCol: "_leaves", model.predictionCol: ""})
    found = leaves.transform(df.select("features", *keep)).select(*keep, F.posexplode(vector_to_array("_leaves")).alias("tree", "leaf"))
    return found.withColumn("leaf", F.col("leaf").cast("int"))


def leaf_quantiles(model: RandomForestRegressionModel, rows: DataFrame, quantile: float, ranges: int = RANGES) -> DataFrame:
    """(tree, leaf, q): the exact quantile of the labels of each leaf, linear between neighbours, as percentile() gives it.

    Rows are counted by leaf and range of labels, which tells the one or two ranges that hold the places around the
    quantile; only labels of these are counted by value and put in order.  The ranges change the work, not the result.
    """
    cuts = sorted(set(rows.approxQuantile("label", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []) - {math.inf, -math.inf})
    binned = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="label", outputCol="_bin").transform(rows) if cuts else rows.withColumn("_bin", F.lit(0))
    found = leaf_rows(model, binned.withColumn("_bin", F.col("_bin").cast("int")), ["label", "_bin"])
    counts = found.groupBy("tree", "leaf", "_bin").agg(F.count("*").alias("_n"))
    each = Window.partitionBy("tree", "leaf")  # a row for each range
    before = F.coalesce(F.sum("_n").over(each.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("tree", "leaf", "_bin", "_n", before.alias("_skip"), F.sum("_n").over(each).alias("_all"))
    at = F.lit(quantile) * (F.col("_all") - 1)
    holds = lambda place, skip: (skip <= place) & (place < skip + F.col("_n"))
    wanted = materialise(placed.where(holds(F.floor(at), F.col("_skip")) | holds(F.ceil(at), F.col("_skip"))).drop("_n"), "ranges")
    few = model.getNumTrees << model.getMaxDepth() <= BROADCAST_LEAVES
    inside = found.join(F.broadcast(wanted) if few else wanted, ["tree", "leaf", "_bin"])
    # the first of a leaf's ranges tells how many rows come before; ranges between two wanted ones are empty
    values = inside.groupBy("tree", "leaf", "_all", F.col("label").alias("_v")).agg(F.count("*").alias("_n"))
    skipped = wanted.groupBy(F.col("tree").alias("_t"), F.col("leaf").alias("_l")).agg(F.min("_skip").alias("_skip"))
    ordered = running(values, "_v", ["_n"], ["tree", "leaf"])
    same = (ordered["tree"] == skipped["_t"]) & (ordered["leaf"] == skipped["_l"])
    ordered = ordered.join(F.broadcast(skipped) if few else skipped, same).withColumn("_from", F.col("_n_before") + F.col("_skip"))
    value = lambda place: F.max(F.when(holds(place, F.col("_from")), F.col("_v")))
    out = ordered.groupBy("tree", "leaf").agg(F.max("_all").alias("_all"), value(F.floor(at)).alias("_lo"), value(F.ceil(at)).alias("_hi"))
    between = (F.ceil(at) - at) * F.col("_lo") + (at - F.floor(at)) * F.col("_hi")
    return out.select("tree", "leaf", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias("q"))


class QuantileForest:
    """A fitted forest that predicts, for each row, the mean over its trees of the quantile of the training labels in its leaf.

    `table` holds one row, an array for each tree of the quantiles by leaf: at most trees x 2^depth numbers, so scoring is a
    lookup beside the row, without a shuffle or Python.
    """

    def __init__(self, model: RandomForestRegressionModel, table: DataFrame, quantile: float) -> None:
        self.model, self.table, self.quantile = model, table, quantile

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prediction."""
        leaves = self.model.copy({self.model.leafCol: "_leaves", self.model.predictionCol: ""})
        scored = leaves.transform(df).crossJoin(F.broadcast(self.table)).withColumn("_leaves", vector_to_array("_leaves"))
        each = F.transform("_leaves", lambda leaf, tree: F.get(F.get("_quantiles", tree), leaf.cast("int")))
        mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size("_leaves")
        return scored.withColumn("prediction", mean).drop("_leaves", "_quantiles")


def quantile_forest(train: DataFrame, quantile: float, seed: int = 42, numTrees: int = 20, maxDepth: int = 8, minInstancesPerNode: int = 40, **params) -> QuantileForest:
    """A quantile forest of rows (features, label).

    Each leaf's quantile is exact (leaf_quantiles), and a leaf may hold any share of the rows.  Rows without a label are left
    out; no rows with one raise, as a forest needs them.
    """
    if maxDepth > 16 or numTrees > 500:
        raise ValueError("at most 500 trees of depth 16: the leaves' table goes to every task")
    rows = materialise(train.where(F.col("label").isNotNull()).select("features", F.col("label").cast("double").alias("label")), "train")
    model = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=numTrees, maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode, seed=seed, **params).fit(spread(rows))
    found = leaf_quantiles(model, rows, quantile)
    # leaves are numbered from 0 without gaps, as every leaf holds training rows
    each = found.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("leaf", "q")))["q"].alias("q"))
    table = each.agg(F.sort_array(F.collect_list(F.struct("tree", "q")))["q"].alias("_quantiles"))
    table = materialise(table, "leaves")
    discard(rows)
    return QuantileForest(model, table, quantile)
