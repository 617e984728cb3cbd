"""Density-based groups (DBSCAN) over grid cells, without a table of neighbour pairs."""

from __future__ import annotations

from itertools import product
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.graph import components
from quillon.session import discard, materialise

#: Points of a cell that meet in one task, and core points of a cell that are tried first as links to its neighbours.
BLOCK, TRIED = 20_000, 32
#: Distances that are held at once.
HELD = 1 << 21


def _near(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which of x and y are within eps of each other."""
    return sum((x[:, None, c] - y[None, :, c]) ** 2 for c in range(x.shape[1])) <= eps * eps


def _slices(n: int, other: int):
    step = max(1, HELD // max(1, other))
    return (slice(i, i + step) for i in range(0, n, step))


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float, min_samples: int) -> DataFrame:
    """(key, segment): dense groups by the least key of their core rows, -1 for noise; a border row joins its least group.

    A row is core if at least min_samples rows, itself included, are within eps.  Cells have a side of eps / sqrt(columns), so all rows
    of a cell are within eps: a cell of min_samples rows is core at once, and core rows of a cell are one group.  Only
    rows of thinner cells are compared, with the cells around.  Cells, not rows, are the nodes that are linked: a few core
    rows of each are tried first, and whole cells are compared only where that leaves different groups.  Equal rows are one
    point.  Cells are dealt to blocks, so one cell may hold any share of the rows.  Rows with a missing value are noise.
    """
    d = len(columns)
    side, reach = eps / sqrt(d), ceil(sqrt(d))
    names, at = [f"x{i}" for i in range(d)], [f"c{i}" for i in range(d)]
    value = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    rows = df.select(F.col(key).alias("k"), *(v.alias(n) for v, n in zip(value, names, strict=True)))
    known = rows.dropna(subset=names)
    points = known.groupBy(*names).agg(F.count("*").alias("w"), F.min("k").alias("k"))
    points = points.withColumns({c: F.floor(F.col(n) / side) for c, n in zip(at, names, strict=True)})
    points = materialise(points.withColumn("p", F.monotonically_increasing_id()), "points")
    cells = points.groupBy(*at).agg(F.sum("w").alias("rows"), F.count("*").alias("n"))
    cells = materialise(cells.withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")), "cells")
    steps = [s for s in product(range(-reach, reach + 1), repeat=d) if sum(max(0, abs(v) - 1) ** 2 for v in s) * side * side <= eps * eps * (1 + 1e-9)]
    around = F.explode(F.array(*(F.array(*(F.lit(v).cast("long") for v in s)) for s in steps)))

    def moved(frame: DataFrame) -> DataFrame:
        """The rows of frame for each cell around theirs, with its place in at and their own in from_."""
        out = frame.withColumn("_s", around)
        return out.withColumns({f"from_{c}": F.col(c) for c in at} | {c: F.col(c) + F.col("_s")[i] for i, c in enumerate(at)}).drop("_s")

    def asked(who: DataFrame, whom: DataFrame, blocks: DataFrame, answer, schema: str) -> DataFrame:
        """answer(rows of who, rows of whom) for each block of each cell that rows of who look into."""
        left = moved(who).join(blocks.select(*at, "blocks"), at).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = whom.join(blocks.select(*at, "blocks"), at).withColumn("block", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int")).drop("blocks")
        right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of their own, as both may come from one table
        by = [*at, "block"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(answer, schema)

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, w, n = a[names].to_numpy(float), b[names].to_numpy(float), b["w"].to_numpy(), np.zeros(len(a), np.int64)
        for s in _slices(len(x), len(y)) if len(y) else ():
            n[s] = _near(x[s], y, eps) @ w
        return pd.DataFrame({"p": a["p"], "n": n})

    full = cells.where(F.col("rows") >= min_samples).select(*at)
    thin = points.join(full, at, "left_anti")
    counts = asked(thin.select("p", *names, *at), points.select("p", "w", *names, *at), cells, count, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
    dense = materialise(counts.where(F.col("n") >= min_samples).select("p"), "dense")
    core = materialise(points.join(full, at, "left_semi").unionByName(points.join(dense, "p", "left_semi").select(*points.columns)), "core")
    nodes = core.groupBy(*at).agg(F.min("k").alias("least"), F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    held = materialise(core.join(nodes.select(*at, "node"), at), "held")

    def link(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = set()
        if len(a) and len(b):
            y, v = b[names].to_numpy(float), int(b["node"].iloc[0])
            low, high = y.min(0), y.max(0)
            for u, part in a.groupby("node"):
                x = part[names].to_numpy(float)
                gap = np.maximum(np.maximum(low - x, x - high), 0)
                x = x[(gap**2).sum(1) <= eps * eps]  # farther from all of the block
                if any(_near(x[s], y, eps).any() for s in _slices(len(x), len(y))):
                    found.add((int(u), v))
        return pd.DataFrame(sorted(found), columns=["u", "v"], dtype="int64")

    ahead = F.struct(*(F.col(f"from_{c}") for c in at)) < F.struct(*(F.col(c) for c in at))
    draw = F.pmod(F.xxhash64("p"), F.lit(TRIED))
    tried = held.groupBy("node", *at, draw.alias("draw")).agg(F.min(F.struct("p", *names)).alias("t")).select("node", *at, "t.*")
    discard(dense)
    one = nodes.withColumn("blocks", F.lit(1))
    links = materialise(asked(tried, tried, one, link, "u long, v long").where("u != v").distinct(), "tried")
    group = components(links).withColumnRenamed("node", "u").withColumnRenamed("component", "g")
    named = materialise(nodes.join(group, nodes["node"] == group["u"], "left").select(*at, "node", "blocks", "least", F.coalesce("g", "node").alias("g")), "named")
    pairs = moved(named.select("node", "g", *at)).join(named.select(*at, F.col("node").alias("other"), F.col("g").alias("h")), at).where(F.col("g") != F.col("h")).where(ahead)
    open_ = materialise(pairs.select("node", "other"), "open")
    found = group.select(F.col("u").alias("node"), F.col("g").alias("component"))
    if not open_.isEmpty():
        asking = held.join(open_.select("node").distinct(), "node", "left_semi")
        asked_of = held.join(open_.select(F.col("other").alias("node")).distinct(), "node", "left_semi")
        more = asked(asking.select("p", "node", *names, *at), asked_of.select("p", "node", *names, *at), named, link, "u long, v long").where("u != v").distinct()
        found = components(links.unionByName(more))
    grouped = named.join(found.withColumnRenamed("node", "u"), named["node"] == F.col("u"), "left").withColumn("g2", F.coalesce("component", "node"))
    least = grouped.groupBy("g2").agg(F.min("least").alias("segment"))
    label = materialise(grouped.join(least, "g2").select(*at, "blocks", "segment"), "label")
    border = points.join(core.select("p"), "p", "left_anti")

    def touch(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, hit = a[names].to_numpy(float), b[names].to_numpy(float), np.zeros(len(a), bool)
        for s in _slices(len(x), len(y)) if len(y) else ():
            hit[s] = _near(x[s], y, eps).any(1)
        return pd.DataFrame({"p": a["p"][hit], "segment": b["segment"].iloc[0] if len(b) else 0})

    kind = df.schema[key].dataType.simpleString()
    cored = core.join(label.select(*at, "segment"), at)
    edge = asked(border.select("p", *names, *at), cored.select("p", "segment", *names, *at), label, touch, f"p long, segment {kind}").groupBy("p").agg(F.min("segment").alias("segment"))
    ours = points.join(cored.select("p", "segment").unionByName(edge), "p").select(*names, "segment")
    return rows.join(ours, names, "left").select(F.col("k").alias(key), F.coalesce("segment", F.lit(-1)).alias("segment"))
