"""Windows over blocks of an entity's rows give the rows of one window for each entity."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks
from quillon.operators.events import entity_features, features_at_decisions

OPS = [{"name": f"r_{k}", "op": f"roll_{k}", "column": "v", "n": 7} for k in ("mean", "std", "min", "max", "sum")]
OPS += [{"name": f"t_{k}", "op": f"roll_{k}", "column": "v", "window": "2h"} for k in ("mean", "std", "min", "max", "sum", "count")]
OPS += [{"name": f"w_{k}", "op": f"roll_{k}", "column": "v", "window": "3D"} for k in ("mean", "std", "min", "max", "sum", "count")]
OPS += [{"name": "vs_t", "op": "vs_roll_mean", "column": "v", "window": "3D"}, {"name": "vs_r", "op": "vs_roll_mean", "column": "v", "n": 3}]
OPS += [{"name": "lag9", "op": "lag", "column": "kind", "n": 9}, {"name": "d", "op": "diff", "column": "v", "n": 2}, {"name": "p", "op": "pct_change", "column": "v"}, {"name": "gap", "op": "gap_prev"}]
OPS += [{"name": "since", "op": "since", "column": "v"}, {"name": "before", "op": "prior_count", "column": "kind"}, {"name": "run", "op": "streak", "column": "v"}]
OPS += [{"name": "lag_of_mean", "op": "lag", "column": "t_mean", "n": 2}, {"name": "mean_of_lag", "op": "roll_mean", "column": "lag_of_mean", "window": "5h"}, {"name": "v", "op": "lag", "column": "v"}]


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7)
    return a == b


def same(left, right, key):
    a, b = (sorted((tuple(r) for r in x.collect()), key=lambda r: r[left.columns.index(key)]) for x in (left, right))
    assert left.columns == right.columns and left.dtypes == right.dtypes and len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for name, p, q in zip(left.columns, x, y, strict=True):
            assert close(p, q), (name, x, y)


@pytest.fixture(scope="module")
def rows(spark):
    """A hot entity, a null one, small ones; rows at the same time, without a time, without a value, bursts and breaks."""
    rng, out, t = random.Random(5), [], 1_700_000_000
    for i in range(900):
        t += rng.choice([0, 0, 60, 300, 3000, 20_000])
        who = rng.choice(["hot", "hot", "hot", "hot", None, "b", f"s{i % 40}"])
        out.append((i, who, None if rng.random() < 0.02 else t, rng.choice(["x", "y", None]), None if rng.random() < 0.1 else round(rng.uniform(-1, 5), 3)))
    df = spark.createDataFrame(out, "id long, who string, sec long, kind string, v double")
    return df.select("id", "who", F.timestamp_seconds("sec").alias("ts"), "kind", "v").cache()


@pytest.mark.parametrize("size", [9, 60])
def test_entity_features_in_blocks(rows, size):
    whole = entity_features(rows, "who", "ts", OPS, order=["id"])
    same(entity_features(rows, "who", "ts", OPS, order=["id"], split_rows=size), whole, "id")


def test_integer_times_and_columns(rows):
    df = rows.select("id", "who", F.col("id").alias("month"), (F.col("v") * 10).cast("int").alias("n"))
    specs = [{"name": "s", "op": "roll_sum", "column": "n", "n": 4}, {"name": "g", "op": "gap_prev"}, {"name": "since", "op": "since", "column": "n"}, {"name": "m", "op": "roll_max", "column": "n", "n": 30}]
    same(entity_features(df, "who", "month", specs, order=["id"], split_rows=8), entity_features(df, "who", "month", specs, order=["id"]), "id")


def test_features_at_decisions_in_blocks(rows):
    specs = [{"name": f"{a}_{w}", "agg": a, "column": "v", "where": "kind = 'x'", "window": w} for a in ("count", "share", "sum", "mean", "std", "min", "max") for w in ("1h", "4D")]
    specs.append({"name": "silence", "agg": "recency_days", "where": "v > 4"})
    whole = features_at_decisions(rows, "who", "ts", specs, "kind IS NULL", "1h", ["id"])
    same(features_at_decisions(rows, "who", "ts", specs, "kind IS NULL", "1h", ["id"], split_rows=15), whole, "id")


def test_empty_and_single_rows(spark, rows):
    for df in (rows.where("false"), rows.where("id = 3")):
        same(entity_features(df, "who", "ts", OPS, order=["id"], split_rows=1), entity_features(df, "who", "ts", OPS, order=["id"]), "id")


def test_no_block_holds_the_hot_entity(spark):
    """A window as wide as the whole history counts all earlier rows, though no block has them."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 50)).alias("who"), (F.col("id") * 1_000_000).alias("_o"), F.lit(1.0).alias("v"))
    cut = blocks.cut(df, "who", ["_o"], 500)
    hot = cut.where("who = 'hot'").groupBy("_block").count()
    assert hot.count() >= 8 and hot.agg(F.max("count")).first()[0] < 2500
    out = blocks.over_blocks(cut, "who", [], {}, 0, [blocks.Span("n", "count", F.col("v"), 10**15), blocks.Span("day", "sum", F.col("v"), 86_400_000_000)], [])
    got = out.groupBy("who").agg(F.max("n").alias("n")).where("who = 'hot'").first()
    assert got.n == hot.agg(F.sum("count")).first()[0] - 1
    assert out.where("who = 'hot' AND id > 0").agg(F.count_if(F.col("n") != F.col("id") / 3)).first()[0] == 0


def test_blocks_cost_no_task_each(spark):
    """Many small blocks are written by few tasks, none larger than asked."""
    df = spark.range(60_000).select("id", F.lit("hot").alias("who"), F.col("id").alias("_o"))
    cut = blocks.cut(df, "who", ["_o"], 20)
    assert len(cut.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = cut.groupBy("_block").agg(F.count("*").alias("n"), F.min("_o").alias("a"), F.max("_o").alias("b"))
    assert sizes.count() >= 3000 and sizes.agg(F.max("n")).first()[0] <= 20
    later = sizes.withColumn("before", F.lag("b").over(blocks.Window.orderBy("_block")))
    assert later.where("before >= a").count() == 0


def test_ranges_take_steps_of_their_logarithm():
    """Each range of a tree equals its own rows, and joins are few however wide the ranges are."""
    rng, calls = random.Random(3), 0
    x = blocks.np.array([rng.uniform(-5, 5) for _ in range(1001)])
    lo = blocks.np.array([rng.randrange(0, 1002) for _ in range(400)])
    hi = blocks.np.array([rng.randrange(0, 1002) for _ in range(400)])

    def join(a, b):
        nonlocal calls
        calls += 1
        return blocks.np.maximum(a, b)

    got = blocks._over_ranges(x, -blocks.np.inf, join, lo, hi)
    assert got.tolist() == [max(x[a:b], default=-math.inf) for a, b in zip(lo, hi, strict=True)]
    assert calls <= 3 * 11


def test_values_of_other_types_and_not_a_number_in_blocks(spark):
    rows = [(i, i // 2, float("nan") if i % 17 == 3 else i * 0.5 - 20, i % 9 - 4) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, sec long, v double, n int").select("id", F.lit("e").alias("who"), F.timestamp_seconds("sec").alias("ts"), "v", "n", F.col("n").cast("decimal(9,2)").alias("d"))
    specs = [{"name": f"{k}_{c}", "op": f"roll_{k}", "column": c, "window": "8s"} for c in "vnd" for k in ("sum", "mean", "min", "max")] + [{"name": "at", "op": "roll_max", "column": "ts", "window": "1min"}]
    wide = df.withColumns({c: F.when(F.col("id") % 5 > 0, F.col(c)) for c in "vnd"})
    whole = entity_features(wide, "who", "ts", specs, order=["id"]).drop("mean_d").fillna(-7777.0, subset=["v"])
    split = entity_features(wide, "who", "ts", specs, order=["id"], split_rows=11).drop("mean_d").fillna(-7777.0, subset=["v"])
    a, b = ([tuple(map(str, r)) for r in x.orderBy("id").collect()] for x in (whole, split))
    assert a == b
