"""Drift of numbers in a stream: the batch's rows for closed periods, state of open periods only."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from quillon.operators.drift import drift_over_time
from quillon.streaming.modes import numeric_drift_stream

DAY = 86_400


def test_stream_equals_batch_and_forgets(spark, tmp_path):
    rng = np.random.default_rng(12)
    ref = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(3000, 2))], "a double, b double").withColumn("same", F.lit(1.0))
    start, rows = 1_709_251_200, []
    for day in range(5):
        for _ in range(40 if day == 2 else 400):
            a, b = rng.normal(0.4 * day), rng.normal()
            rows.append((start + day * DAY + int(rng.integers(DAY)), None if rng.random() < 0.1 else float(a), float("nan") if rng.random() < 0.05 else float(b), 1.0))
    rows.append((None, 1.0, 1.0, 1.0))
    made = spark.createDataFrame(rows, "sec long, a double, b double, same double")
    cur = made.select(F.timestamp_seconds("sec").alias("ts"), "a", "b", "same")
    source = str(tmp_path / "in")
    cur.where(f"ts < timestamp_seconds({start + 3 * DAY}) OR ts IS NULL").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(cur.schema).parquet(source)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        q = numeric_drift_stream(stream, ref, ["a", "b", "same"], "ts", "D", out, ck)
        q.processAllAvailable()
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        q.stop()
        return left

    run()
    cur.where(f"ts >= timestamp_seconds({start + 3 * DAY})").coalesce(1).write.mode("append").parquet(source)
    run()
    far = spark.createDataFrame([(dt.datetime(2024, 6, 1), 0.0, None, None)], cur.schema)
    late = spark.createDataFrame([(dt.datetime(2024, 3, 1), 9.0, 9.0, 1.0)] * 300, cur.schema)
    far.coalesce(1).write.mode("append").parquet(source)
    left = run()
    late.coalesce(1).write.mode("append").parquet(source)
    assert run() == left == 2  # the far period's row and its one value
    whole = drift_over_time(ref, cur.where("ts IS NOT NULL"), F.date_trunc("day", "ts"), ["a", "b", "same"])
    want = {(r.period, r.column_name): (round(r.psi, 9), r.n_cur, r.severity) for r in whole.collect()}
    rows = spark.read.parquet(out).collect()
    assert {(r.period, r.column_name): (round(r.psi, 9), r.n_cur, r.severity) for r in rows} == want and len(rows) == len(want) == 12
    assert {r.severity for r in rows if r.column_name == "a" and r.period.day == 5} == {"severe"}
