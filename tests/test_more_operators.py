"""Panels, prepared splits, comparisons and evidence on planted tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quillon.operators import anomaly, forecast, ledger, metrics, models, screens, segments, splits


def blobs(spark, k=3, n=60, apart=10.0):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=2) + apart * (i % k)), i % k) for i in range(n)]
    return spark.createDataFrame(rows, "k long, a double, b double, segment int")


def test_davies_bouldin_and_sizes(spark):
    df = blobs(spark)
    x = {s: np.array([(r.a, r.b) for r in df.collect() if r.segment == s]) for s in range(3)}
    centre = {s: v.mean(0) for s, v in x.items()}
    spread = {s: np.linalg.norm(v - centre[s], axis=1).mean() for s, v in x.items()}
    want = np.mean([max((spread[s] + spread[t]) / np.linalg.norm(centre[s] - centre[t]) for t in x if t != s) for s in x])
    assert segments.davies_bouldin(df, ["a", "b"]).first()[0] == pytest.approx(want)
    assert segments.davies_bouldin(df.where("segment = 0"), ["a", "b"]).first()[0] is None
    assert {(r.segment, r.n) for r in segments.segment_sizes(df).collect()} == {(0, 20), (1, 20), (2, 20)}


def test_segment_verdicts(spark):
    found = lambda rows: tuple(segments.k_warnings(spark.createDataFrame(rows, "k int, silhouette double, stability double, stable boolean")).first())
    assert found([(2, 0.5, 0.9, True), (3, 0.8, 0.4, False), (4, 0.3, 0.9, True)]) == (2, 0.5, None)
    assert found([(2, 0.5, 0.9, True), (3, 0.6, 0.9, True)]) == (3, 0.6, "at the edge")
    assert found([(2, 0.05, 0.9, True)])[2] == found([(2, 0.5, 0.1, False)])[2] == "no structure"
    refits = spark.createDataFrame([(0, 0.9), (1, 0.7)], "refit int, ari double")
    assert tuple(segments.stability_verdict(refits).first()) == (2, pytest.approx(0.8), True)
    rules, accuracy = segments.rule_tree(blobs(spark), ["a", "b"])
    assert "If" in rules and accuracy > 0.95
    assert segments.distance_columns(blobs(spark), ["b"], ["k", "segment"]) == ["a"]
    with pytest.raises(ValueError):
        segments.distance_columns(blobs(spark), ["nope"], [])


def test_panels(spark):
    rows = [("a", i, float(i)) for i in range(60)] + [("old", i, 1.0) for i in range(30)] + [("new", i, 1.0) for i in range(50, 60)]
    df = spark.createDataFrame(rows, "s string, t int, y double")
    status = {r.s: r.status for r in forecast.panel_status(df, ["s"], "t", "y", 10, 7, 7).collect()}
    assert status == {"a": "usable", "old": "stale", "new": "too_short"}
    days = df.where("s = 'a' AND t != 20").select("s", F.expr("date_add(date'2024-01-01', t)").alias("d"), "y")
    out, report = forecast.prepare_forecast(days.unionByName(days.limit(1)), "d", "y", 7, ["s"])
    assert report["gaps"] == 1 and report["series"] == 1 and out.where("fold = 'test'").count() == 7
    with pytest.raises(ValueError):
        forecast.prepare_forecast(days.withColumn("d", F.expr("date_add(d, cast(pow(dayofyear(d), 2) AS int))")), "d", "y", 7, ["s"])
    assert forecast.one_series(df, "s", "old").count() == 30
    errors = spark.createDataFrame([("a", 1, 10.0, 12.0), ("a", 2, 10.0, 9.0), ("b", 1, 0.0, 1.0)], "s string, step int, actual double, forecast double")
    scale = spark.createDataFrame([("a", 2.0), ("b", 0.0)], "s string, scale double")
    assert {(r.s, r.step): r.error for r in forecast.scaled_errors(errors, scale, ["s"]).collect()} == {("a", 1): 1.0, ("a", 2): -0.5, ("b", 1): None}
    assert {r.s: r.mape for r in forecast.mape(errors, ["s"]).collect()} == {"a": pytest.approx(15.0), "b": None}
    bands = spark.createDataFrame([(1, -1.0, 1.0), (2, -2.0, 2.0)], "step int, low double, high double")
    served = forecast.serve(days, ["s"], "d", "y", 7, 4, bands).orderBy("step").collect()
    assert [(r.forecast - r.low, r.high - r.forecast) for r in served] == [(1, 1), (2, 2), (2, 2), (2, 2)]
    assert forecast.coverage(spark.createDataFrame([(1, 0.5), (1, 3.0), (2, -2.0)], "step int, residual double"), bands).first()[0] == pytest.approx(2 / 3)


def test_prepared_splits(spark):
    rows = [(i, i % 10, float(i), int(i % 9 == 0)) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, g long, y double, bad int")
    out, report = splits.prepare_regression(df.unionByName(df.limit(2)).unionByName(df.limit(1).withColumn("y", F.lit(None).cast("double"))), "y", "k", group="g")
    assert out.count() == 100 and report["duplicates"] == 2 and report["entity_overlap_pct"] == 0
    with pytest.raises(ValueError):
        splits.prepare_regression(df.limit(5), "y", "k")
    out, report = splits.prepare_anomaly(df, "k", "bad")
    assert report["anomaly"] == "1" and report["share"] == pytest.approx(0.12) and {r.fold for r in out.select("fold").distinct().collect()} == {"train", "test"}
    with pytest.raises(ValueError):
        splits.prepare_anomaly(df.where("bad = 0"), "k", "bad")
    assert splits.prepare_anomaly(df, "k", time="y")[0].where("fold = 'test'").count() == 20
    assert splits.prepare_clustering(df, "k")[1]["rows"] == 100
    with pytest.raises(ValueError):
        splits.prepare_clustering(df.limit(10), "k")


def test_groups_of_equal_size_whatever_the_ties(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 70 else float(i)) for i in range(100)] + [(100, None)], "k long, y double")
    sizes = {r.group: r["count"] for r in metrics.quantile_groups(df, "y", ["k"], 4).groupBy("group").count().collect()}
    assert sorted(sizes) == [0, 1, 2, 3] and max(sizes.values()) - min(sizes.values()) <= 1


def test_detectors_compared(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(v), float(v + rng.normal() * 0.01), float(rng.uniform()), int(v > 2.2)) for i, v in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "k long, good double, near double, noise double, y int")
    by_label = anomaly.compare_detectors(df, ["k"], ["noise", "good"], 0.05, "y").orderBy("place").collect()
    assert [r.detector for r in by_label] == ["good", "noise"] and by_label[0].value == 1
    by_peers = anomaly.compare_detectors(df, ["k"], ["noise", "good", "near"], 0.05).orderBy("place").collect()
    assert by_peers[-1].detector == "noise"
    steady = anomaly.alert_stability(df, ["k"], 0.05, lambda rows, fit_on: rows.select("k", F.col("good").alias("score")), 2).first()
    assert (steady.refits, steady.mean_jaccard, steady.stable) == (2, 1.0, True)


def test_targets_gaps_and_choices(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "k long, y double")
    back = models.from_log(models.log_target(df, "y").withColumn("prediction", F.col("label")))
    assert [r.prediction for r in back.orderBy("k").collect()] == pytest.approx([0, 1, 2, 3, 4])
    with pytest.raises(ValueError):
        models.log_target(df.withColumn("y", -F.col("y")), "y")
    assert models.overfit_gap(0.9, 0.7)[1] and not models.overfit_gap(0.9, 0.8)[1]
    assert models.overfit_gap(1.0, 1.3, "pinball")[1] and not models.overfit_gap(1.0, 1.3, "forecast")[1]
    folds = [spark.createDataFrame([("a", 0.3), ("b", -0.2)], "column_name string, importance double"), spark.createDataFrame([("a", 0.1), ("b", 0.1)], "column_name string, importance double")]
    assert {r.column_name: r.kept for r in models.keep_important(folds).collect()} == {"a": True, "b": False}
    with pytest.raises(ValueError):
        models.train_regressor(df, "forest", "poisson")
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(3 * x + rng.normal() * 0.1)) for i, x in enumerate(rng.normal(size=200))]
    table = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "k long, x double, label double"))
    assert models.compare_regressors(table, "k", ["forest", "ols"]).first().model == "ols"


def test_rules_and_copies(spark):
    rows = [(i, float(i % 50), float(i % 7), "yes" if 10 <= i % 50 < 20 else "no", "A" if 10 <= i % 50 < 20 else "B") for i in range(500)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y string, copy string")
    found = screens.label_rule_tree(df, "y", "yes", ["b", "a"], 0.9).collect()
    assert found[0].column_name == "a" and found[0].average_precision > 0.99 and found[0].suspicious and not found[1].suspicious
    assert [r.column_name for r in screens.label_copies(df.drop("k"), "y").collect()] == ["copy"]
    nums = df.withColumn("t", F.col("a") * 2)
    assert {r.column_name for r in screens.regression_leakage(nums, "t", "k", ["a", "b"], ["copy"]).collect()} == {"a"}
    names = spark.createDataFrame([(i % 3, i % 4, 1) for i in range(12)], "key_rate int, customer_imei int, order_id int")
    assert {r.column_name: r.signal for r in screens.identifiers(names).collect()} == {"key_rate": None, "customer_imei": "name", "order_id": None}


def test_evidence(spark):
    rows = [("r1", 1, "record_business_context", True), ("r1", 2, "detect_data_leakage", True), ("r1", 3, "apply_imputation", True), ("r2", 1, "detect_data_leakage", False)]
    book = spark.createDataFrame(rows, "run_id string, seq int, tool string, ok boolean")
    runs = spark.createDataFrame([("r1", "clustering"), ("r2", "clustering")], "run_id string, task string")
    got = {(r.run_id, r.gate): r.status for r in ledger.evidence_gates(book, runs).collect()}
    assert got["r1", "leakage_screened"] == "pass" and got["r1", "explainability_run"] == "not_run" and got["r1", "evidence_ordering"] == "fail"
    assert got["r2", "leakage_screened"] == "not_run" and got["r2", "evidence_ordering"] == "not_run"


def test_forecast_grids_of_each_step(spark):
    hours = spark.range(240).selectExpr("'a' AS s", "timestamp'2024-03-01 00:00:00' + make_dt_interval(0, CAST(id AS int)) AS t", "CAST(id AS double) AS y")
    out, report = forecast.prepare_forecast(hours.where("y != 7"), "t", "y", 24, ["s"])
    assert (report["step"], report["rows"], report["gaps"], report["off_grid"]) == ("h", 240, 1, 0)
    assert out.where("fold = 'test'").agg(F.count("*"), F.min("y")).first()[:] == (24, 216.0)
    weeks = spark.range(60).selectExpr("'a' AS s", "date_add(date'2024-01-03', CAST(7 * id AS int)) AS t", "1.0D AS y")
    late = weeks.where("t = date'2024-01-10'").withColumn("t", F.expr("date_add(t, 2)"))
    out, report = forecast.prepare_forecast(weeks.unionByName(late).unionByName(weeks.selectExpr("'b' AS s", "date_add(t, 3) AS t", "y").limit(40)), "t", "y", 4, ["s"])
    assert (report["step"], report["off_grid"], report["series"]) == ("W", 1, 2)
    got = {(r.s, r.t): r.y for r in out.collect()}
    assert got["a", dt.date(2024, 1, 10)] == 2.0 and got["b", dt.date(2024, 1, 6)] == 1.0 and ("b", dt.date(2024, 1, 10)) not in got
    assert len([k for k in got if k[0] == "a"]) == 60 and out.where("s = 'b' AND y IS NULL").count() == 19
    months = spark.range(30).selectExpr("'a' AS s", "add_months(date'2023-01-15', CAST(id AS int)) AS t", "1.0D AS y").where("t != date'2023-06-15'")
    out, report = forecast.prepare_forecast(months, "t", "y", 6, ["s"])
    assert (report["step"], report["rows"], report["gaps"]) == ("MS", 30, 1) and out.where("dayofmonth(t) != 1").count() == 0
    quarters = hours.withColumn("t", F.expr("t + make_dt_interval(0, -hour(t) - 24 * (dayofmonth(t) - 1), CAST(15 * y AS int))"))
    assert forecast.prepare_forecast(quarters, "t", "y", 4, ["s"])[1]["step"] == 900


def test_gates_of_a_whole_run(spark):
    runs = spark.createDataFrame([("c", "classification"), ("r", "regression"), ("k", "clustering"), ("a", "anomaly"), ("f", "forecasting")], "run_id string, task string")
    tools = ["record_business_context", "detect_data_leakage", "apply_imputation", "detect_data_leakage", "check_label_rule", "apply_frequency_encoding", "train_model", "check_model_stability", "explain_model"]
    book = spark.createDataFrame([("c", i, t, True) for i, t in enumerate([*tools, "confusion_matrix", "roc_curve"])], "run_id string, seq int, tool string, ok boolean")
    metrics_ = spark.createDataFrame([("c", "overfit_gap", 0.2), ("c", "lift_over_baseline", 0.1), ("f", "overfit_gap", 0.2)], "run_id string, metric string, value double")
    rows = ledger.run_gates(book, metrics_, runs).collect()
    count = {r: sum(x.run_id == r for x in rows) for r in "crkaf"}
    assert count == {"c": 17, "r": 11, "k": 8, "a": 9, "f": 7}
    got = {(r.run_id, r.gate): r.status for r in rows}
    assert got["c", "evidence_ordering"] == "fail"  # the encoding came after the leakage screen
    assert (got["c", "no_overfitting"], got["f", "no_overfitting"], got["c", "baseline_beaten"]) == ("fail", "pass", "pass")
    assert (got["c", "evaluation_charts"], got["c", "success_criteria"], got["r", "business_context"], got["c", "stability_checked"]) == ("not_run", "not_run", "not_run", "pass")
    stale = {r.tool: r.stale for r in ledger.stale_screens(book, ["detect_data_leakage", "check_model_stability"]).collect()}
    assert stale == {"detect_data_leakage": True, "check_model_stability": False}


def test_davies_bouldin_moves_no_segment_to_one_task(spark):
    df = spark.range(900).select((F.col("id") % 3).cast("int").alias("segment"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = segments.davies_bouldin(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
