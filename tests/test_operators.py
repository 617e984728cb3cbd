"""Planted answers and properties of the operators."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import basics
from quillon.operators import anomaly, drift, events, explain, fitted, forecast, ledger, metrics, models, screens, segments, splits
from quillon.plans.recipes import RECIPES, recipe


def test_timers_and_humans(spark):
    rows = [(f"m{i}", 1000 + 300 * k, "out", 1) for i in range(3) for k in range(20)]
    rng = np.random.default_rng(1)
    for i in range(3):
        t = 1000
        for k in range(10):
            rows.append((f"h{i}", t, "out" if k % 2 else "in", 0))
            t += int(rng.choice([20, 90, 700, 7000]))
        rows.append((f"h{i}", 3_000_000, "out", 0))
    specs = [
        {"name": "cv", "agg": "cv", "column": "_gap"}, {"name": "period", "agg": "periodicity", "column": "_gap"},
        {"name": "share", "agg": "share", "where": "dir = 'out'"}, {"name": "n", "agg": "count", "where": "dir != 'out'"},
    ]
    df = spark.createDataFrame(rows, "sim string, ts long, dir string, m2m int")
    got = {r.sim: r for r in events.aggregate_events(df, "sim", "ts", specs, before=2_000_000_000_000, carry=["m2m"]).collect()}
    for i in range(3):
        assert got[f"m{i}"].cv < 1e-6 and got[f"m{i}"].period == 1.0 and got[f"m{i}"].m2m == 1
        assert got[f"h{i}"].n_events == 10 and got[f"h{i}"].share == 0.5 and got[f"h{i}"].n == 5
    assert events.constant_columns(df, "sim", ["dir", "m2m"]) == ["m2m"]
    with pytest.raises(ValueError):
        events.aggregate_events(df, "sim", "ts", [{"name": "x", "agg": "nope"}])


def test_decision_events(spark):
    rows = [("L1", 0.0, "reset"), ("L1", 1.0, "care"), ("L1", 2.0, "sim_change"), ("L1", 2.5, "otp"), ("L1", 30.0, "sim_change")] + [(f"L{i}", 1.0, "sim_change") for i in range(2, 8)]
    df = spark.createDataFrame([(a, int(h * 3600), k) for a, h, k in rows], "line string, ts long, kind string")
    specs = [{"name": "n", "agg": "count"}, {"name": "resets", "agg": "count", "where": "kind = 'reset'"}, {"name": "since_reset", "agg": "recency_days", "where": "kind = 'reset'"}, {"name": "changes", "agg": "count", "where": "kind = 'sim_change'", "window": "30D"}]
    out = events.features_at_decisions(df, "line", "ts", specs, "kind = 'sim_change'", "24h").collect()
    first, second = sorted((r for r in out if r.line == "L1"), key=lambda r: r.ts)
    assert len(out) == 8 and (first.n, second.n, first.resets, second.resets) == (2, 0, 1, 0)
    assert (first.since_reset, second.since_reset) == (pytest.approx(2 / 24), pytest.approx(30 / 24)) and (first.changes, second.changes) == (0, 1)


def test_window_features_look_back_only(spark):
    rows = [(e, d, float((e * 7 + d * 3) % 11), d % 3) for e in range(5) for d in range(12)]
    df = spark.createDataFrame(rows, "e int, d int, x double, flag int")
    specs = [{"name": "lag", "op": "lag", "column": "x"}, {"name": "vs", "op": "vs_roll_mean", "column": "x", "n": 3}, {"name": "streak", "op": "streak", "column": "flag"}, {"name": "since", "op": "since", "column": "flag"}, {"name": "gap", "op": "gap_prev"}, {"name": "lag_of_lag", "op": "lag", "column": "lag"}]
    whole = {(r.e, r.d): tuple(r) for r in events.entity_features(df, "e", "d", specs).collect()}
    part = {(r.e, r.d): tuple(r) for r in events.entity_features(df.where("d < 7"), "e", "d", specs).collect()}
    assert all(whole[k] == v for k, v in part.items())
    by = {e: [r for r in rows if r[0] == e] for e in range(5)}
    for e, d, x, _ in rows:
        r = dict(zip(["e", "d", "x", "flag", "lag", "vs", "streak", "since", "gap", "lag_of_lag"], whole[e, d], strict=True))
        before = [b[2] for b in by[e][:d]]
        assert r["lag"] == (before[-1] if before else None) and r["gap"] == (1 if d else None)
        if d:
            assert r["vs"] == pytest.approx(x / (np.mean(before[-3:]) + 1e-6))
        n = 0
        for b in reversed(by[e][:d]):
            if b[3] <= 0:
                break
            n += 1
        assert r["streak"] == n
    with pytest.raises(ValueError):
        events.entity_features(df, "e", "d", [{"name": "y", "op": "lag", "column": "x"}], target="x")


def test_peers_are_fitted_on_training_rows(spark):
    train = spark.createDataFrame([(f"c{i % 2}", float(i)) for i in range(60)] + [("thin", 1e6)], "cell string, x double")
    test = spark.createDataFrame([("c0", 10_000.0), ("thin", 5.0), ("new", 5.0), (None, 5.0)], "cell string, x double")
    spec = [{"name": "r", "column": "x", "by": "cell", "kind": "ratio"}]
    got = {r.cell: r.r for r in fitted.peer_features(test, train, spec).collect()}
    assert got["c0"] == pytest.approx(10_000 / 29, rel=1e-4)
    assert got["thin"] == got["new"] == got[None] == pytest.approx(5 / 30, rel=1e-4)
    with pytest.raises(ValueError):
        fitted.peer_features(test, train, spec, group_column="cell")


def test_fill_and_interpolate(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "s string, t int, y double")
    assert [r.y for r in fitted.interpolate(df, ["s"], "t", "y").orderBy("t").collect()] == [None, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert [r.y for r in fitted.fill_forward(df, ["s"], "t", ["y"]).orderBy("t").collect()] == [None, 1.0, 1.0, 1.0, 4.0, 4.0]


def test_smote_and_dates(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), 0) for a, b in rng.normal(0, 1, (200, 2))] + [(float(a), float(b), 1) for a, b in rng.normal(9, 0.1, (10, 2))]
    out = fitted.smote(spark.createDataFrame(rows, "a double, b double, y int"), "y", ["a", "b"], 1, 0.3).where("y = 1")
    assert out.count() == 60 and out.agg(F.min("a")).first()[0] > 7
    t = spark.createDataFrame([("2024-01-05",), ("05/01/2024",), ("junk",), (None,)], "d string")
    assert [str(r[0])[:10] for r in t.select(basics.parse_time(F.col("d"))).collect()] == ["2024-01-05", "2024-01-05", "None", "None"]


def test_screens_flag_planted_columns(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 1500)
    rows = [(i, int(y[i]), float(y[i] * 3 + 1), 7, float(rng.normal()), f"u{i}", "late" if y[i] else "none") for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, label int, label_echo double, flat int, noise double, customer string, retention_outcome string")
    flags = {r.column_name: r.flag for r in screens.profile_features(df, "label", 1, "k").collect()}
    assert (flags["label_echo"], flags["flat"], flags["retention_outcome"], flags["noise"]) == ("leakage_suspect", "constant", "leakage_suspect", "weak_alone")
    found = {(r.column_name, r.reason) for r in screens.leakage(df, "label", 1, "k").collect()}
    assert {("label_echo", "correlation"), ("retention_outcome", "single_column_auc"), ("retention_outcome", "after_the_event"), ("customer", "identifier")} <= found
    rule = screens.label_rule(df, "label", 1, "label_echo").first()
    assert rule.average_precision == pytest.approx(1.0) and 1 < rule.cut < 4
    drops = {r.column_name: r.reason for r in screens.propose_drops(df, "label").collect()}
    assert drops["flat"] == "constant" and drops["customer"].startswith("identifier")


def test_splits(spark):
    rows = [(i % 40, i, i % 5 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "e int, t int, y boolean")
    g = splits.grouped_split(df, "e")
    assert splits.entity_overlap(g, "e").first().overlap_pct == 0
    t = splits.temporal_split(df, "t", ["e"])
    assert t.where("fold = 'test'").agg(F.min("t")).first()[0] == 320
    blocks = splits.expanding_folds(df, "t", ["e"], 3)
    assert sorted(r.block for r in splits.usable_folds(blocks, "y").collect()) == [1, 2, 3]
    out, report = splits.prepare(df.unionByName(df.limit(3)), "y", "t")
    assert report["duplicates"] == 3 and out.count() == 400 and report["positive"] is True
    assert splits.positive_label(["fraud", "normal"]) == "fraud" and splits.positive_label([0, 1]) == 1
    for event, other in (("default", "paid"), ("churned", "retained"), ("fraud", "genuine"), ("fail", "pass"), ("churn", "no_churn"), ("fraud", "Non-Fraud"), ("Yes", "No")):
        assert splits.positive_label([other, event]) == splits.positive_label([event, other]) == event
        labels = spark.createDataFrame([(event,), (other,), (other,), (None,)], "y string")
        assert tuple(splits.event_label(labels, "y").first()) == (2, event)
    assert splits.structure_sample(df, 50, time="t").agg(F.min("t")).first()[0] == 350


def test_metric_kernels(spark):
    e = spark.createDataFrame([(0.0, 1.0), (10.0, 12.0), (20.0, 18.0)], "actual double, forecast double").withColumn("scale", F.lit(2.0))
    m = forecast.forecast_metrics(e, [], scale="scale").first()
    assert (m.wape, m.mase, m.bias_pct) == (pytest.approx(16.6667, abs=1e-4), pytest.approx(0.8333, abs=1e-4), pytest.approx(3.3333, abs=1e-4))
    assert metrics.regression_metrics(e, "actual", "forecast").first().mape is None
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 3000)
    rows = [(i, int(v), float(np.clip(round(0.3 * v + rng.random() * 0.7, 2), 0, 1))) for i, v in enumerate(y)]
    s = spark.createDataFrame(rows, "k long, y int, s double")
    got = metrics.auc_ap(s, "y", "s").first()
    pairs = [(a[2] > b[2]) + 0.5 * (a[2] == b[2]) for a in rows[:300] if a[1] for b in rows[:300] if not b[1]]
    assert metrics.auc_ap(s.where("k < 300"), "y", "s").first().roc_auc == pytest.approx(np.mean(pairs))
    band = {r.metric: r for r in metrics.bootstrap(s, "y", "s", 60).collect()}
    assert band["roc_auc"].low < got.roc_auc < band["roc_auc"].high and band["roc_auc"].high - band["roc_auc"].low < 0.08
    better = s.withColumn("s", F.col("s") + 0.3 * F.col("y"))
    assert metrics.paired_difference(s, better, "k", "y", "s", 60).first().distinguishable
    assert not metrics.paired_difference(s, s, "k", "y", "s", 60).first().distinguishable


def test_drift_answers(spark):
    rng = np.random.default_rng(5)
    frame = lambda v, c="usage": spark.createDataFrame([(float(x),) for x in v], f"{c} double")
    ref = frame(rng.normal(0, 1, 5000))
    same = drift.psi_numeric(ref, ref).first()
    assert same.psi == pytest.approx(0)
    out, verdict = drift.detect_drift(ref, frame(rng.normal(0, 1, 120)))
    assert verdict == "none" and out.first().floor > 0.1
    assert drift.detect_drift(ref, frame(rng.normal(1, 1, 120)))[1] == "severe"
    a = spark.createDataFrame([(float(x), "a" if i % 3 else "b") for i, x in enumerate(rng.normal(0, 1, 3000))], "mb double, device string")
    b = a.withColumn("mb", F.when(F.pmod(F.xxhash64("mb"), F.lit(10)) >= 4, F.col("mb"))).withColumn("device", F.when(F.pmod(F.xxhash64("mb", F.lit(1)), F.lit(33)) == 0, "kaios").otherwise(F.col("device")))
    rows = {r.column_name: r for r in drift.detect_drift(a, b)[0].collect()}
    assert rows["mb"].severity == "severe" and rows["device"].severity in ("moderate", "severe") and rows["device"].new_share > 0.01
    assert drift.detect_drift(a, b.drop("mb"), ["mb"])[1] == "blocked"
    assert basics.chi2_isf(0.01, 9) == pytest.approx(21.666, abs=1e-3) and basics.chi2_sf(21.666, 9) == pytest.approx(0.01, abs=1e-5)
    assert basics.normal_isf(0.025) == pytest.approx(1.959964, abs=1e-5)


def test_forecasts(spark):
    rng = np.random.default_rng(6)
    rows = [(f"c{s}", d, float(20 + s + 5 * np.sin(2 * np.pi * d / 7) + rng.normal() * 0.3)) for s in range(4) for d in range(140)]
    df = spark.createDataFrame(rows, "cell string, d int, y double").withColumn("day", F.expr("date_add(DATE '2024-01-01', d)")).drop("d")
    gone = df.where("NOT (cell = 'c1' AND day BETWEEN DATE '2024-02-01' AND DATE '2024-02-05')")
    full = forecast.fill_grid(gone, ["cell"], "day")
    assert full.where("y IS NULL").count() == 5
    assert forecast.choose_season(df.where("cell = 'c0'"), "day", "y", "D") == 7
    errors = forecast.backtest_naive(df, ["cell"], "day", "y", 7, 14)
    assert errors.count() == 4 * 3 * 14
    cut = "day < DATE '2024-05-06'"
    actual = df.where(f"NOT ({cut})").withColumn("step", F.expr("datediff(day, DATE '2024-05-05')")).withColumnRenamed("y", "actual")
    ets = forecast.holt_winters(df.where(cut), ["cell"], "day", "y", 7, 14).join(actual, ["cell", "step"])
    naive = forecast.seasonal_naive(df.where(cut), ["cell"], "day", "y", 7, 14).join(actual, ["cell", "step"])
    assert ets.count() == naive.count() == 56
    assert forecast.panel_score(ets, ["cell"], naive).first().beat_naive_share >= 0.75
    bands = forecast.interval_bands(errors.select("step", (F.col("actual") - F.col("forecast")).alias("residual")), 14).orderBy("step").collect()
    assert all(a.low >= b.low and a.high <= b.high for a, b in zip(bands, bands[1:], strict=False))
    status = {r.cell: r.status for r in forecast.panel_status(df.where("cell != 'c2' OR day < DATE '2024-04-01'"), ["cell"], "day", "y", 14, 7).collect()}
    assert status["c2"] == "stale" and status["c0"] == "usable"


def test_segments(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 3, float(rng.normal(8 * (i % 3))), float(rng.normal(-6 * (i % 3)))) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, truth int, a double, b double")
    space, _ = segments.distance_space(df, ["a", "b"])
    for algorithm in ("kmeans", "hierarchical", "gmm"):
        scored = segments.fit(space, algorithm, 3).transform(space)
        assert segments.adjusted_rand(scored, "truth", "segment").first().ari > 0.95
    scored = segments.fit(space, "kmeans", 3).transform(space)
    moved = scored.withColumn("other", (F.col("segment") + 1) % 3)
    assert segments.adjusted_rand(moved, "segment", "other").first().ari == pytest.approx(1.0)
    assert segments.eta_squared(scored, "segment", "a").first().eta_squared > 0.9
    assert segments.silhouette(scored) > 0.8
    gower, _ = segments.distance_space(df.withColumn("plan", F.concat(F.lit("p"), F.col("truth"))), ["a"], ["plan"], gower=True)
    assert segments.adjusted_rand(segments.k_medoids(gower, 3, 300), "truth", "segment").first().ari > 0.9
    found = segments.dbscan(df, "k", ["a", "b"], 2.0, 5).join(df, "k").where("segment >= 0")
    assert segments.adjusted_rand(found, "truth", "segment").first().ari > 0.95
    panel = spark.createDataFrame([(e, p, "x" if e % 2 or p < 2 else "y") for e in range(10) for p in range(3)], "e int, p int, s string")
    moves = segments.transitions(panel, "e", "p", "s")
    assert moves.count() == 20 and segments.top_flows(moves).first().n == 5


def test_detectors(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (980, 3)), rng.normal(6, 0.5, (20, 3))])
    df = spark.createDataFrame([(i, *map(float, r), int(i >= 980)) for i, r in enumerate(x)], "k long, a double, b double, c double, y int")
    cols = ["a", "b", "c"]
    for s in (anomaly.isolation_forest(df, cols, ["k"], 50), anomaly.ecod(df, cols, ["k"]), anomaly.neighbours(df, cols, ["k"], "knn", 30)):
        m = anomaly.queue_metrics(s.join(df.select("k", "y"), "k"), "y", 0.02, ["k"]).first()
        assert m.k == 20 and m.recall >= 0.9 and m.lift >= 40
    ref = anomaly.robust_reference(df, cols)
    reasons = {r.k: r.reasons for r in anomaly.row_reasons(df, ["k"], cols, ref).collect()}
    assert all(i in reasons and "high" in reasons[i] for i in range(980, 1000))
    lof = anomaly.neighbours(df.where("k < 980"), cols, ["k"], "lof", 20)
    assert 0.8 < lof.agg(F.median("score")).first()[0] < 1.2


def test_models_and_explanations(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "k long, a double, b double, c double, label double")
    cols = ["a", "b", "c"]
    rows = models.matrix(cols).fit(df).transform(df)
    best = models.compare_models(rows.select("k", "label", "features"), "k", ["logistic", "forest"], 2).first()
    assert best.score > 0.9
    tree = models.train_classifier(rows, "boosting", maxIter=3, maxDepth=3)
    phi = explain.tree_attribution(tree, rows, "k", cols)
    raw = tree.transform(rows).select("k", "rawPrediction")
    from pyspark.ml.functions import vector_to_array

    joined = phi.join(raw, "k").withColumn("total", F.col("base") + F.aggregate("phi", F.lit(0.0), lambda s, v: s + v)).withColumn("score", vector_to_array("rawPrediction")[1] / 2)
    got = explain.additivity(joined, "total", "score", 1e-3).first()
    assert joined.agg(F.corr("total", "score")).first()[0] > 0.9999 and got.rows == 1200
    oof = models.out_of_fold(rows, "k", 3, lambda t: models.train_classifier(t, "logistic"))
    for method in ("isotonic", "sigmoid"):
        assert metrics.calibration(models.calibrate(oof, method)(oof), "label", "calibrated").first().ece < 0.06
    assemble = lambda d: models.matrix(cols).fit(df).transform(d)
    logistic = models.train_classifier(rows, "logistic")
    metric = lambda d: metrics.auc_ap(d.withColumn("p", vector_to_array("probability")[1]), "label", "p").first().roc_auc
    imp = {r.column_name: r.importance for r in models.permutation_importance(logistic, df, "k", cols, assemble, metric, 1).collect()}
    assert imp["a"] > imp["b"] > imp["c"] - 0.01
    out = models.score(logistic, rows, cols, 0.5, "m1")
    assert out.where("prediction = label").count() > 1100
    with pytest.raises(ValueError):
        models.score(logistic, rows, ["missing"], 0.5, "m1")
    q = models.train_regressor(rows.select("features", F.col("a").alias("label")), objective="quantile", quantile=0.8)
    assert q is not None
    s = explain.linear_score({"a": 2.0, "b": 1.0}, 0.0)
    flips = explain.counterfactuals(df, "k", ["a", "b"], {"a": -2.0, "b": -2.0}, s, 0.5).where("flipped")
    assert flips.count() > 500


def test_ledger(spark):
    m = spark.createDataFrame([("r1", "clustering", "stability_ari", 0.9), ("r1", "clustering", "silhouette", 0.4), ("r2", "clustering", "stability_ari", 0.2), ("r3", "clustering", "silhouette", 0.5)], "run_id string, task string, metric string, value double")
    got = {r.run_id: (r.status, r.completeness) for r in ledger.readiness(ledger.gate_rows(m)).collect()}
    assert got == {"r1": ("ready", 1.0), "r2": ("blocked", 0.5), "r3": ("incomplete", 0.5)}
    ack = spark.createDataFrame([("r2", "stability_ari", "known")], "run_id string, gate string, reason string")
    assert {r.run_id: r.status for r in ledger.readiness(ledger.acknowledge(ledger.gate_rows(m), ack)).collect()}["r2"] == "incomplete"
    tools = spark.createDataFrame([("r", 1, "prepare_dataset", True), ("r", 2, "train_model", True), ("r", 3, "export_model", False)], "run_id string, seq int, tool string, ok boolean")
    assert ledger.phases(tools).first().phase == "trained"


def test_recipes_are_valid(spark):
    args = {"counterparties": {"other": "peer"}, "outcomes": {"duration": "secs", "answered": "ok"}, "mobility": {"place": "cell"}, "pairing": {"other": "imei"}, "baseline": {"amount": "x"}, "fraud": {"amount": "x", "payee": "p"}, "credit": {"late": "l", "on_time": "o", "used": "u"}}
    for name in RECIPES:
        specs = recipe(name, **args.get(name, {}))
        assert len({s["name"] for s in specs}) == len(specs)
        assert all(s.get("agg") in events.AGGREGATES or s.get("op") in events.WINDOW_OPS for s in specs)


def test_fits_on_samples_of_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    scores = lambda s: {r.a: r.score for r in s.join(df, "k").groupBy("a").agg(F.avg("score").alias("score")).collect()}
    forest = scores(anomaly.isolation_forest(df, ["a"], ["k"], 20, 16))
    assert forest[1.0] > forest[0.0]
    near = anomaly.neighbours(df, ["b"], ["k"], "knn", 5, 1000)
    assert near.agg(F.max("score")).first()[0] == 0
    space, _ = segments.distance_space(df, ["b"], [])
    for key in (["k"], None):
        assert segments.k_medoids(space, 2, 100, key=key).groupBy("segment").count().count() == 2


def test_queries_fit_on_the_default_rows(spark, sf, monkeypatch):
    from quillon.queries import later

    seen = {}
    for module, name in ((anomaly, "neighbours"), (segments, "k_medoids")):
        real = getattr(module, name)
        default = inspect.signature(real).parameters["fit_rows"].default

        def spy(*a, real=real, default=default, **k):
            seen.setdefault(real.__name__, []).append(inspect.signature(real).bind(*a, **k).arguments.get("fit_rows", default) == default)
            return real(*a, **k)

        monkeypatch.setattr(module, name, spy)
    for query in (later.knn_scores, later.lof_scores, later.gower_medoids):
        query(spark, sf)
    assert seen == {"neighbours": [True, True], "k_medoids": [True]}


def brute_lof(x, k):
    """Distance to the k-th other row, and the local outlier factor, of every row."""
    import numpy as np

    x = (x - x.mean(0)) / x.std(0)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    at = np.argsort(d, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(d, at, 1)
    density = 1 / np.maximum(near, near[:, -1][at]).mean(1)
    return near[:, -1], density[at].mean(1) / density


def test_neighbours_against_brute_force(spark):
    """Rows of the fit sample are not their own neighbours, and scores don't depend on the batches."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 4))
    x[:3] += 6
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k long, a double, b double, c double, d double").repartition(5)
    far, lof = brute_lof(x, 5)
    for method, want in (("knn", far), ("lof", lof)):
        for size in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {r.k: r.score for r in anomaly.neighbours(df, list("abcd"), ["k"], method, 5).collect()}
            assert [got[i] for i in range(150)] == pytest.approx(want.tolist(), rel=1e-6)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_detectors_with_missing_values_and_no_rows(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, b double").repartition(3)
    for score in (lambda d: anomaly.neighbours(d, ["a", "b"], ["k"], "knn", 3), lambda d: anomaly.neighbours(d, ["a", "b"], ["k"], "lof", 3), lambda d: anomaly.isolation_forest(d, ["a", "b"], ["k"], trees=10)):
        seen = []
        for size in (4, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            seen.append(sorted((r.k, round(r.score, 9)) for r in score(df).collect()))
        assert seen[0] == seen[1] and len(seen[0]) == 60
        assert score(df.limit(0)).count() == 0 and {r.score for r in score(df.where("b IS NULL")).collect()} == {None}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_running_sums_and_quantiles(spark):
    import numpy as np

    from quillon.operators import ranking

    rng = np.random.default_rng(6)
    rows = [(str(i % 3) if i % 4 else None, float(v)) for i, v in enumerate(rng.integers(0, 200, 3000))]
    df = spark.createDataFrame(rows, "g string, value double").repartition(6)
    got = {r.g: r for r in ranking.quantiles(df, [0.0, 0.1, 0.5, 0.975, 1.0], ["g"]).collect()}
    for g in {g for g, _ in rows}:
        own = [v for h, v in rows if h == g]
        assert got[g].n == len(own) and got[g].q == pytest.approx(np.quantile(own, [0, 0.1, 0.5, 0.975, 1]).tolist())
    counts = df.groupBy("value").count()
    upto, seen = 0, {r.value: (r.count_before, r.count_all) for r in ranking.running(counts, "value", ["count"]).collect()}
    for v, n in sorted((r.value, r["count"]) for r in counts.collect()):
        assert seen[v] == (upto, 3000)
        upto += n
    assert ranking.quantiles(df.limit(0), [0.5], ["g"]).count() == 0 and ranking.column_medians(df.limit(0), ["value"]).first().value is None
