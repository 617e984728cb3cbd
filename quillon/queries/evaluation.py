"""Queries on scores, residuals, drift and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import drift, forecast, metrics
from quillon.queries.common import DAILY, ORDERS, SCORED, Registry, daily_orders, events, order_totals, rounded, scored_documents
from quillon.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
CURVE = f"""WITH {SCORED}, c AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1),
k AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c)"""


@R.add(f"WITH {SCORED} SELECT y AS label, pred, count(*) AS n FROM scored GROUP BY ALL")
def confusion(spark, d):
    return metrics.confusion(scored_documents(spark, d), "y", "pred").withColumnRenamed("y", "label")


REPORT = """r AS (SELECT {g}c AS class, count(*) FILTER (y = c AND pred = c) AS hit, count(*) FILTER (pred = c) AS said, count(*) FILTER (y = c) AS support
  FROM scored, (SELECT unnest([0, 1]) AS c) GROUP BY ALL HAVING said + support > 0),
v AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS q FROM r),
f AS (SELECT *, coalesce(2 * p * q / nullif(p + q, 0), 0) AS f FROM v)"""


@R.add(f"WITH {SCORED}, {REPORT.format(g='')} SELECT class, round(p, 6) AS precision, round(q, 6) AS recall, round(f, 6) AS f1, support FROM f")
def class_report(spark, d):
    return rounded(metrics.class_report(scored_documents(spark, d), "y", "pred"))


@R.add(f"""WITH {SCORED}, {REPORT.format(g='')} SELECT 'macro' AS average, round(avg(p), 6) AS precision, round(avg(q), 6) AS recall, round(avg(f), 6) AS f1 FROM f
UNION ALL SELECT 'weighted', round(sum(p * support) / sum(support), 6), round(sum(q * support) / sum(support), 6), round(sum(f * support) / sum(support), 6) FROM f""")
def report_averages(spark, d):
    return rounded(metrics.report_averages(metrics.class_report(scored_documents(spark, d), "y", "pred")))


@R.add(f"{CURVE} SELECT s AS score, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM k")
def roc_points(spark, d):
    return rounded(metrics.roc_points(scored_documents(spark, d), "y", "s"))


@R.add(f"{CURVE} SELECT s AS score, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM k")
def pr_points(spark, d):
    return rounded(metrics.pr_points(scored_documents(spark, d), "y", "s"))


@R.add(f"{CURVE} SELECT round(sum(neg * (tp - pos / 2)) / (max(p) * max(n)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(p), 6) AS average_precision FROM k")
def auc_ap(spark, d):
    return rounded(metrics.auc_ap(scored_documents(spark, d), "y", "s"))


TUNED = f"""{CURVE}, t AS (SELECT s AS threshold, tp / (tp + fp) AS precision, tp / p AS recall, coalesce(2 * tp / nullif(2 * tp + fp + p - tp, 0), 0) AS f1, (tp + fp) / (p + n) AS alert_rate, fp AS false_positives, p - tp AS false_negatives FROM k)"""
PICK = "(SELECT '{goal}' AS goal, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(alert_rate, 6) AS alert_rate FROM t {w} ORDER BY {o}, threshold LIMIT 1)"


@R.add(f"{TUNED} " + " UNION ALL ".join([
    PICK.format(goal="f1", w="", o="round(f1, 12) DESC"), PICK.format(goal="recall", w="WHERE recall >= 0.8", o="precision DESC"),
    PICK.format(goal="alerts", w="WHERE alert_rate <= 0.2", o="recall DESC"), PICK.format(goal="cost", w="", o="5.0 * false_negatives + false_positives"),
]))
def threshold_sweep(spark, d):
    s = scored_documents(spark, d)
    goals = {"f1": {}, "recall": {"target_recall": 0.8}, "alerts": {"max_alert_rate": 0.2}, "cost": {"cost_ratio": 5.0}}
    out = None
    for goal, how in goals.items():
        one = metrics.tune_threshold(s, "y", "s", **how).select(F.lit(goal).alias("goal"), "threshold", "precision", "recall", "f1", "alert_rate")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@R.add(f"""WITH {SCORED} SELECT least(floor(s * 10), 9)::INT AS bin, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(y), 6) AS positive_rate FROM scored GROUP BY 1""")
def ece_bins(spark, d):
    return rounded(metrics.calibration_bins(scored_documents(spark, d), "y", "s"))


@R.add(f"""WITH {SCORED}, b AS (SELECT count(*) AS n, avg(s) AS m, avg(y) AS r FROM scored GROUP BY least(floor(s * 10), 9)), e AS (SELECT sum(n * abs(m - r)) / sum(n) AS ece FROM b)
SELECT round(avg((s - y) ** 2), 6) AS brier, round(max(ece), 6) AS ece, max(ece) > 0.05 AS concern FROM scored, e""")
def calibration(spark, d):
    return rounded(metrics.calibration(scored_documents(spark, d), "y", "s"))


@R.add(f"""WITH {SCORED} SELECT doc_id, y, s, greatest(s, 1 - s) AS confidence FROM scored WHERE (s >= 0.5)::INT != y ORDER BY confidence DESC, doc_id LIMIT 10""")
def confident_errors(spark, d):
    return metrics.confident_errors(scored_documents(spark, d), "y", "s", "doc_id").select("doc_id", "y", "s", "confidence")


@R.add(f"""WITH {SCORED}, {REPORT.format(g='lang, ')}, z AS (SELECT lang, count(*) AS n, count(DISTINCT y) AS k FROM scored GROUP BY 1),
w AS (SELECT lang, sum(p * support) / sum(support) AS p, sum(q * support) / sum(support) AS q, sum(f * support) / sum(support) AS f FROM f GROUP BY 1)
SELECT lang, n, round(p, 6) AS precision, round(q, 6) AS recall, round(f, 6) AS f1, CASE WHEN n < 2 THEN 'too few rows' WHEN k < 2 THEN 'one class' END AS note FROM z JOIN w USING (lang)""")
def segment_metrics(spark, d):
    return rounded(metrics.segment_metrics(scored_documents(spark, d), "lang", "y", "pred"))


FAIR = f"""WITH {SCORED}, g AS (SELECT lang, count(*) AS n, avg(pred) AS selection_rate, avg(pred) FILTER (y = 1) AS tpr FROM scored GROUP BY 1 HAVING count(*) >= 20)"""


@R.add(f"{FAIR} SELECT lang, n, round(selection_rate, 6) AS selection_rate, round(tpr, 6) AS tpr FROM g")
def fairness_groups(spark, d):
    return rounded(metrics.fairness_groups(scored_documents(spark, d), "lang", "y", "pred"))


@R.add(f"""{FAIR}, f AS (SELECT count(*) AS groups, max(selection_rate) - min(selection_rate) AS a, min(selection_rate) / max(selection_rate) AS b, max(tpr) - min(tpr) AS c FROM g)
SELECT groups, round(a, 6) AS parity_difference, round(b, 6) AS impact_ratio, round(c, 6) AS opportunity_difference, a > 0.1 OR b < 0.8 OR c > 0.1 AS concern FROM f""")
def fairness(spark, d):
    return rounded(metrics.fairness(scored_documents(spark, d), "lang", "y", "pred"))


@R.add(f"""WITH {ORDERS}, e AS (SELECT o_totalprice AS y, pred, o_totalprice - pred AS e FROM ot WHERE pred IS NOT NULL)
SELECT count(*) AS n, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(quantile_cont(abs(e), 0.5), 4) AS median_ae,
round(sum(pred) / sum(y), 6) AS sum_ratio, round(avg(greatest(0.5 * e, -0.5 * e)), 4) AS pinball, round(avg((y <= pred)::INT), 6) AS hit_rate FROM e""")
def regression_metrics(spark, d):
    out = metrics.regression_metrics(order_totals(spark, d), "o_totalprice", "pred")
    six = ("r2", "sum_ratio", "hit_rate")
    return out.select("n", *(F.round(c, 6 if c in six else 4).alias(c) for c in ("r2", "rmse", "mae", "median_ae", "sum_ratio", "pinball", "hit_rate")))


@R.add(f"""WITH {ORDERS} SELECT o_orderkey, pred AS persistence FROM ot""")
def persistence_baseline(spark, d):
    return order_totals(spark, d).select("o_orderkey", F.col("pred").alias("persistence"))


@R.add(f"""WITH {ORDERS}, e AS (SELECT o_totalprice, o_orderstatus, o_orderpriority, pred - o_totalprice AS e FROM ot WHERE pred IS NOT NULL),
q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q, count(*) AS m FROM e),
x AS (SELECT 'o_totalprice' AS column_name, 'Q' || (1 + (o_totalprice > q[1])::INT + (o_totalprice > q[2])::INT + (o_totalprice > q[3])::INT) AS segment, e FROM e, q
  UNION ALL SELECT 'o_orderstatus', o_orderstatus, e FROM e UNION ALL SELECT 'o_orderpriority', o_orderpriority, e FROM e)
SELECT column_name, segment, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(avg(e), 4) AS bias FROM x GROUP BY 1, 2 HAVING count(*) >= greatest(30, 0.02 * (SELECT m FROM q)) ORDER BY avg(abs(e)) DESC, 1, 2 LIMIT 8""")
def residual_segments(spark, d):
    rows = order_totals(spark, d).where("pred IS NOT NULL")
    return rounded(metrics.error_segments(rows, "o_totalprice", "pred", ["o_totalprice"], ["o_orderstatus", "o_orderpriority"]), 4)


@R.add(f"""WITH {ORDERS}, e AS (SELECT abs(o_totalprice - pred) AS e FROM ot WHERE pred IS NOT NULL), r AS (SELECT e, row_number() OVER (ORDER BY e) AS i, count(*) OVER () AS n FROM e)
SELECT n, round(min(e), 4) AS width FROM r WHERE i >= least(ceil((n + 1) * 0.9), n) GROUP BY n""")
def conformal_width(spark, d):
    return rounded(metrics.conformal_width(order_totals(spark, d), "o_totalprice", "pred"), 4)


@R.add(f"""WITH {ORDERS}, e AS (SELECT abs(o_totalprice - pred) AS a, pred AS b, o_totalprice AS y FROM ot WHERE pred IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM e),
s AS (SELECT corr(ra, rb) AS c FROM r), z AS (SELECT abs(avg(b - y)) / avg(abs(y)) AS bias FROM e)
SELECT round(bias, 6) AS bias_ratio, round(c, 5) AS spread_rank_corr, bias > 0.05 AS biased, abs(c) > 0.3 AS heteroscedastic FROM z, s""")
def residual_checks(spark, d):
    out = metrics.residual_checks(order_totals(spark, d).where("pred IS NOT NULL"), "o_totalprice", "pred")
    return out.withColumns({"bias_ratio": F.round("bias_ratio", 6), "spread_rank_corr": F.round("spread_rank_corr", 5)})


def sides(spark, d):
    li = table(spark, d, "lineitem")
    early = F.year("l_shipdate") < 1996
    return li.where(early), li.where(~early)


SIDES = "r AS (SELECT * FROM lineitem WHERE year(l_shipdate) < 1996), c AS (SELECT * FROM lineitem WHERE year(l_shipdate) >= 1996)"


def _psi_sql(columns):
    one = """SELECT '{c}' AS column_name, sum((greatest(b, 1e-4) - greatest(a, 1e-4)) * ln(greatest(b, 1e-4) / greatest(a, 1e-4))) AS psi FROM (
  SELECT k, (SELECT count(*) FILTER (len(list_filter(e, lambda x: x <= {c})) = k) / count({c}) FROM r, e{i}) AS a, (SELECT count(*) FILTER (len(list_filter(e, lambda x: x <= {c})) = k) / count({c}) FROM c, e{i}) AS b
  FROM (SELECT unnest(range(0, len(e) + 1)) AS k FROM e{i}))"""
    edges = ", ".join(f"e{i} AS MATERIALIZED (SELECT CASE WHEN len(q) < 3 THEN [] ELSE q[2:-2] END AS e FROM (SELECT list_sort(list_distinct(quantile_cont({c}::DOUBLE, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS q FROM r))" for i, c in enumerate(columns))
    return f"WITH {SIDES}, {edges} SELECT column_name, round(psi, 6) AS psi FROM (" + " UNION ALL ".join(one.format(c=c, i=i) for i, c in enumerate(columns)) + ")"


@R.add(_psi_sql(["l_quantity", "l_discount"]))
def psi_numeric(spark, d):
    ref, cur = sides(spark, d)
    return rounded(drift.psi_numeric(ref, cur, ["l_quantity", "l_discount"]).select("column_name", "psi"))


@R.add(f"""WITH {SIDES}, v AS (SELECT DISTINCT l_returnflag AS v FROM lineitem), x AS (
  SELECT v, (SELECT count(*) FROM r WHERE l_returnflag = v)::DOUBLE AS a, (SELECT count(*) FROM c WHERE l_returnflag = v)::DOUBLE AS b, (SELECT count(*) FROM r) AS n, (SELECT count(*) FROM c) AS m FROM v),
y AS (SELECT *, greatest(a / n, 1e-4) AS p, greatest(b / m, 1e-4) AS q, (a + b) * n / (n + m) AS ea, (a + b) * m / (n + m) AS eb FROM x)
SELECT 'l_returnflag' AS column_name, round(sum((q - p) * ln(q / p)), 6) AS psi, count(*) AS bins, round(sum((a - ea) ** 2 / ea + (b - eb) ** 2 / eb), 4) AS chi2, count(*) FILTER (a = 0) AS new_categories FROM y""")
def psi_categorical(spark, d):
    ref, cur = sides(spark, d)
    out = drift.psi_categorical(ref, cur, ["l_returnflag"])
    return out.select("column_name", F.round("psi", 6).alias("psi"), "bins", F.round("chi2", 4).alias("chi2"), "new_categories")


@R.add(f"""WITH {SIDES}, k AS (SELECT l_extendedprice AS v, count(*) FILTER (year(l_shipdate) < 1996) AS a, count(*) FILTER (year(l_shipdate) >= 1996) AS b FROM lineitem GROUP BY 1),
u AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS d FROM k)
SELECT 'l_extendedprice' AS column_name, round(max(abs(d)), 6) AS ks, (SELECT count(*) FROM r) AS n_ref, (SELECT count(*) FROM c) AS n_cur FROM u""")
def ks_stat(spark, d):
    ref, cur = sides(spark, d)
    return rounded(drift.ks_statistics(ref, cur, ["l_extendedprice"]))


@R.add(f"""WITH {SIDES}, m AS (SELECT (SELECT avg((l_tax < 0.02)::INT) FROM r) AS a, (SELECT avg((l_tax < 0.04)::INT) FROM c) AS b)
SELECT 'tax' AS column_name, round(a, 6) AS missing_ref, round(b, 6) AS missing_cur, CASE WHEN abs(b - a) >= 0.2 THEN 'severe' WHEN abs(b - a) >= 0.05 THEN 'moderate' ELSE 'none' END AS severity FROM m""")
def missing_shift(spark, d):
    ref, cur = sides(spark, d)
    return rounded(drift.missing_shift(ref.select(F.expr("CASE WHEN l_tax >= 0.02 THEN l_tax END").alias("tax")), cur.select(F.expr("CASE WHEN l_tax >= 0.04 THEN l_tax END").alias("tax")), ["tax"]))


@R.add("""WITH e AS (SELECT *, date_trunc('week', ts)::DATE AS period FROM events), r AS (SELECT event_type AS v, count(*) AS n FROM e WHERE ts < TIMESTAMP '2024-01-08' GROUP BY 1),
c AS (SELECT period, event_type AS v, count(*) AS n FROM e WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY ALL), t AS (SELECT period, sum(n) AS n FROM c GROUP BY 1 HAVING sum(n) >= 100),
g AS (SELECT period, v, t.n AS m FROM t, (SELECT v FROM r UNION SELECT v FROM c)),
x AS (SELECT period, m, greatest(coalesce(r.n, 0) / (SELECT sum(n) FROM r), 1e-4) AS p, greatest(coalesce(c.n, 0) / m, 1e-4) AS q FROM g LEFT JOIN r USING (v) LEFT JOIN c USING (period, v))
SELECT period, 'event_type' AS column_name, round(sum((q - p) * ln(q / p)), 6) AS psi, max(m)::BIGINT AS n_cur FROM x GROUP BY 1""")
def drift_over_time(spark, d):
    e = events(spark, d)
    cut = F.lit("2024-01-08").cast("timestamp_ntz")
    out = drift.drift_over_time(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), F.to_date(F.date_trunc("week", "ts")), ["event_type"])
    return rounded(out.drop("severity"))


@R.add(f"""WITH {SIDES}, a AS (SELECT l_returnflag AS value, count(*) / sum(count(*)) OVER () AS share_ref FROM r GROUP BY 1), b AS (SELECT l_returnflag AS value, count(*) / sum(count(*)) OVER () AS share_cur FROM c GROUP BY 1)
SELECT value, round(coalesce(share_ref, 0), 6) AS share_ref, round(coalesce(share_cur, 0), 6) AS share_cur FROM a FULL JOIN b USING (value)""")
def compare_distributions(spark, d):
    return rounded(drift.compare_distributions(*sides(spark, d), "l_returnflag"))


@R.add()
def detect_drift(spark, d):
    ref, cur = sides(spark, d)
    out, verdict = drift.detect_drift(ref.drop("l_orderkey"), cur.drop("l_orderkey"), ["l_quantity", "l_returnflag"])
    return out.withColumn("verdict", F.lit(verdict))


@R.add()
def domain_classifier(spark, d):
    ref, cur = sides(spark, d)
    key = F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return drift.domain_classifier(ref.select(key, *cols), cur.select(key, *cols), cols, "k")


GRID = f"""WITH {DAILY}, s AS (SELECT series, min(day) AS a FROM daily GROUP BY 1), g AS (SELECT series, unnest(range(a::TIMESTAMP, (SELECT max(day) FROM daily)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM s),
grid AS (SELECT g.series, g.day, y FROM g LEFT JOIN daily USING (series, day))"""


def grid(spark, d):
    return forecast.fill_grid(daily_orders(spark, d), ["series"], "day")


@R.add(f"{GRID} SELECT series, count(*) AS n, count(*) - count(y) AS gaps FROM grid GROUP BY 1")
def gap_fill(spark, d):
    return grid(spark, d).groupBy("series").agg(F.count("*").alias("n"), F.count_if(F.col("y").isNull()).alias("gaps"))


@R.add(f"""WITH {DAILY}, l AS (SELECT epoch(day) - epoch(lag(day) OVER (PARTITION BY series ORDER BY day)) AS s FROM daily), c AS (SELECT s, count(*) AS n FROM l WHERE s IS NOT NULL GROUP BY 1)
SELECT s::DOUBLE AS step_seconds, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c ORDER BY n DESC, s LIMIT 1""")
def infer_step(spark, d):
    return rounded(forecast.infer_step(daily_orders(spark, d), ["series"], "day"))


LAGGED = "lag(y, {k}) OVER (PARTITION BY series ORDER BY day)"


@R.add(f"{GRID}, f AS (SELECT series, coalesce(y, 0) AS y, day FROM grid), l AS (SELECT series, y, {LAGGED.format(k=1)} AS a, {LAGGED.format(k=7)} AS b FROM f) SELECT series, 1 AS lag, round(corr(y, a), 5) AS acf FROM l GROUP BY 1 UNION ALL SELECT series, 7, round(corr(y, b), 5) FROM l GROUP BY 1")
def season_acf(spark, d):
    return rounded(forecast.autocorrelations(grid(spark, d).fillna(0.0), ["series"], "day", "y", [1, 7]), 5)


@R.add(f"""{GRID} SELECT series, day, {LAGGED.format(k=1)} AS lag_1, {LAGGED.format(k=7)} AS lag_7, CASE WHEN count(y) OVER w = 3 THEN round(avg(y) OVER w, 3) END AS roll_3_mean
FROM grid WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def lag_features(spark, d):
    out = forecast.lag_features(grid(spark, d), ["series"], "day", "y", [1, 7], [3])
    return out.select("series", "day", "lag_1", "lag_7", F.round("roll_3_mean", 3).alias("roll_3_mean"))


@R.add(f"""{GRID}, f AS (SELECT series, day, coalesce(y, 0) AS y, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS r FROM grid)
SELECT series, step::INT AS step, y AS forecast FROM f, (SELECT unnest(range(1, 15)) AS step) WHERE r = 7 - (step - 1) % 7""")
def seasonal_naive(spark, d):
    return forecast.seasonal_naive(grid(spark, d).fillna(0.0), ["series"], "day", "y", 7, 14)


BACK = f"""{GRID}, f AS (SELECT series, coalesce(y, 0) AS y, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS b FROM grid),
bt AS (SELECT a.series, o AS origin, (o * 14 - a.b + 1)::INT AS step, a.y AS actual, p.y AS forecast FROM f a, (SELECT unnest([1, 2, 3]) AS o), f p
  WHERE o * 14 - a.b + 1 BETWEEN 1 AND 14 AND p.series = a.series AND p.b = a.b + ceil((o * 14 - a.b + 1) / 7) * 7)"""


def backtest(spark, d):
    return forecast.backtest_naive(grid(spark, d).fillna(0.0), ["series"], "day", "y", 7, 14)


@R.add(f"{BACK} SELECT * FROM bt")
def backtest_naive(spark, d):
    return backtest(spark, d)


@R.add(f"""{BACK}, sc AS (SELECT series, avg(abs(y - x)) AS scale FROM (SELECT series, y, lead(y, 7) OVER (PARTITION BY series ORDER BY b) AS x FROM f) GROUP BY 1)
SELECT bt.series, count(*) AS n, round(sqrt(avg((forecast - actual) ** 2)), 3) AS rmse, round(avg(abs(forecast - actual)), 3) AS mae, round(100 * sum(abs(forecast - actual)) / sum(abs(actual)), 4) AS wape,
round(100 * sum(forecast - actual) / sum(abs(actual)), 4) AS bias_pct, round(avg(abs(forecast - actual)) / max(scale), 5) AS mase FROM bt JOIN sc USING (series) GROUP BY 1""")
def forecast_metrics(spark, d):
    scale = forecast.mase_scale(grid(spark, d).fillna(0.0), ["series"], "day", "y", 7)
    out = forecast.forecast_metrics(backtest(spark, d).join(scale, "series"), ["series"], scale="scale")
    return out.select("series", "n", *(F.round(c, k).alias(c) for c, k in (("rmse", 3), ("mae", 3), ("wape", 4), ("bias_pct", 4), ("mase", 5))))


@R.add(f"""{BACK}, e AS (SELECT step + k AS step, actual - forecast AS r FROM bt, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) WHERE step + k BETWEEN 1 AND 14),
q AS (SELECT step, quantile_cont(r, 0.1) AS a, quantile_cont(r, 0.9) AS b FROM e GROUP BY 1 HAVING count(*) >= 10)
SELECT step::INT AS step, round(min(a) OVER (ORDER BY step), 3) AS low, round(max(b) OVER (ORDER BY step), 3) AS high FROM q""")
def interval_bands(spark, d):
    errors = backtest(spark, d).select("step", (F.col("actual") - F.col("forecast")).alias("residual"))
    return rounded(forecast.interval_bands(errors, 14), 3)


@R.add()
def ets_panel(spark, d):
    return forecast.holt_winters(grid(spark, d).fillna(0.0), ["series"], "day", "y", 7, 14)


@R.add()
def ets_likelihood(spark, d):
    return forecast.likelihood_smoothing(grid(spark, d).fillna(0.0), ["series"], "day", "y", 7, 14)


@R.add()
def smoothing_weights(spark, d):
    return forecast.smoothing_weights(grid(spark, d).fillna(0.0), ["series"], "day", "y", 7)


@R.add()
def global_forecast(spark, d):
    return forecast.global_forecast(grid(spark, d).fillna(0.0), ["series"], "day", "y", 5, "D", [1, 7], [7])


@R.add(f"""WITH {SCORED}, c AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored WHERE s IS NOT NULL AND y IS NOT NULL GROUP BY s), r AS (SELECT *, row_number() OVER (ORDER BY s) - 1 AS i FROM c),
k AS (SELECT i, s, b, tag, CASE WHEN tag = 1 THEN pos ELSE neg END::BIGINT AS k FROM r, range(0, 501) bs(b), (VALUES (1), (3)) t(tag)),
h AS (SELECT *, (i + 48271 * b + 1000003 * tag + 42) % 2147483647 AS x0, (x0 * x0 + 48271 * x0 + b) % 2147483647 AS x1, (x1 * x1 + 48271 * x1 + tag) % 2147483647 AS x2, ((x2 * x2 + 48271 * x2 + 16807) % 2147483647 + 0.5) / 2147483647 AS u,
  (i + 48271 * b + 1000003 * (tag + 1) + 42) % 2147483647 AS y0, (y0 * y0 + 48271 * y0 + b) % 2147483647 AS y1, (y1 * y1 + 48271 * y1 + tag + 1) % 2147483647 AS y2, ((y2 * y2 + 48271 * y2 + 16807) % 2147483647 + 0.5) / 2147483647 AS v FROM k),
cdf AS (SELECT k, list(p ORDER BY x) AS p FROM (SELECT k, x, sum(exp(-k + x * ln(k) - lgamma(x + 1))) OVER (PARTITION BY k ORDER BY x) AS p FROM range(1, 30) a(k), range(0, 120) xs(x)) GROUP BY k),
d AS (SELECT i, s, b, tag, CASE WHEN b = 0 OR h.k = 0 THEN h.k WHEN h.k < 30 THEN len(list_filter(cdf.p, lambda q: q < u)) ELSE greatest(0, floor(h.k + sqrt(h.k) * sqrt(-2 * ln(u)) * cos(2 * pi() * v) + 0.5)) END::DOUBLE AS w FROM h LEFT JOIN cdf ON h.k = cdf.k),
n AS (SELECT i, s, b, sum(w) FILTER (tag = 1) AS p, sum(w) FILTER (tag = 3) AS n FROM d GROUP BY 1, 2, 3),
t AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM n WINDOW w AS (PARTITION BY b ORDER BY i DESC)),
m AS (SELECT b, sum(p) FILTER (s >= 0.5) / nullif(sum(p + n) FILTER (s >= 0.5), 0) AS precision, sum(p) FILTER (s >= 0.5) / nullif(sum(p), 0) AS recall, 2 * sum(p) FILTER (s >= 0.5) / nullif(sum(p + n) FILTER (s >= 0.5) + sum(p), 0) AS f1,
  sum(p + n) FILTER (s >= 0.5) / sum(p + n) AS alert_rate, sum(p * (1 - s) ** 2 + n * s ** 2) / sum(p + n) AS brier, sum(n * (tp - p / 2)) / nullif(sum(p) * sum(n), 0) AS roc_auc, sum(CASE WHEN p > 0 THEN p * tp / (tp + fp) END) / nullif(sum(p), 0) AS average_precision FROM t GROUP BY b),
l AS (UNPIVOT m ON precision, recall, f1, alert_rate, brier, roc_auc, average_precision INTO NAME metric VALUE x)
SELECT metric, round(max(x) FILTER (b = 0), 7) AS value, round(quantile_cont(x, 0.025) FILTER (b > 0), 7) AS low, round(quantile_cont(x, 0.975) FILTER (b > 0), 7) AS high FROM l GROUP BY metric""")
def bootstrap_intervals(spark, d):
    return rounded(metrics.bootstrap(scored_documents(spark, d), "y", "s"), 7)
