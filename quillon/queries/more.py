"""Queries on panels, segments, detectors, later data and run evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import basics
from quillon.operators import anomaly, density, explain, fitted, forecast, ledger, metrics, models, screens, segments, splits
from quillon.queries.common import ORDERS, SCORED, Registry, events, order_totals, rounded, scored_documents
from quillon.queries.evaluation import BACK, GRID, backtest, grid
from quillon.queries.later import M, SCORES, W, li_key, scores
from quillon.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
SCALE = "sc AS (SELECT series, avg(abs(y - x)) AS scale FROM (SELECT series, y, lead(y, 7) OVER (PARTITION BY series ORDER BY b) AS x FROM f) GROUP BY 1)"


def scales(spark, d):
    return forecast.mase_scale(grid(spark, d).fillna(0.0), ["series"], "day", "y", 7)


def flat(spark, d):
    """The seasonal naive's backtest, shrunk by a tenth."""
    return backtest(spark, d).withColumn("forecast", F.round(F.col("forecast") * 0.9, 4))


@R.add(f"""{BACK}, {SCALE}, own AS (SELECT series, avg(abs(round(forecast * 0.9, 4) - actual)) / max(scale) AS mase, avg(abs(round(forecast * 0.9, 4) - actual)) AS m, avg(abs(forecast - actual)) AS b FROM bt JOIN sc USING (series) GROUP BY 1)
SELECT (SELECT count(*) FROM own) AS series, count(*) AS n, round(100 * sum(abs(round(forecast * 0.9, 4) - actual)) / sum(abs(actual)), 4) AS wape, round(sqrt(avg((round(forecast * 0.9, 4) - actual) ** 2)), 3) AS rmse,
(SELECT round(quantile_cont(mase, 0.5), 5) FROM own) AS median_mase, (SELECT round(avg((m < b)::INT), 6) FROM own) AS beat_naive_share FROM bt""")
def panel_report(spark, d):
    out = forecast.panel_report(flat(spark, d), backtest(spark, d), ["series"], scales(spark, d))
    return out.select("series", "n", F.round("wape", 4).alias("wape"), F.round("rmse", 3).alias("rmse"), F.round("median_mase", 5).alias("median_mase"), F.round("beat_naive_share", 6).alias("beat_naive_share"))


@R.add(f"""{BACK} SELECT series, count(*) AS n, round(100 * sum(abs(forecast - actual)) / sum(abs(actual)), 4) AS wape, round(100 * sum(forecast - actual) / sum(abs(actual)), 4) AS bias_pct FROM bt GROUP BY 1
ORDER BY sum(abs(forecast - actual)) / sum(abs(actual)) DESC, series LIMIT 3""")
def worst_series(spark, d):
    return rounded(forecast.worst_series(backtest(spark, d), ["series"], 3), 4)


@R.add(f"{BACK}, {SCALE} SELECT series, step, round((forecast - actual) / scale, 5) AS error FROM bt JOIN sc USING (series)")
def scaled_errors(spark, d):
    return rounded(forecast.scaled_errors(backtest(spark, d), scales(spark, d), ["series"]), 5)


@R.add(f"{BACK} SELECT series, CASE WHEN min(abs(actual)) >= 1e-3 * avg(abs(actual)) THEN round(100 * avg(abs(forecast - actual) / abs(actual)), 4) END AS mape FROM bt GROUP BY 1")
def panel_mape(spark, d):
    return rounded(forecast.mape(backtest(spark, d), ["series"]), 4)


@R.add("""WITH p AS (SELECT o_custkey AS series, o_orderdate::DATE AS day FROM orders), t AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM p)),
s AS (SELECT day AS start FROM t WHERE i = greatest(0, n - 200)), g AS (SELECT series, count(*) AS n, max(day) AS last FROM p GROUP BY 1)
SELECT series, n, last, CASE WHEN last < start THEN 'stale' WHEN n < 200 + 12 THEN 'too_short' ELSE 'usable' END AS status FROM g, s""")
def panel_status(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("series"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("y"))
    return forecast.panel_status(rows, ["series"], "day", "y", 200, 1, 7)


DENSE = """p AS (SELECT o_custkey AS k, count(*) / 2.0 AS a, avg(o_totalprice) / 20000.0 AS b FROM orders GROUP BY 1),
near AS MATERIALIZED (SELECT x.k, y.k AS j FROM p x JOIN p y ON (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) <= 0.09),
core AS MATERIALIZED (SELECT k FROM near GROUP BY 1 HAVING count(*) >= 6), link AS MATERIALIZED (SELECT n.k, n.j FROM near n JOIN core a ON a.k = n.k JOIN core b ON b.k = n.j),
cc(k, g) USING KEY (k) AS (SELECT k, k FROM core UNION SELECT l.k, min(c.g) FROM cc c JOIN link l ON l.j = c.k JOIN recurring.cc r ON r.k = l.k WHERE c.g < r.g GROUP BY l.k)"""


@R.add(f"""WITH RECURSIVE {DENSE}, edge AS (SELECT n.k, min(c.g) AS g FROM near n JOIN cc c ON c.k = n.j WHERE n.k NOT IN (SELECT k FROM core) GROUP BY 1)
SELECT p.k AS customer, coalesce(cc.g, edge.g, -1) AS segment FROM p LEFT JOIN cc ON cc.k = p.k LEFT JOIN edge ON edge.k = p.k""")
def dbscan_customers(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg((F.count("*") / 2.0).alias("a"), (F.avg("o_totalprice") / 20000.0).alias("b"))
    return density.dbscan(per, "customer", ["a", "b"], 0.3, 6)


PANEL = """{n}t AS (SELECT {key} AS series, {at} AS moment, sum({y}) AS y FROM {table} GROUP BY 1, 2),
{n}g AS (SELECT series, unnest(generate_series(min(moment), (SELECT max(moment) FROM {n}t), INTERVAL '{step}')) AS moment FROM {n}t GROUP BY 1),
{n} AS (SELECT '{n}' AS panel, series, moment, y, row_number() OVER (PARTITION BY series ORDER BY moment DESC) AS r FROM {n}g LEFT JOIN {n}t USING (series, moment))"""
PANELS = ", ".join([
    PANEL.format(n="weekly", key="'all'", at="date_trunc('week', o_orderdate)::TIMESTAMP", y="o_totalprice", table="orders", step="7 days"),
    PANEL.format(n="monthly", key="o_orderpriority", at="date_trunc('month', o_orderdate)::TIMESTAMP", y="o_totalprice", table="orders", step="1 month"),
    PANEL.format(n="half_daily", key="'all'", at="date_trunc('day', ts)::TIMESTAMP + INTERVAL 12 HOURS * (hour(ts) // 12)", y="value", table="events", step="12 hours"),
])


@R.add(f"""WITH {PANELS}, a AS (SELECT * FROM weekly UNION ALL SELECT * FROM monthly UNION ALL SELECT * FROM half_daily)
SELECT panel, series, moment, round(y, 0) AS y, CASE WHEN r <= 8 THEN 'test' ELSE 'train' END AS fold FROM a""")
def prepare_forecast(spark, d):
    o, e = table(spark, d, "orders"), events(spark, d)
    panels = {
        "weekly": o.select(F.lit("all").alias("series"), F.date_trunc("week", "o_orderdate").alias("moment"), F.col("o_totalprice").alias("y")),
        "monthly": o.select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("moment"), F.col("o_totalprice").alias("y")),
        "half_daily": e.select(F.lit("all").alias("series"), (F.date_trunc("day", "ts") + F.make_dt_interval(hours=12 * F.floor(F.hour("ts") / 12).cast("int"))).alias("moment"), F.col("value").alias("y")),
    }
    panels["monthly"] = panels["monthly"].withColumn("moment", F.date_trunc("month", "moment"))
    out = None
    for name, rows in panels.items():
        one = forecast.prepare_forecast(rows, "moment", "y", 8, ["series"])[0].select(F.lit(name).alias("panel"), "series", "moment", F.round("y", 0).alias("y"), "fold")
        out = one if out is None else out.unionByName(one)
    return out


@R.add(f"""{BACK}, e AS (SELECT step + k AS step, actual - forecast AS r FROM bt, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) WHERE step + k BETWEEN 1 AND 14),
q AS (SELECT step, quantile_cont(r, 0.1) AS a, quantile_cont(r, 0.9) AS b FROM e GROUP BY 1 HAVING count(*) >= 10), w AS (SELECT step, min(a) OVER (ORDER BY step) AS low, max(b) OVER (ORDER BY step) AS high FROM q),
h AS (SELECT s.series, s.step, f.y AS forecast FROM (SELECT DISTINCT series, unnest(range(1, 22)) AS step FROM f) s JOIN f ON f.series = s.series AND f.b = 7 - (s.step - 1) % 7)
SELECT series, h.step::INT AS step, round(forecast, 3) AS forecast, round(forecast + low, 3) AS low, round(forecast + high, 3) AS high FROM h LEFT JOIN w ON w.step = least(h.step, (SELECT max(step) FROM w))""")
def serve_forecast(spark, d):
    errors = backtest(spark, d).select("step", (F.col("actual") - F.col("forecast")).alias("residual"))
    return rounded(forecast.serve(grid(spark, d).fillna(0.0), ["series"], "day", "y", 7, 21, forecast.interval_bands(errors, 14)), 3)


@R.add("""WITH x AS (SELECT l_returnflag AS segment, l_quantity / 50.0 AS a, l_discount * 10 AS b FROM lineitem), c AS (SELECT segment, avg(a) AS ma, avg(b) AS mb FROM x GROUP BY 1),
s AS (SELECT x.segment, any_value(ma) AS ma, any_value(mb) AS mb, avg(sqrt((a - ma) ** 2 + (b - mb) ** 2)) AS s FROM x JOIN c USING (segment) GROUP BY 1),
r AS (SELECT p.segment, max((p.s + q.s) / sqrt((p.ma - q.ma) ** 2 + (p.mb - q.mb) ** 2)) AS r FROM s p JOIN s q ON p.segment != q.segment GROUP BY 1) SELECT round(avg(r), 4) AS davies_bouldin FROM r""")
def davies_bouldin(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("segment"), (F.col("l_quantity") / 50.0).alias("a"), (F.col("l_discount") * 10).alias("b"))
    return rounded(segments.davies_bouldin(rows.withColumn("segment", F.ascii("segment")), ["a", "b"]), 4)


@R.add("SELECT o_orderpriority AS segment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def segment_sizes(spark, d):
    return rounded(segments.segment_sizes(table(spark, d, "orders").select(F.col("o_orderpriority").alias("segment"))))


@R.add("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, greatest(0, ceil(r * 4 / (n - 1)) - 1)::INT AS "group" FROM r""")
def quantile_groups(spark, d):
    return metrics.quantile_groups(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"], 4).select("o_orderkey", "group")


LATER = f"""WITH {SCORED}, side AS (SELECT *, doc_id % 3 = 0 AS later FROM scored), c AS (SELECT later, s, sum(y) AS pos, sum(1 - y) AS neg FROM side GROUP BY ALL),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY later) AS p FROM c WINDOW w AS (PARTITION BY later ORDER BY s DESC)), a AS (SELECT later, sum(pos * tp / (tp + fp)) / max(p) AS ap FROM k GROUP BY 1)"""


@R.add(f"""{LATER} SELECT count(*) AS n, round(avg(y), 6) AS positive_rate, round(avg((s >= 0.5)::INT), 6) AS alert_rate, round(sum(y) FILTER (s >= 0.5) / count(*) FILTER (s >= 0.5), 6) AS precision, round(sum(y) FILTER (s >= 0.5) / sum(y), 6) AS recall,
(SELECT round(ap, 6) FROM a WHERE later) AS average_precision, (SELECT round(max(ap) FILTER (later) - max(ap) FILTER (NOT later), 6) FROM a) AS ap_change FROM side WHERE later""")
def later_backtest(spark, d):
    s = scored_documents(spark, d)
    return rounded(metrics.later_backtest(s.where("doc_id % 3 != 0"), s.where("doc_id % 3 = 0"), "y", "s", 0.5))


@R.add(f"""WITH {ORDERS}, e AS (SELECT o_totalprice - pred AS e FROM ot WHERE pred IS NOT NULL), m AS (SELECT min(e) AS lo, (max(e) - min(e)) / 20 AS w FROM e)
SELECT least(floor((e - lo) / w), 19)::INT AS bin, round(lo + least(floor((e - lo) / w), 19) * w, 3) AS low, round(lo + (least(floor((e - lo) / w), 19) + 1) * w, 3) AS high, count(*) AS n FROM e, m GROUP BY 1, 2, 3""")
def residual_histogram(spark, d):
    return rounded(metrics.residual_histogram(order_totals(spark, d), "o_totalprice", "pred", 20), 3)


@R.add("""WITH c AS (SELECT toxic::VARCHAR AS v, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1) SELECT arg_min(v, n) AS anomaly, round(min(n) / sum(n), 6) AS share FROM c HAVING count(*) = 2""")
def rarer_label(spark, d):
    return rounded(anomaly.rarer_label(table(spark, d, "labels"), "toxic"))


DETECT = f"""WITH {SCORES}, x AS (SELECT k, y, score AS a, 1 - score / 4 AS b FROM s)"""


@R.add(f"""{DETECT}, u AS (SELECT 'a' AS detector, y, a AS s FROM x UNION ALL SELECT 'b', y, b FROM x), c AS (SELECT detector, s, sum(y) AS pos, count(*) - sum(y) AS neg FROM u GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY detector) AS p FROM c WINDOW w AS (PARTITION BY detector ORDER BY s DESC)), v AS (SELECT detector, sum(pos * tp / (tp + fp)) / max(p) AS value FROM t GROUP BY 1)
SELECT detector, round(value, 6) AS value, row_number() OVER (ORDER BY value DESC, detector)::INT AS place FROM v""")
def compare_detectors(spark, d):
    both = scores(spark, d).select("k", "y", F.col("score").alias("a"), (1 - F.col("score") / 4).alias("b"))
    return rounded(anomaly.compare_detectors(both, ["k"], ["a", "b"], 0.01, "y"))


@R.add()
def alert_stability(spark, d):
    return anomaly.alert_stability(li_key(spark, d), ["k"], 0.01, lambda rows, fit_on: anomaly.isolation_forest(rows, ["l_quantity", "l_extendedprice"], ["k"], trees=20, fit_on=fit_on), refits=3)


@R.add("""WITH p AS (SELECT round(0.02 * (l_quantity - 25), 9) AS a, round(-3 * (l_discount - 0.05), 9) AS b, round(1.5 * (l_tax - 0.04), 9) AS c FROM lineitem), u AS (SELECT 'l_quantity' AS column_name, avg(abs(a)) AS m, avg(a) AS s FROM p UNION ALL SELECT 'l_discount', avg(abs(b)), avg(b) FROM p UNION ALL SELECT 'l_tax', avg(abs(c)), avg(c) FROM p)
SELECT column_name, round(m, 4) AS mean_abs, round(s, 4) + 0.0 AS mean_signed, row_number() OVER (ORDER BY m DESC, column_name)::INT AS place FROM u""")
def attribution_ranking(spark, d):
    phi = explain.linear_attribution(li_key(spark, d), "k", W, M, 0.1).select(F.transform("phi", lambda x: x["value"]).alias("phi"))
    return rounded(explain.attribution_ranking(phi, list(W)), 4)


@R.add("""WITH l AS (SELECT user_id AS run_id, event_id AS seq, event_type AS tool FROM events), r AS (SELECT DISTINCT run_id FROM l), g AS (SELECT run_id, gate, tool FROM r, (VALUES ('seen', 'view'), ('seen', 'click'), ('bought', 'purchase')) v(gate, tool)),
z AS (SELECT run_id, tool, max(seq) AS seq FROM l GROUP BY ALL) SELECT g.run_id, gate, CASE WHEN max(seq) IS NULL THEN 'not_run' ELSE 'pass' END AS status FROM g LEFT JOIN z ON z.run_id = g.run_id AND z.tool = g.tool GROUP BY 1, 2
UNION ALL SELECT r.run_id, 'evidence_ordering', CASE WHEN NOT EXISTS (SELECT 1 FROM z WHERE z.run_id = r.run_id AND tool IN ('view', 'click', 'purchase')) THEN 'not_run' ELSE 'pass' END FROM r""")
def evidence_gates(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), F.lit(True).alias("ok"))
    rules = {"review": [("seen", ["view", "click"]), ("bought", ["purchase"])]}
    return ledger.evidence_gates(rows, rows.select("run_id", F.lit("review").alias("task")).distinct(), rules)


@R.add("""SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS label, round(greatest(0, exp(ln(1 + o_totalprice)) - 1), 2) AS prediction FROM orders""")
def log_target(spark, d):
    out = models.log_target(table(spark, d, "orders"), "o_totalprice").withColumn("prediction", F.col("label"))
    return models.from_log(out).select("o_orderkey", F.round("label", 6).alias("label"), F.round("prediction", 2).alias("prediction"))


@R.add()
def label_rule_tree(spark, d):
    return screens.label_rule_tree(table(spark, d, "lineitem"), "l_returnflag", "R", ["l_quantity", "l_extendedprice", "l_discount"], 0.5)


@R.add("""WITH a AS (SELECT (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) + 1) / 2.0 - 1) AS ra, (rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) + 1) / 2.0 - 1) AS rb FROM lineitem)
SELECT 'l_quantity' AS column_name, round(abs(corr(ra, rb)), 6) AS signal FROM a""")
def regression_signal(spark, d):
    return rounded(screens.regression_signal(table(spark, d, "lineitem"), "l_extendedprice", "l_orderkey", ["l_quantity"], []))


@R.add("SELECT 'y' AS column_name FROM (SELECT 1) WHERE (SELECT count(*) FROM labels) > 0")
def label_copies(spark, d):
    rows = table(spark, d, "labels").select("toxic", F.when(F.col("toxic") == 1, "bad").otherwise("good").alias("y"), F.col("quality").cast("string").alias("q"))
    return screens.label_copies(rows, "toxic")


def prepared(out):
    return out[0].groupBy("fold").agg(F.count("*").alias("n"))


@R.add("""WITH r AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT CASE WHEN r < floor(n * 0.8) THEN 'train' ELSE 'test' END AS fold, count(*) AS n FROM r GROUP BY 1""")
def prepare_regression(spark, d):
    return prepared(splits.prepare_regression(table(spark, d, "orders"), "o_totalprice", "o_orderkey", time="o_orderdate"))


@R.add("""SELECT CASE WHEN ('0x' || substr(md5(c_custkey || '42'), 1, 8))::BIGINT % 1000 < 200 THEN 'test' ELSE 'train' END AS fold, count(*) AS n FROM customer GROUP BY 1""")
def prepare_clustering(spark, d):
    return prepared(splits.prepare_clustering(table(spark, d, "customer"), "c_custkey"))


@R.add("""SELECT CASE WHEN ('0x' || substr(md5(doc_id || '42'), 1, 8))::BIGINT % 1000 < 200 THEN 'test' ELSE 'train' END AS fold, count(*) AS n FROM labels GROUP BY 1""")
def prepare_anomaly(spark, d):
    return prepared(splits.prepare_anomaly(table(spark, d, "labels"), "doc_id", "toxic", group="doc_id"))


@R.add("""SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS dow, (isodow(ts) >= 6)::INT AS is_weekend, day(ts)::INT AS day, week(ts)::INT AS week, month(ts)::INT AS month, quarter(ts)::INT AS quarter, year(ts)::INT AS year FROM events""")
def calendar_features(spark, d):
    made = basics.calendar(F.col("ts").cast("timestamp"))
    return events(spark, d).select("event_id", *(c.cast("int").alias(n) for n, c in made.items()))


FILLED = "last_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@R.add(f"{GRID} SELECT series, day, {FILLED} AS y FROM grid")
def fill_forward(spark, d):
    return fitted.fill_forward(grid(spark, d), ["series"], "day", ["y"])


@R.add(f"""{GRID}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS i FROM grid), k AS (SELECT series, day, y, i,
  last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia, {FILLED} AS ya, first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ib, first_value(y IGNORE NULLS) OVER a AS yb
  FROM n WINDOW b AS (PARTITION BY series ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, day, round(CASE WHEN y IS NOT NULL THEN y WHEN ib IS NULL THEN ya ELSE ya + (yb - ya) * (i - ia) / (ib - ia) END, 6) AS y FROM k""")
def interpolate(spark, d):
    return fitted.interpolate(grid(spark, d), ["series"], "day", "y").select("series", "day", F.round("y", 6).alias("y"))


@R.add("SELECT l_returnflag AS series, l_shipdate::DATE AS day, max(l_extendedprice) AS y, round(avg(l_discount), 6) AS l_discount FROM lineitem GROUP BY 1, 2")
def aggregate_series(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("y"), "l_discount")
    return forecast.aggregate_series(rows, ["series"], "day", "y", "max", ["l_discount"]).withColumn("l_discount", F.round("l_discount", 6))


@R.add("SELECT count(*) AS n, max(o_orderdate) <= TIMESTAMP '1995-06-30' AS settled FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-30'")
def settled_labels(spark, d):
    return splits.mature(table(spark, d, "orders"), "o_orderdate", "1995-06-30").agg(F.count("*").alias("n"), (F.max("o_orderdate") <= F.lit("1995-06-30").cast("timestamp")).alias("settled"))


@R.add("""WITH r AS (SELECT o_orderstatus AS y, floor((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) * 4 / count(*) OVER ())::INT AS block FROM orders), p AS (SELECT DISTINCT block, y FROM r),
f AS (SELECT y, min(block) AS first FROM p GROUP BY 1), g AS (SELECT block, count(*) AS classes, count(*) FILTER (first = block) AS unseen FROM p JOIN f USING (y) GROUP BY 1) SELECT * FROM g WHERE block > 0 AND classes >= 2 AND unseen = 0""")
def usable_folds(spark, d):
    return splits.usable_folds(splits.expanding_folds(table(spark, d, "orders"), "o_orderdate", ["o_orderkey"], 3), "o_orderstatus")


@R.add(f"""{GRID}, z AS (SELECT avg((y IS NULL)::INT) AS m FROM grid) SELECT 'y' AS column_name, round(m, 6) AS missing_share, CASE WHEN m > 0.5 THEN 'drop' ELSE 'median' END AS strategy FROM z WHERE m > 0""")
def propose_imputation(spark, d):
    return rounded(fitted.propose_imputation(grid(spark, d).select("series", "y")))


@R.add(f"""{GRID}, f AS (SELECT series, day, coalesce(y, 0) AS y, coalesce(y, 0) * 2 + 1 AS twice, (day - DATE '1992-01-01')::DOUBLE AS t FROM grid), n AS (SELECT *, lead(y) OVER (PARTITION BY series ORDER BY day) AS nxt FROM f),
u AS (SELECT 'twice' AS column_name, corr(twice, y) AS a, corr(twice, nxt) AS b FROM n UNION ALL SELECT 't', corr(t, y), corr(t, nxt) FROM n) SELECT column_name, round(a, 5) AS corr_now, round(b, 5) AS corr_next, abs(a) >= 0.98 OR abs(b) >= 0.98 AS leak FROM u""")
def forecast_leakage(spark, d):
    rows = grid(spark, d).fillna(0.0).withColumns({"twice": F.col("y") * 2 + 1, "t": F.datediff("day", F.lit("1992-01-01").cast("date")).cast("double")})
    return rounded(screens.forecast_leakage(rows, ["series"], "day", "y", ["twice", "t"]), 5)


@R.add("""WITH b AS (SELECT coalesce(lang, '__missing__') AS v, (('0x' || substr(md5(doc_id || ''), 1, 8))::BIGINT % 5)::INT AS fold, toxic AS y FROM documents JOIN labels USING (doc_id)), m AS (SELECT avg(y) AS mean FROM b), p AS (SELECT v, fold, sum(y) AS p, count(*) AS n FROM b GROUP BY ALL)
SELECT v AS value, fold, round(coalesce((sum(p) OVER w - p) / nullif(sum(n) OVER w - n, 0), mean), 6) AS rate FROM p, m WINDOW w AS (PARTITION BY v)""")
def out_of_fold_rates(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rounded(screens.out_of_fold_rates(rows, "lang", F.col("toxic"), screens.hash_fold(F.col("doc_id"), 5)).select("value", "fold", "rate"))


@R.add("""WITH m AS (SELECT user_id AS run_id, event_type AS metric, avg(value) AS value FROM events GROUP BY ALL), b AS (SELECT DISTINCT user_id AS run_id FROM events)
SELECT b.run_id, 'purchase' AS metric, round(value, 6) AS value, coalesce(value >= 50, false) AS met FROM b LEFT JOIN m ON m.run_id = b.run_id AND m.metric = 'purchase'""")
def criteria_met(spark, d):
    e = events(spark, d)
    values = e.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    bars = e.select(F.col("user_id").alias("run_id"), F.lit("purchase").alias("metric"), F.lit(50.0).alias("bar"), F.lit("min").alias("direction")).distinct()
    return rounded(ledger.criteria_met(values, bars))
