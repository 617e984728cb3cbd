"""Queries on segments, anomalies, models, explanations and run ledgers."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quillon.operators import anomaly, explain, ledger, metrics, models, segments
from quillon.operators.events import aggregate_events
from quillon.operators.ranking import column_medians
from quillon.operators.screens import hash_fold
from quillon.plans.recipes import recipe
from quillon.queries.common import Registry, events, rounded
from quillon.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def weekly_segments(spark, d):
    """(user_id, week, segment): the user's commonest event type of a week, the first in the alphabet on ties."""
    e = events(spark, d).groupBy("user_id", F.date_trunc("week", F.col("ts")).cast("date").alias("week"), "event_type").count()
    return e.groupBy("user_id", "week").agg(F.min(F.struct(-F.col("count"), "event_type"))["event_type"].alias("segment"))


WEEKLY = """c AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n FROM events GROUP BY ALL),
seg AS (SELECT user_id, week, event_type AS segment FROM (SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1),
moves AS (SELECT * FROM (SELECT user_id, week, segment AS "from", lead(segment) OVER (PARTITION BY user_id ORDER BY week) AS "to" FROM seg) WHERE "to" IS NOT NULL)"""


def moves(spark, d):
    return segments.transitions(weekly_segments(spark, d), "user_id", "week", "segment")


@R.add(f"""WITH {WEEKLY}, g AS (SELECT "from", "to", count(*) AS n FROM moves GROUP BY ALL) SELECT "from", "to", n, round(n / sum(n) OVER (PARTITION BY "from"), 6) AS share FROM g""")
def migration_matrix(spark, d):
    return rounded(segments.migration_matrix(moves(spark, d)))


@R.add(f"""WITH {WEEKLY} SELECT "from" AS segment, count(*) AS n, round(avg(("from" = "to")::INT), 6) AS stay_rate FROM moves GROUP BY ROLLUP ("from")""")
def stay_rate(spark, d):
    return rounded(segments.stay_rates(moves(spark, d)))


@R.add(f"""WITH {WEEKLY} SELECT week, count(*) AS n, round(avg(("from" != "to")::INT), 6) AS moved_share FROM moves GROUP BY 1""")
def moved_by_week(spark, d):
    return rounded(segments.moved_by_step(moves(spark, d), "week"))


@R.add("""WITH a AS (SELECT avg(o_totalprice) AS g FROM orders), p AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT round(sum(n * (m - g) ** 2) / (sum(n * (m - g) ** 2) + sum(n * v)), 8) AS eta_squared FROM p, a""")
def eta_squared(spark, d):
    return rounded(segments.eta_squared(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 8)


@R.add("""WITH t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS m FROM t),
x AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY b))
SELECT round((s.s - x.s * y.s / (m * (m - 1) / 2)) / ((x.s + y.s) / 2 - x.s * y.s / (m * (m - 1) / 2)), 8) AS ari FROM s, x, y""")
def adjusted_rand(spark, d):
    return rounded(segments.adjusted_rand(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"), 8)


@R.add("""WITH t AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)
SELECT o_orderstatus AS segment, 'o_totalprice' AS column_name, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round((avg(o_totalprice) - max(m)) / max(s), 5) AS mean_z FROM orders, t GROUP BY 1""")
def segment_profiles(spark, d):
    out = segments.profiles(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "segment"), ["o_totalprice"])
    return out.select("segment", "column_name", "n", F.round("share", 6).alias("share"), F.round("median", 4).alias("median"), F.round("mean_z", 5).alias("mean_z"))


@R.add("""WITH c AS (SELECT vec_id AS centre, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 10), x AS (
  SELECT vec_id, centre, list_distance(embedding::DOUBLE[], v) AS dist FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, centre) AS r FROM x) SELECT vec_id, centre, round(dist, 6) AS distance FROM r WHERE r = 1""")
def nearest_centroid(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    centres = v.where("vec_id < 10").select(F.col("vec_id").alias("centre"), F.col("embedding").alias("v"))
    return rounded(segments.nearest_centre(v, centres))


def vectors(spark, d):
    from pyspark.ml.functions import array_to_vector

    return table(spark, d, "embeddings").withColumn("space", array_to_vector(F.col("embedding").cast("array<double>")))


@R.add()
def kmeans_profiles(spark, d):
    v = vectors(spark, d)
    scored = segments.fit(v, "kmeans", 8).transform(v)
    return scored.groupBy("segment").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))


@R.add()
def kmeans_stability(spark, d):
    return segments.stability(vectors(spark, d), "vec_id", "kmeans", 4)


@R.add()
def gower_medoids(spark, d):
    space, _ = segments.distance_space(table(spark, d, "customer"), ["c_acctbal"], ["c_mktsegment"], gower=True)
    return segments.k_medoids(space, 5, key=["c_custkey"]).groupBy("segment").agg(F.count("*").alias("n"))


def li_key(spark, d):
    return table(spark, d, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_extendedprice")))


Z = ["l_quantity", "l_extendedprice", "l_discount"]
REF = " UNION ALL ".join(f"SELECT '{c}' AS column_name, quantile_cont({c}, 0.5) AS centre, CASE WHEN quantile_cont({c}, 0.75) > quantile_cont({c}, 0.25) THEN (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.349 WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) ELSE 1 END AS scale FROM lineitem" for c in Z)


@R.add(f"WITH r AS ({REF}) SELECT column_name, round(centre, 6) AS centre, round(scale, 6) AS scale FROM r")
def robust_reference(spark, d):
    return rounded(anomaly.robust_reference(table(spark, d, "lineitem"), Z))


LONG = " UNION ALL ".join(f"SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT) AS k, '{c}' AS column_name, {c}::DOUBLE AS value FROM lineitem" for c in Z)


@R.add(f"""WITH r AS ({REF}), x AS ({LONG}), z AS (SELECT k, column_name, round((value - centre) / scale, 2) AS z FROM x JOIN r USING (column_name)),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(z) DESC, column_name) AS i FROM z WHERE abs(z) >= 1.3)
SELECT k, string_agg(column_name || CASE WHEN z > 0 THEN ' high (z=' ELSE ' low (z=' END || printf('%.2f', z) || ')', '; ' ORDER BY i) AS reasons FROM t WHERE i <= 2 GROUP BY 1""")
def row_reasons(spark, d):
    li = li_key(spark, d)
    return anomaly.row_reasons(li, ["k"], Z, anomaly.robust_reference(li, Z), top=2, least=1.3)


SCORE = "round(abs(l_quantity - 25) / 25 + l_discount * 3, 4)"
SCORES = f"s AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT) AS k, {SCORE} AS score, (l_returnflag = 'R')::INT AS y FROM lineitem)"


def scores(spark, d):
    return li_key(spark, d).select("k", F.expr(SCORE).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


@R.add(f"WITH {SCORES} SELECT k, score FROM s ORDER BY score DESC, k LIMIT (SELECT greatest(1, round_even(0.01 * count(*), 0))::INT FROM s)")
def queue_at_budget(spark, d):
    return anomaly.review_queue(scores(spark, d), 0.01, ["k"]).select("k", "score")


@R.add(f"""WITH {SCORES}, q AS (SELECT * FROM s ORDER BY score DESC, k LIMIT (SELECT greatest(1, round_even(0.01 * count(*), 0))::INT FROM s)), a AS (SELECT sum(y) AS a, count(*) AS n FROM s)
SELECT count(*) AS k, round(sum(y) / count(*), 6) AS precision, round(sum(y) / max(a), 6) AS recall, round(sum(y) / count(*) / (max(a) / max(n)), 6) AS lift FROM q, a""")
def queue_metrics(spark, d):
    return rounded(anomaly.queue_metrics(scores(spark, d), "y", 0.01, ["k"]))


@R.add(f"""WITH {SCORES} SELECT y, round(quantile_cont(score, 0.5), 5) AS p50, round(quantile_cont(score, 0.9), 5) AS p90, round(quantile_cont(score, 0.95), 5) AS p95, round(quantile_cont(score, 0.99), 5) AS p99, max(score) AS max FROM s GROUP BY 1""")
def score_distribution(spark, d):
    return rounded(anomaly.score_percentiles(scores(spark, d), ["y"]), 5)


@R.add("""WITH p AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT) AS k, (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2) / count(*) OVER () AS a,
  (rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2) / count(*) OVER () AS b FROM lineitem)
SELECT k, round((a + b) / 2, 9) AS consensus FROM p""")
def rank_consensus(spark, d):
    return rounded(anomaly.consensus(li_key(spark, d).select("k", "l_quantity", "l_discount"), ["k"], ["l_quantity", "l_discount"]), 9)


TAILS = "t{i} AS (SELECT {c} AS v, -ln(sum(count(*)) OVER (ORDER BY {c}) / sum(count(*)) OVER ()) AS l, -ln(sum(count(*)) OVER (ORDER BY {c} DESC) / sum(count(*)) OVER ()) AS r FROM lineitem GROUP BY 1), w{i} AS (SELECT sum(({c} - m) ** 3) < 0 AS neg FROM lineitem, (SELECT avg({c}) AS m FROM lineitem))"
ECOD = ", ".join(TAILS.format(i=i, c=c) for i, c in enumerate(("l_quantity", "l_extendedprice")))


@R.add(f"""WITH {ECOD} SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT) AS k, round(greatest(t0.l + t1.l, t0.r + t1.r, CASE WHEN w0.neg THEN t0.l ELSE t0.r END + CASE WHEN w1.neg THEN t1.l ELSE t1.r END), 5) AS score
FROM lineitem JOIN t0 ON t0.v = l_quantity JOIN t1 ON t1.v = l_extendedprice, w0, w1""")
def ecod_scores(spark, d):
    return rounded(anomaly.ecod(li_key(spark, d), ["l_quantity", "l_extendedprice"], ["k"]), 5)


@R.add()
def iforest_scores(spark, d):
    return anomaly.isolation_forest(li_key(spark, d), Z, ["k"])


NEAR = """s AS (SELECT avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS mb, stddev_pop(l_extendedprice) AS sb, avg(l_discount) AS mc, stddev_pop(l_discount) AS sc FROM lineitem),
z AS MATERIALIZED (SELECT row_number() OVER () AS i, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT) AS k, (l_quantity - ma) / sa AS a, (l_extendedprice - mb) / sb AS b, (l_discount - mc) / sc AS c FROM lineitem, s),
kd AS MATERIALIZED (SELECT x.i, list_max(min(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2), 10)) AS reach FROM z x JOIN z y ON x.i != y.i GROUP BY 1)"""


@R.add(f"WITH {NEAR} SELECT k, round(reach, 6) AS score FROM z JOIN kd USING (i)")
def knn_scores(spark, d):
    return rounded(anomaly.neighbours(li_key(spark, d), Z, ["k"], "knn", 10, exact=True))


@R.add(f"""WITH {NEAR}, w AS MATERIALIZED (SELECT *, b - reach * (1 + 1e-9) AS lo, b + reach * (1 + 1e-9) AS hi FROM z JOIN kd USING (i)),
p AS MATERIALIZED (SELECT x.i, y.i AS j, y.reach, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2) AS d FROM w x JOIN w y ON y.b >= x.lo AND y.b <= x.hi
  WHERE x.i != y.i AND sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2) <= x.reach * (1 + 1e-9)),
l AS MATERIALIZED (SELECT i, 1 / greatest(avg(greatest(reach, d)), 1e-12) AS density FROM p GROUP BY 1), m AS (SELECT p.i, avg(l.density) AS m FROM p JOIN l ON l.i = p.j GROUP BY 1)
SELECT k, round(m / density, 4) AS score FROM z JOIN l USING (i) JOIN m USING (i)""")
def lof_scores(spark, d):
    return rounded(anomaly.neighbours(li_key(spark, d), Z, ["k"], "lof", 10, exact=True), 4)


F4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def training(spark, d):
    rows = VectorAssembler(inputCols=F4, outputCol="features").transform(li_key(spark, d))
    return rows.select("k", *F4, "features", (F.col("l_returnflag") == "R").cast("double").alias("label"))


def held_out(df, key="k"):
    """(training rows, the fifth of the rows that is held out by the hash of its key)."""
    fold = hash_fold(F.col(key), 5, "held")
    return df.where(fold != 0), df.where(fold == 0)


@R.add()
def train_logistic(spark, d):
    train, test = held_out(training(spark, d))
    return metrics.auc_ap(models.with_probability(models.train_classifier(train, "logistic"), test), "label", "p")


@R.add()
def train_forest(spark, d):
    train, test = held_out(training(spark, d))
    return metrics.auc_ap(models.with_probability(models.train_classifier(train, "forest", numTrees=10, maxDepth=5), test), "label", "p")


@R.add()
def train_regression(spark, d):
    rows = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(li_key(spark, d).withColumn("label", F.col("l_extendedprice")))
    train, test = held_out(rows)
    return models.evaluate_regression(models.train_regressor(train, "ols"), test)


@R.add()
def calibrate(spark, d):
    oof = models.out_of_fold(training(spark, d).select("k", "features", "label"), "k", 3, lambda t: models.train_classifier(t, "logistic"))
    fit, test = held_out(oof)
    return metrics.calibration(models.calibrate(fit)(test), "label", "calibrated")


W = {"l_quantity": 0.02, "l_discount": -3.0, "l_tax": 1.5}
M = {"l_quantity": 25.0, "l_discount": 0.05, "l_tax": 0.04}


@R.add("""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT) AS k, round(0.02 * (l_quantity - 25), 6) + 0.0 AS phi_quantity, round(-3 * (l_discount - 0.05), 6) + 0.0 AS phi_discount, round(1.5 * (l_tax - 0.04), 6) + 0.0 AS phi_tax,
round(0.1 + 0.02 * l_quantity - 3 * l_discount + 1.5 * l_tax, 6) + 0.0 AS total FROM lineitem""")
def linear_attribution(spark, d):
    out = explain.linear_attribution(li_key(spark, d), "k", W, M, 0.1)
    return rounded(out.select("k", *(F.element_at("phi", i + 1)["value"].alias(f"phi_{c[2:]}") for i, c in enumerate(W)), "total"))


@R.add("""WITH s AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT) AS k, 0.1 + 0.02 * l_quantity - 3 * l_discount + 1.5 * l_tax AS a, 0.1 + 0.02 * l_quantity - 3 * l_discount + 1.5 * 0.04 AS b FROM lineitem)
SELECT k, (a >= 0.4)::INT AS class, round(a, 6) + 0.0 AS probability, 0.4::DOUBLE AS threshold, round(a - 0.4, 6) + 0.0 AS margin FROM s""")
def decision_records(spark, d):
    s = li_key(spark, d).withColumn("s", 0.1 + 0.02 * F.col("l_quantity") - 3 * F.col("l_discount") + 1.5 * F.col("l_tax"))
    return rounded(explain.decisions(s, "k", "s", 0.4))


@R.add()
def tree_shap(spark, d):
    rows = training(spark, d)
    model = models.train_classifier(rows, "boosting", maxIter=3, maxDepth=3)
    out = explain.tree_attribution(model, rows, "k", F4)
    return out.select(F.posexplode("phi").alias("i", "phi")).groupBy("i").agg(F.avg(F.abs("phi")).alias("mean_abs"))


@R.add()
def counterfactual(spark, d):
    score = explain.linear_score(W, -0.45)
    return explain.counterfactuals(li_key(spark, d), "k", list(W), M, score, 0.5)


# weights by which no two moves help alike and no row stands at the threshold, where the last digit would decide
V = {"l_quantity": 0.0213171, "l_discount": -3.0717713, "l_tax": 1.4931337}


@R.add("""WITH x AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT) AS k, -0.4567891::DOUBLE + 0.0213171 * l_quantity - 3.0717713 * l_discount + 1.4931337 * l_tax AS z, l_quantity, l_discount, l_tax FROM lineitem),
m AS (SELECT k, z, 'l_quantity' AS c, 0.0213171 * (25.03 - l_quantity) AS move FROM x UNION ALL SELECT k, z, 'l_discount', -3.0717713 * (0.0503 - l_discount) FROM x UNION ALL SELECT k, z, 'l_tax', 1.4931337 * (0.0407 - l_tax) FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(1 / (1 + exp(-z - move)) - 1 / (1 + exp(-z))) DESC, c) AS r FROM m WHERE (move < 0) = (z >= 0)),
f AS (SELECT *, (z + sum(move) OVER (PARTITION BY k ORDER BY r) >= 0) != (z >= 0) AS turned FROM o), n AS (SELECT k, min(r) FILTER (turned) AS n FROM f GROUP BY k)
SELECT x.k, coalesce(list(c ORDER BY r) FILTER (r <= coalesce(n, 3)), []) AS changed, max(n) IS NOT NULL AS flipped FROM x LEFT JOIN f ON x.k = f.k LEFT JOIN n ON x.k = n.k GROUP BY x.k""")
def counterfactual_linear(spark, d):
    middle = {"l_quantity": 25.03, "l_discount": 0.0503, "l_tax": 0.0407}
    return explain.counterfactuals(li_key(spark, d), "k", list(V), middle, explain.linear_score(V, -0.4567891), 0.5)


@R.add()
def counterfactual_model(spark, d):
    rows = li_key(spark, d).withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
    vector = VectorAssembler(inputCols=F4, outputCol="features")
    model = models.train_classifier(vector.transform(rows), "boosting")
    middle = column_medians(rows, F4).first().asDict()
    return explain.model_counterfactuals(model, rows, "k", F4, middle, vector.transform, 0.5)


@R.add()
def train_quantile_forest(spark, d):
    rows = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(li_key(spark, d).withColumn("label", F.col("l_extendedprice")))
    train, test = held_out(rows)
    out = models.train_regressor(train, "forest", "quantile", 0.8).transform(test)
    return out.select("k", "label", "prediction")


@R.add()
def recipe_features(spark, d):
    specs = recipe("gaps") + recipe("rhythm") + recipe("pairing", other="event_type")
    return aggregate_events(events(spark, d), "user_id", "ts", specs, order=["event_id"])


def gates(spark, d):
    """Gate rows of one run per user: tools are event types.

    Means are rounded to 9 digits, so that one that stands at a bound does so in whatever order its values are added.
    """
    e = events(spark, d).groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("gate")).agg(F.round(F.avg("value"), 9).alias("v"))
    return e.select("run_id", "gate", F.when(F.col("v") > 52, "fail").when(F.col("v") < 47, "not_run").otherwise("pass").alias("status"))


@R.add("""WITH g AS (SELECT user_id AS run_id, event_type AS gate, CASE WHEN avg(value) > 52 THEN 'fail' WHEN avg(value) < 47 THEN 'not_run' ELSE 'pass' END AS status FROM events GROUP BY ALL),
q AS (SELECT unnest(['purchase', 'click', 'audit']) AS gate), a AS (SELECT run_id, gate, coalesce(status, 'not_run') AS status FROM (SELECT run_id, gate FROM (SELECT DISTINCT run_id FROM g), q) FULL JOIN g USING (run_id, gate))
SELECT run_id, CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'blocked' WHEN count(*) FILTER (status = 'not_run') > 0 THEN 'incomplete' ELSE 'ready' END AS status, round(count(*) FILTER (status != 'not_run') / count(*), 6) AS completeness FROM a GROUP BY 1""")
def readiness_rollup(spark, d):
    required = spark.createDataFrame([("purchase",), ("click",), ("audit",)], "gate string")
    return rounded(ledger.readiness(gates(spark, d), required))


@R.add("""WITH l AS (SELECT user_id AS run_id, event_id AS seq, event_type AS tool FROM events), c AS (SELECT run_id, max(seq) FILTER (tool = 'purchase') AS ch FROM l GROUP BY 1)
SELECT l.run_id, tool, max(seq) AS seq, coalesce(max(ch) > max(seq), false) AS stale FROM l JOIN c ON l.run_id = c.run_id WHERE tool IN ('click', 'view') GROUP BY 1, 2""")
def stale_screens(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), F.lit(True).alias("ok"))
    return ledger.stale_screens(rows, ["click", "view"], ["purchase"])
