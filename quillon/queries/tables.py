"""Queries on tables: profiles, screens, fitted encodings, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import fitted, screens, splits
from quillon.queries.common import Registry, events, rounded
from quillon.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
MD5_FOLD = "(('0x' || substr(md5({key} || '{seed}'), 1, 8))::BIGINT % {k})"


@R.add("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, l_quantity > 25 AND l_returnflag = 'R' AS big_return FROM lineitem""")
def custom_feature(spark, d):
    out = fitted.custom_feature(table(spark, d, "lineitem"), "charge", "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6)")
    return fitted.custom_feature(out, "big_return", "l_quantity > 25 AND l_returnflag == 'R'").select("l_orderkey", "l_linenumber", "charge", "big_return")


@R.add("""WITH c AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS k, unnest([abs(corr(l_quantity, l_extendedprice)), abs(corr(l_discount, l_extendedprice)), abs(corr(l_tax, l_extendedprice))]) AS r FROM lineitem),
b AS (SELECT k, row_number() OVER (ORDER BY r DESC, k) AS i FROM c)
SELECT kind, x.k AS a, y.k AS b FROM b x JOIN b y ON x.i < y.i AND y.i <= 2 CROSS JOIN (SELECT unnest(['ratio', 'product']) AS kind)""")
def pairwise_candidates(spark, d):
    return fitted.propose_features(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], top_k=2)


@R.add("""SELECT l_orderkey, l_linenumber, round(l_quantity / (l_tax + 1e-6), 4) AS l_quantity_over_l_tax, round(l_quantity * l_tax, 4) AS l_quantity_times_l_tax FROM lineitem""")
def pairwise_features(spark, d):
    out = fitted.apply_features(table(spark, d, "lineitem"), [("ratio", "l_quantity", "l_tax"), ("product", "l_quantity", "l_tax")])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity_over_l_tax", "l_quantity_times_l_tax"), 4)


TRAIN = "l_orderkey % 5 != 0"
PEER = f"""WITH t AS (SELECT * FROM lineitem WHERE {TRAIN}),
p AS (SELECT l_returnflag, count(l_quantity) AS n, quantile_cont(l_quantity, 0.5) AS med, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std FROM t GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(l_quantity / (abs(med) + 1e-6), 6) AS quantity_vs_peers, round((l_extendedprice - mean) / (std + 1e-6), 6) AS price_z
FROM lineitem LEFT JOIN p USING (l_returnflag)"""


@R.add(PEER)
def peer_features(spark, d):
    li = table(spark, d, "lineitem")
    specs = [{"name": "quantity_vs_peers", "column": "l_quantity", "by": "l_returnflag", "kind": "ratio"}, {"name": "price_z", "column": "l_extendedprice", "by": "l_returnflag", "kind": "zscore"}]
    return rounded(fitted.peer_features(li, li.where(TRAIN), specs).select("l_orderkey", "l_linenumber", "quantity_vs_peers", "price_z"))


@R.add("""WITH t AS (SELECT p_brand, count(*) AS n FROM part WHERE p_partkey % 5 != 0 GROUP BY 1)
SELECT p_partkey, round(coalesce(n / (SELECT sum(n) FROM t), 0), 6) AS p_brand_freq FROM part LEFT JOIN t USING (p_brand)""")
def freq_encode(spark, d):
    part = table(spark, d, "part")
    return rounded(fitted.frequency_encode(part, part.where("p_partkey % 5 != 0"), "p_brand").select("p_partkey", "p_brand_freq"))


@R.add("""WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 7 != 0 THEN c_mktsegment END AS seg FROM customer),
t AS (SELECT * FROM c WHERE c_custkey % 5 != 0), m AS (SELECT seg, count(*) AS n FROM t WHERE seg IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT c_custkey, round(coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM t)), 4) AS bal, coalesce(seg, (SELECT seg FROM m)) AS seg FROM c""")
def impute_median_mode(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr("CASE WHEN c_acctbal > 0 THEN c_acctbal END").alias("bal"), F.expr("CASE WHEN c_custkey % 7 != 0 THEN c_mktsegment END").alias("seg"))
    values = fitted.fit_imputation(c.where("c_custkey % 5 != 0"), {"bal": "median", "seg": "mode"})
    return rounded(fitted.apply_imputation(c, values), 4)


@R.add("""SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, isodow(o_orderdate) - 1 AS o_orderdate_dow, week(o_orderdate) AS o_orderdate_week, quarter(o_orderdate) AS o_orderdate_quarter FROM orders""")
def datetime_parts(spark, d):
    out = fitted.datetime_features(table(spark, d, "orders"), "o_orderdate", ["year", "month", "dow", "week", "quarter"])
    return out.select("o_orderkey", *(F.col(f"o_orderdate_{p}").cast("long").alias(f"o_orderdate_{p}") for p in ("year", "month", "dow", "week", "quarter")))


def _profile_sql(t: str, numbers: list[str], texts: list[str]) -> str:
    n = [f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_distinct, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.5) AS median, max({c})::DOUBLE AS max FROM {t}" for c in numbers]
    x = [f"SELECT '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL FROM {t}" for c in texts]
    return " UNION ALL ".join(n + x)


@R.add(_profile_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"], ["l_returnflag", "l_linestatus"]))
def profile_table(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus")
    return rounded(screens.profile(li).drop("dtype"), 4)


@R.add("""SELECT unnest(['event_type', 'value', 'props']) AS column_name, unnest([avg((event_type IS NULL)::INT), avg((value IS NULL)::INT), avg((props IS NULL)::INT)]) AS missing_share FROM events""")
def missingness(spark, d):
    return screens.missingness(events(spark, d).select("event_type", "value", "props"))


@R.add("""SELECT o_orderstatus AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1""")
def class_balance(spark, d):
    return rounded(screens.class_balance(table(spark, d, "orders"), "o_orderstatus"))


NEGATIVE = f"""(regexp_replace(lower(trim(y)), '[- ]', '_', 'g') IN ({", ".join(f"'{w}'" for w in splits.NEGATIVE_WORDS)}) OR regexp_matches(regexp_replace(lower(trim(y)), '[- ]', '_', 'g'), '^(no_|non_|not_)'))"""


@R.add(f"""WITH t AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'paid' ELSE 'default' END AS y FROM orders UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN 'no_churn' ELSE 'churn' END || '' FROM orders WHERE false),
v AS (SELECT DISTINCT y, {NEGATIVE} AS negative FROM t) SELECT count(*) AS classes, CASE WHEN count(*) = 2 THEN CASE WHEN arg_max(negative, y) AND NOT arg_min(negative, y) THEN min(y) ELSE max(y) END END AS event FROM v""")
def event_label(spark, d):
    labels = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "paid").otherwise("default").alias("y"))
    return splits.event_label(labels, "y")


@R.add("""WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT count(*) AS classes, round(min(n) / max(n), 6) AS ratio, min(n) / max(n) < 0.2 AS imbalanced FROM c""")
def check_imbalance(spark, d):
    return rounded(screens.imbalance(table(spark, d, "labels"), "toxic"))


@R.add(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (abs({c} - (SELECT avg({c}) FROM {t})) / (SELECT stddev_pop({c}) FROM {t}) > 3) AS outliers FROM {t}" for c, t in (("o_totalprice", "(SELECT o_totalprice, length(o_orderpriority) AS len FROM orders)"), ("len", "(SELECT o_totalprice, length(o_orderpriority) AS len FROM orders)"))))
def outlier_counts(spark, d):
    return screens.outlier_counts(table(spark, d, "orders").select("o_totalprice", F.length("o_orderpriority").alias("len")))


@R.add(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) AS corr FROM lineitem" for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][i + 1 :]))
def corr_matrix(spark, d):
    return rounded(screens.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 5)


@R.add("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::INT AS bin FROM orders, e)
SELECT bin, round(lo + bin * ((hi - lo) / 20), 4) AS low, round(lo + (bin + 1) * ((hi - lo) / 20), 4) AS high, count(*) AS n FROM b, e GROUP BY bin, lo, hi""")
def histogram(spark, d):
    return rounded(screens.histogram(table(spark, d, "orders"), "o_totalprice", 20), 4)


@R.add("""WITH b AS (SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS max FROM orders GROUP BY 1)
SELECT o_orderstatus, n, round(min, 4) AS min, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(max, 4) AS max, round(q1 - 1.5 * (q3 - q1), 4) AS low_fence, round(q3 + 1.5 * (q3 - q1), 4) AS high_fence FROM b""")
def box_stats(spark, d):
    return rounded(screens.box_stats(table(spark, d, "orders"), "o_totalprice", "o_orderstatus"), 4)


@R.add("""WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS f FROM lineitem)
SELECT least(floor((l_quantity - a) * 10 / (b - a)), 9)::INT AS x_bin, least(floor((l_extendedprice - c) * 10 / (f - c)), 9)::INT AS y_bin, count(*) AS n FROM lineitem, e GROUP BY 1, 2""")
def scatter_grid(spark, d):
    return screens.scatter_grid(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 10)


@R.add("""SELECT 'c_custkey' AS column_name, count(DISTINCT c_custkey) AS n_distinct, count(DISTINCT c_custkey) / count(c_custkey) AS ratio, true AS integer_like, 'near_unique' AS signal FROM customer
UNION ALL SELECT 'c_name', count(DISTINCT c_name), count(DISTINCT c_name) / count(c_name), false, 'near_unique' FROM customer
UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey), round(count(DISTINCT c_nationkey) / count(c_nationkey), 6), true, NULL FROM customer
UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), round(count(DISTINCT c_mktsegment) / count(c_mktsegment), 6), false, NULL FROM customer""")
def identifier_screen(spark, d):
    return rounded(screens.identifiers(table(spark, d, "customer").drop("c_acctbal")))


@R.add("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT 'o_custkey' AS column_name, count(*) AS values, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS repeated_rows FROM c""")
def group_candidates(spark, d):
    return screens.group_candidates(table(spark, d, "orders"), ["o_custkey", "o_orderkey"])


FOLDS = MD5_FOLD.format(key="doc_id", seed="", k=5)
AUC = """WITH b AS (SELECT doc_id, n_chars::DOUBLE AS n_chars, lang, toxic AS y, {fold} AS fold FROM documents JOIN labels USING (doc_id)),
l AS (SELECT lang, fold, sum(y) AS p, count(*) AS n FROM b GROUP BY ALL),
r AS (SELECT lang, fold, coalesce((sum(p) OVER w - p) / nullif(sum(n) OVER w - n, 0), (SELECT avg(y) FROM b)) AS rate FROM l WINDOW w AS (PARTITION BY lang)),
x AS (SELECT 'n_chars' AS column_name, n_chars AS v, y FROM b UNION ALL SELECT 'lang', rate, y FROM b JOIN r USING (lang, fold)),
c AS (SELECT column_name, v, sum(y) AS p, sum(1 - y) AS n FROM x GROUP BY ALL),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY column_name ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
a AS (SELECT column_name, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auc FROM s GROUP BY 1)
SELECT column_name, round(greatest(auc, 1 - auc), 6) AS auc FROM a""".format(fold=FOLDS)


@R.add(AUC)
def single_column_auc(spark, d):
    both = table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    return rounded(screens.single_column_auc(both, "toxic", 1, "doc_id"))


@R.add(f"""WITH b AS (SELECT source, toxic AS y, {FOLDS} AS fold FROM documents JOIN labels USING (doc_id)), l AS (SELECT source, fold, sum(y) AS p, count(*) AS n FROM b GROUP BY ALL)
SELECT source AS value, fold::INT AS fold, round(coalesce((sum(p) OVER w - p) / nullif(sum(n) OVER w - n, 0), (SELECT avg(y) FROM b)), 6) AS rate FROM l WINDOW w AS (PARTITION BY source)""")
def oof_target_rate(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    out = screens.out_of_fold_rates(both, "source", F.col("toxic"), screens.hash_fold(F.col("doc_id"), 5))
    return rounded(out.select("value", "fold", "rate"))


RANKS = """WITH r AS (SELECT {a} AS a, {b} AS b, rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb FROM {t})"""


@R.add(RANKS.format(a="l_quantity", b="l_extendedprice", t="lineitem") + " SELECT 'l_quantity' AS column_name, round(corr(ra, rb), 5) AS spearman FROM r")
def spearman_screen(spark, d):
    return rounded(screens.spearman(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice"), 5)


@R.add("""WITH e AS (SELECT props, event_type FROM events UNION ALL SELECT props, event_type FROM events WHERE event_id % 3 = 0), g AS (SELECT count(*) AS n FROM e GROUP BY props, event_type)
SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates FROM g""")
def dedupe_rows(spark, d):
    e = events(spark, d).select("event_id", "props", "event_type")
    return splits.duplicate_count(e.unionByName(e.where("event_id % 3 = 0")).drop("event_id"))


@R.add("""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 < floor(count(*) OVER () * (1 - 0.2)) THEN 'train' ELSE 'test' END AS fold FROM orders""")
def temporal_split(spark, d):
    return splits.temporal_split(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", ["o_orderkey"]).select("o_orderkey", "fold")


@R.add(f"""SELECT o_orderkey, CASE WHEN {MD5_FOLD.format(key="o_custkey", seed="42", k=1000)} < 200 THEN 'test' ELSE 'train' END AS fold FROM orders""")
def grouped_split(spark, d):
    return splits.grouped_split(table(spark, d, "orders"), "o_custkey").select("o_orderkey", "fold")


@R.add(f"""WITH b AS (SELECT o_orderkey, o_orderstatus, {MD5_FOLD.format(key="o_orderkey", seed="42", k=1000)} AS b FROM orders),
c AS (SELECT *, count(*) OVER (PARTITION BY o_orderstatus ORDER BY b RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM b)
SELECT o_orderkey, CASE WHEN upto <= 0.2 * n THEN 'test' ELSE 'train' END AS fold FROM c""")
def stratified_split(spark, d):
    return splits.stratified_split(table(spark, d, "orders"), "o_orderstatus", "o_orderkey").select("o_orderkey", "fold")


@R.add("""WITH f AS (SELECT o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 < floor(count(*) OVER () * (1 - 0.2)) AS train FROM orders),
t AS (SELECT o_custkey, count(*) FILTER (NOT train) AS t, count(*) FILTER (train) AS r FROM f GROUP BY 1)
SELECT sum(t)::BIGINT AS test_rows, sum(CASE WHEN r > 0 THEN t ELSE 0 END)::BIGINT AS overlapping_rows, round(100 * sum(CASE WHEN r > 0 THEN t ELSE 0 END) / sum(t), 6) AS overlap_pct FROM t""")
def entity_overlap(spark, d):
    return rounded(splits.entity_overlap(splits.temporal_split(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", ["o_orderkey"]), "o_custkey"))


@R.add("""SELECT event_id, floor((row_number() OVER (ORDER BY ts, event_id) - 1) * 6 / count(*) OVER ())::INT AS block FROM events""")
def expanding_folds(spark, d):
    return splits.expanding_folds(events(spark, d).select("event_id", "ts"), "ts", ["event_id"]).select("event_id", "block")


@R.add("""SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.5), 4) AS median, max(o_totalprice) AS max, round(skewness(o_totalprice), 4) AS skew FROM orders""")
def target_summary(spark, d):
    return rounded(splits.target_summary(table(spark, d, "orders"), "o_totalprice"), 4)
