"""Queries on events: features per entity, per period, at decisions and over windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import aggregates
from quillon.operators.events import aggregate_events, entity_features, features_at_decisions
from quillon.queries.common import Registry, events, rounded

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
SPECS = [
    {"name": "n_purchase", "agg": "count", "where": "event_type = 'purchase'"},
    {"name": "share_purchase", "agg": "share", "where": "event_type = 'purchase'"},
    {"name": "value_sum", "agg": "sum", "column": "value", "where": "event_type = 'purchase'"},
    {"name": "value_mean", "agg": "mean", "column": "value"},
    {"name": "value_median", "agg": "median", "column": "value"},
    {"name": "value_std", "agg": "std", "column": "value"},
    {"name": "value_min", "agg": "min", "column": "value"},
    {"name": "value_max", "agg": "max", "column": "value"},
    {"name": "types", "agg": "nunique", "column": "event_type"},
    {"name": "value_cv", "agg": "cv", "column": "value"},
    {"name": "below_50", "agg": "below", "column": "value", "value": 50},
    {"name": "night_share", "agg": "share", "where": "_hour < 6"},
    {"name": "weekend_share", "agg": "share", "where": "_dow >= 5"},
    {"name": "active_days", "agg": "nunique", "column": "_day"},
    {"name": "span_days", "agg": "span_days"},
    {"name": "recency_days", "agg": "recency_days", "where": "event_type = 'purchase'"},
]
P = "event_type = 'purchase'"
AGGS = f"""count(*) AS n_events, count(*) FILTER ({P}) AS n_purchase, round(count(*) FILTER ({P}) / count(*), 6) AS share_purchase,
  round(coalesce(sum(value) FILTER ({P}), 0), 6) AS value_sum, round(avg(value), 6) AS value_mean, round(quantile_cont(value, 0.5), 6) AS value_median,
  round(stddev_samp(value), 6) AS value_std, min(value) AS value_min, max(value) AS value_max, count(DISTINCT event_type) AS types,
  round(stddev_samp(value) / (abs(avg(value)) + 1e-9), 6) AS value_cv, round(avg((value < 50)::INT), 6) AS below_50,
  round(count(*) FILTER (hour(ts) < 6) / count(*), 6) AS night_share, round(count(*) FILTER (isodow(ts) >= 6) / count(*), 6) AS weekend_share,
  count(DISTINCT ts::DATE) AS active_days, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 86400e6, 6) AS span_days"""


@R.add(f"""SELECT user_id, {AGGS}, round(((SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) FILTER ({P})) / 86400e6, 6) AS recency_days FROM events GROUP BY user_id""")
def agg_events_entity(spark, d):
    return rounded(aggregate_events(events(spark, d), "user_id", "ts", SPECS))


@R.add(f"""SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS period_start, {AGGS},
  round((epoch_us(time_bucket(INTERVAL 1 DAY, ts)) + 86400000000 - max(epoch_us(ts)) FILTER ({P})) / 86400e6, 6) AS recency_days FROM events GROUP BY 1, 2""")
def agg_events_daily(spark, d):
    out = rounded(aggregate_events(events(spark, d), "user_id", "ts", SPECS, period="D"))
    return out.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@R.add("""WITH e AS (SELECT user_id, floor(epoch_us(ts) / (7 * 86400000000))::BIGINT AS k, * FROM events)
SELECT user_id, make_timestamp(k * 7 * 86400000000) AS period_start, count(*) AS n_events, round(sum(value), 6) AS total FROM e GROUP BY user_id, k""")
def agg_events_weekly(spark, d):
    out = rounded(aggregate_events(events(spark, d), "user_id", "ts", [{"name": "total", "agg": "sum", "column": "value"}], period="7D"))
    return out.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@R.add("""WITH g AS (
  SELECT user_id, event_type, value, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS g,
         CASE WHEN event_type = 'click' THEN (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts, event_id)) / 1e6 END AS c
  FROM events
) SELECT user_id, count(*) AS n_events, round(avg(g), 6) AS gap_mean, round(stddev_samp(g) / (abs(avg(g)) + 1e-9), 6) AS gap_cv, max(g) AS gap_max,
  min(c) AS click_gap_min, round(avg((g < 600)::INT), 6) AS gap_short FROM g GROUP BY user_id""")
def agg_events_gap(spark, d):
    specs = [
        {"name": "gap_mean", "agg": "mean", "column": "_gap"},
        {"name": "gap_cv", "agg": "cv", "column": "_gap"},
        {"name": "gap_max", "agg": "max", "column": "_gap"},
        {"name": "click_gap_min", "agg": "min", "column": "_gap", "where": "event_type = 'click'"},
        {"name": "gap_short", "agg": "below", "column": "_gap", "value": 600},
    ]
    return rounded(aggregate_events(events(spark, d), "user_id", "ts", specs, order=["event_id"]))


@R.add("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, sum(n)::BIGINT AS n_events, round(sum(-p * log2(p)), 6) AS type_entropy, round(max(p), 6) AS type_top_share FROM s GROUP BY 1""")
def agg_events_entropy(spark, d):
    specs = [{"name": "type_entropy", "agg": "entropy", "column": "event_type"}, {"name": "type_top_share", "agg": "top_share", "column": "event_type"}]
    return rounded(aggregate_events(events(spark, d), "user_id", "ts", specs))


@R.add("""WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS g FROM events),
m AS (SELECT user_id, quantile_cont(g, 0.5) AS med FROM g GROUP BY 1)
SELECT g.user_id, count(*) AS n_events, round(avg((abs(g - med) <= 0.05 * abs(med))::INT), 6) AS gap_periodicity FROM g JOIN m ON g.user_id = m.user_id GROUP BY 1""")
def agg_events_periodicity(spark, d):
    return rounded(aggregate_events(events(spark, d), "user_id", "ts", [{"name": "gap_periodicity", "agg": "periodicity", "column": "_gap"}], order=["event_id"]))


@R.add("""SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS errors,
round((epoch_us(TIMESTAMP '2024-01-15') - max(epoch_us(ts))) / 86400e6, 6) AS silence FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1""")
def agg_events_before(spark, d):
    specs = [{"name": "errors", "agg": "count", "where": "event_type = 'error'"}, {"name": "silence", "agg": "recency_days"}]
    return rounded(aggregate_events(events(spark, d), "user_id", "ts", specs, before="2024-01-15 00:00:00"))


@R.add("""WITH e AS (SELECT *, epoch_us(ts) AS t FROM events), f AS (
  SELECT event_id, user_id, event_type, count(*) OVER w AS n_24h, count(*) FILTER (event_type = 'click') OVER w AS clicks_24h,
    coalesce(sum(value) OVER v, 0) AS sum_7d, avg(value) OVER v AS mean_7d, stddev_samp(value) OVER v AS std_7d,
    (t - last_value(CASE WHEN event_type = 'error' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 86400e6 AS since_error
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING)
) SELECT event_id, user_id, n_24h, clicks_24h, round(coalesce(clicks_24h / nullif(n_24h, 0), 0), 6) AS click_share_24h, round(sum_7d, 4) AS sum_7d, round(mean_7d, 8) AS mean_7d, round(std_7d, 4) AS std_7d, round(since_error, 4) AS since_error
FROM f WHERE event_type = 'purchase'""")
def at_decision_features(spark, d):
    specs = [
        {"name": "n_24h", "agg": "count"},
        {"name": "clicks_24h", "agg": "count", "where": "event_type = 'click'"},
        {"name": "click_share_24h", "agg": "share", "where": "event_type = 'click'"},
        {"name": "sum_7d", "agg": "sum", "column": "value", "window": "7D"},
        {"name": "mean_7d", "agg": "mean", "column": "value", "window": "7D"},
        {"name": "std_7d", "agg": "std", "column": "value", "window": "7D"},
        {"name": "since_error", "agg": "recency_days", "where": "event_type = 'error'"},
    ]
    out = features_at_decisions(events(spark, d), "user_id", "ts", specs, "event_type = 'purchase'", "24h", ["event_id"])
    out = out.select("event_id", "user_id", *(s["name"] for s in specs))
    return out.withColumns({c: F.round(c, 4) for c in ("sum_7d", "std_7d", "since_error")} | {"mean_7d": F.round("mean_7d", 8), "click_share_24h": F.round("click_share_24h", 6)})


@R.add("""SELECT event_id, lag(value, 2) OVER w AS lag2, value - lag(value) OVER w AS diff1, round((value - lag(value) OVER w) / (abs(lag(value) OVER w) + 1e-6), 4) AS pct,
  round(avg(value) OVER f, 8) AS mean5, round(stddev_samp(value) OVER f, 4) AS std5, min(value) OVER f AS min5, max(value) OVER f AS max5, round(sum(value) OVER f, 4) AS sum5,
  round(value / (avg(value) OVER f + 1e-6), 4) AS vs5, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 86400e6, 6) AS gap
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def entity_windows_rows(spark, d):
    specs = [{"name": "lag2", "op": "lag", "column": "value", "n": 2}, {"name": "diff1", "op": "diff", "column": "value"}, {"name": "pct", "op": "pct_change", "column": "value"}]
    specs += [{"name": f"{k}5", "op": f"roll_{k}", "column": "value", "n": 5} for k in ("mean", "std", "min", "max", "sum")]
    specs += [{"name": "vs5", "op": "vs_roll_mean", "column": "value", "n": 5}, {"name": "gap", "op": "gap_prev"}]
    out = entity_features(events(spark, d), "user_id", "ts", specs, order=["event_id"])
    return out.select("event_id", "lag2", "diff1", F.round("pct", 4).alias("pct"), F.round("mean5", 8).alias("mean5"), F.round("std5", 4).alias("std5"), "min5", "max5", F.round("sum5", 4).alias("sum5"), F.round("vs5", 4).alias("vs5"), F.round("gap", 6).alias("gap"))


@R.add("""SELECT event_id, count(*) OVER w AS n_24h, round(coalesce(sum(value) OVER w, 0), 4) AS sum_24h, round(avg(value) OVER w, 8) AS mean_24h, max(value) OVER w AS max_24h
FROM (SELECT *, epoch_us(ts) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)""")
def entity_windows_time(spark, d):
    specs = [{"name": "n_24h", "op": "roll_count", "window": "24h"}] + [{"name": f"{k}_24h", "op": f"roll_{k}", "column": "value", "window": "24h"} for k in ("sum", "mean", "max")]
    out = entity_features(events(spark, d), "user_id", "ts", specs)
    return out.select("event_id", "n_24h", F.round("sum_24h", 4).alias("sum_24h"), F.round("mean_24h", 8).alias("mean_24h"), "max_24h")


@R.add("""WITH e AS (SELECT *, (value > 90)::INT AS high FROM events), i AS (
  SELECT *, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
) SELECT event_id, round((epoch_us(ts) - last_value(CASE WHEN high > 0 THEN epoch_us(ts) END IGNORE NULLS) OVER b) / 86400e6, 6) AS since_high,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS same_type_before,
  i - 1 - coalesce(max(CASE WHEN value <= 50 OR value IS NULL THEN i END) OVER b, 0) AS streak
FROM i WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def entity_since_streak(spark, d):
    base = events(spark, d).withColumns({"high": (F.col("value") > 90).cast("int"), "above": F.col("value") - 50})
    specs = [{"name": "since_high", "op": "since", "column": "high"}, {"name": "same_type_before", "op": "prior_count", "column": "event_type"}, {"name": "streak", "op": "streak", "column": "above"}]
    out = entity_features(base, "user_id", "ts", specs, order=["event_id"])
    return out.select("event_id", F.round("since_high", 6).alias("since_high"), F.col("same_type_before").cast("long").alias("same_type_before"), F.col("streak").cast("long").alias("streak"))


@R.add("""WITH e AS (SELECT *, epoch_us(ts) AS t FROM events), i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS i FROM e)
SELECT event_id, lag(value, 3) OVER r AS lag3, round(avg(value) OVER f, 8) AS mean20, (t - lag(t) OVER r) / 86400e6 AS gap,
  count(*) OVER h AS n_1h, round(coalesce(sum(value) OVER d, 0), 3) AS sum_5d, round(stddev_samp(value) OVER d, 4) AS std_5d, max(value) OVER d AS max_5d,
  (t - last_value(CASE WHEN value > 99 THEN t END IGNORE NULLS) OVER b) / 86400e6 AS since_high,
  row_number() OVER (PARTITION BY event_type, user_id ORDER BY t, event_id) - 1 AS same_user_before,
  i - 1 - coalesce(max(CASE WHEN value <= 0 OR value IS NULL THEN i END) OVER b, 0) AS streak
FROM i WINDOW r AS (PARTITION BY event_type ORDER BY t, event_id), f AS (PARTITION BY event_type ORDER BY t, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
  b AS (PARTITION BY event_type ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  h AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING), d AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN 432000000000 PRECEDING AND 1 PRECEDING)""")
def entity_windows_blocks(spark, d):
    specs = [{"name": "lag3", "op": "lag", "column": "value", "n": 3}, {"name": "mean20", "op": "roll_mean", "column": "value", "n": 20}, {"name": "gap", "op": "gap_prev"}]
    specs += [{"name": "n_1h", "op": "roll_count", "window": "1h"}] + [{"name": f"{k}_5d", "op": f"roll_{k}", "column": "value", "window": "5D"} for k in ("sum", "std", "max")]
    specs += [{"name": "since_high", "op": "since", "column": "high"}, {"name": "same_user_before", "op": "prior_count", "column": "user_id"}, {"name": "streak", "op": "streak", "column": "value"}]
    base = events(spark, d).withColumn("high", F.col("value") - 99)
    out = entity_features(base, "event_type", "ts", specs, order=["event_id"], split_rows=1000)  # few types hold all rows
    whole = out.select("event_id", "lag3", "gap", "n_1h", "max_5d", "since_high", F.col("same_user_before").cast("long").alias("same_user_before"), F.col("streak").cast("long").alias("streak"), "mean20", "sum_5d", "std_5d")
    return whole.withColumns({"mean20": F.round("mean20", 8), "sum_5d": F.round("sum_5d", 3), "std_5d": F.round("std_5d", 4)})


def _geometric() -> None:
    """Registers the geometric mean of values above 0, and the longest time from a first to a last row in days."""
    aggregates.register("geometric_mean", {"s": (lambda x, hit, t: F.sum(F.when(x > 0, F.log(x))), "sum"), "n": (lambda x, hit, t: F.count_if(x > 0), "sum")}, lambda p: F.exp(F.try_divide(p["s"], p["n"])))
    aggregates.register("active_span", {"a": (lambda x, hit, t: F.min(t), "min"), "b": (lambda x, hit, t: F.max(t), "max")}, lambda p: (p["b"] - p["a"]) / 86_400e6, column=False)


MEANS = [{"name": "gm", "agg": "geometric_mean", "column": "value"}, {"name": "gm_click", "agg": "geometric_mean", "column": "value", "where": "event_type = 'click'"}, {"name": "click_span", "agg": "active_span", "where": "event_type = 'click'"}]
GM = """round(exp(avg(ln(CASE WHEN value > 0 THEN value END))), 6) AS gm, round(exp(avg(ln(CASE WHEN value > 0 AND event_type = 'click' THEN value END))), 6) AS gm_click,
  round((max(epoch_us(ts)) FILTER (event_type = 'click') - min(epoch_us(ts)) FILTER (event_type = 'click')) / 86400e6, 6) AS click_span"""


@R.add(f"SELECT user_id, count(*) AS n_events, {GM}, round(avg(value), 6) AS m FROM events GROUP BY 1")
def agg_events_registered(spark, d):
    _geometric()
    return rounded(aggregate_events(events(spark, d), "user_id", "ts", [*MEANS, {"name": "m", "agg": "mean", "column": "value"}]))


@R.add(f"SELECT user_id, date_trunc('month', ts)::DATE AS month, count(*)::BIGINT AS n_events, {GM} FROM events GROUP BY 1, 2")
def merged_periods(spark, d):
    _geometric()
    daily = aggregates.partial_rows(events(spark, d), "user_id", "ts", MEANS, "D").withColumn("month", F.date_trunc("month", "period_start").cast("date"))
    return rounded(aggregates.merged(daily, ["user_id", "month"], MEANS))
