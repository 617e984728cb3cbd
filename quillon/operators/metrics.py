"""Evaluation tables: exact curves from counts per distinct score, thresholds, calibration, fairness, residuals."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.basics import stacked
from quillon.operators.bootstrap import bootstrap as bootstrap
from quillon.operators.ranking import column_quantiles, quantiles, running
from quillon.operators.splits import exact_rank


def div(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(F.lit(a).cast("double") if not isinstance(a, Column) else a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, label: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, label, pred, n)."""
    return df.groupBy(*(keys or []), label, pred).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, class, precision, recall, f1, support) per class; division by zero gives 0."""
    keys = keys or []
    counts = confusion(df, label, pred, keys)
    hit = F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)
    rows = counts.select(*keys, F.explode(F.array(F.struct(F.col(label).alias("class"), F.col("n").alias("actual"), F.lit(0).alias("said"), hit.alias("hit")), F.struct(F.col(pred).alias("class"), F.lit(0).alias("actual"), F.col("n").alias("said"), F.lit(0).alias("hit")))).alias("x")).select(*keys, "x.*")
    out = rows.groupBy(*keys, "class").agg(F.sum("actual").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    p, r = div(F.col("hit"), F.col("said")), div(F.col("hit"), F.col("support"))
    return out.select(*keys, "class", p.alias("precision"), r.alias("recall"), div(2 * p * r, p + r).alias("f1"), "support")


def report_averages(report: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, average, precision, recall, f1): macro and weighted by support."""
    w = F.col("support")
    made = []
    for name, weight in (("macro", F.lit(1.0)), ("weighted", w.cast("double"))):
        made.append(F.struct(F.lit(name).alias("average"), *(div(F.sum(F.col(m) * weight), F.sum(weight)).alias(m) for m in ("precision", "recall", "f1"))))
    return report.groupBy(*(keys or [])).agg(F.array(*made).alias("_a")).select(*(keys or []), F.explode("_a").alias("_p")).select(*(keys or []), "_p.*")


def score_counts(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, score, pos, neg) per distinct score, with cumulated tp, fp from the highest down and the totals.

    The raw rows are pre-aggregated, and distinct scores are put in order range by range.
    """
    keys = keys or []
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    up = running(counts, "score", ["pos", "neg"], keys).withColumnsRenamed({"pos_all": "all_pos", "neg_all": "all_neg"})
    return up.select(*keys, "score", "pos", "neg", (F.col("all_pos") - F.col("pos_before")).alias("tp"), (F.col("all_neg") - F.col("neg_before")).alias("fp"), "all_pos", "all_neg")


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, fpr, tpr)."""
    return score_counts(df, label, score).select("score", div(F.col("fp"), F.col("all_neg")).alias("fpr"), div(F.col("tp"), F.col("all_pos")).alias("tpr"))


def pr_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, precision, recall)."""
    return score_counts(df, label, score).select("score", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("all_pos")).alias("recall"))


def thinned(points: DataFrame, order: str, n: int = 200) -> DataFrame:
    """At most n points of a curve, evenly spaced in its order, with both ends."""
    ranked = exact_rank(points, [order], "_i")
    total = F.broadcast(ranked.agg(F.count("*").alias("_n")))
    return ranked.crossJoin(total).withColumn("_k", F.greatest(F.lit(1), F.ceil(F.col("_n") / n))).where("_i % _k = 0 OR _i = _n - 1").drop("_i", "_k", "_n")


def auc_ap(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, roc_auc, average_precision): ties count half in the first, the second is the step sum."""
    keys = keys or []
    c = score_counts(df, label, score, keys)
    auc = F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)), F.max("all_pos").cast("double") * F.max("all_neg"))
    ap = F.try_divide(F.sum(F.col("pos") * div(F.col("tp"), F.col("tp") + F.col("fp"))), F.max("all_pos").cast("double"))
    return c.groupBy(*keys).agg(auc.alias("roc_auc"), ap.alias("average_precision"))


def macro_auc(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """One row (roc_auc, average_precision): the mean over one-against-rest of the classes, whose scores' columns are given."""
    parts = [df.select(F.lit(k).alias("class"), (F.col(label).cast("string") == k).cast("int").alias("y"), F.col(c).alias("s")) for k, c in scores.items()]
    return auc_ap(reduce(DataFrame.unionByName, parts), "y", "s", ["class"]).agg(F.avg("roc_auc").alias("roc_auc"), F.avg("average_precision").alias("average_precision"))


def metrics_at(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """One row (precision, recall, f1, alert_rate) with alerts at scores of the threshold or more."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    row = df.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit).alias("said"), F.count_if(pos).alias("actual"), F.count("*").alias("n"))
    p, r = div(F.col("tp"), F.col("said")), div(F.col("tp"), F.col("actual"))
    return row.select(p.alias("precision"), r.alias("recall"), div(2 * p * r, p + r).alias("f1"), div(F.col("said"), F.col("n")).alias("alert_rate"))


def threshold_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall, f1, alert_rate, false_positives, false_negatives) at every distinct score."""
    c = score_counts(df, label, score)
    p, r = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("all_pos"))
    return c.select(
        F.col("score").alias("threshold"), p.alias("precision"), r.alias("recall"), div(2 * p * r, p + r).alias("f1"),
        div(F.col("tp") + F.col("fp"), F.col("all_pos") + F.col("all_neg")).alias("alert_rate"), F.col("fp").alias("false_positives"), (F.col("all_pos") - F.col("tp")).alias("false_negatives"),
    )


def tune_threshold(df: DataFrame, label: str, score: str, target_recall: float | None = None, max_alert_rate: float | None = None, cost_ratio: float | None = None) -> DataFrame:
    """The threshold's row: best F1; or best precision at a recall; or best recall at an alert rate; or least cost_ratio * FN + FP.

    Of equally good thresholds the lowest is taken.
    """
    t = threshold_table(df, label, score)
    if target_recall is not None:
        t, best = t.where(F.col("recall") >= target_recall), F.desc("precision")
    elif max_alert_rate is not None:
        t, best = t.where(F.col("alert_rate") <= max_alert_rate), F.desc("recall")
    elif cost_ratio is not None:
        best = F.asc(cost_ratio * F.col("false_negatives") + F.col("false_positives"))
    else:
        best = F.desc("f1")
    return t.orderBy(best, "threshold").limit(1)


def calibration_bins(df: DataFrame, label: str, score: str, n_bins: int = 10, *more: Column) -> DataFrame:
    """(bin, n, mean_score, positive_rate, more) of equal-width bins of [0, 1]."""
    at = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_rate"), *more)


def calibration(df: DataFrame, label: str, score: str, n_bins: int = 10) -> DataFrame:
    """One row (brier, ece, concern): a concern above an expected calibration error of 0.05."""
    off = F.pow(F.col(score) - F.col(label), 2)
    bins = calibration_bins(df, label, score, n_bins, F.sum(off).alias("_off"), F.count(off).alias("_k"))
    gap = F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("positive_rate"))) / F.sum("n")
    return bins.agg((F.sum("_off") / F.sum("_k")).alias("brier"), gap.alias("ece")).withColumn("concern", F.col("ece") > 0.05)


def confident_errors(df: DataFrame, label: str, score: str, key: str, threshold: float = 0.5, n: int = 10) -> DataFrame:
    """The n wrong predictions furthest from the threshold."""
    wrong = df.where((F.col(score) >= threshold).cast("int") != F.col(label))
    return wrong.withColumn("confidence", F.greatest(F.col(score), 1 - F.col(score))).orderBy(F.desc("confidence"), key).limit(n)


def segment_metrics(df: DataFrame, segment: str, label: str, pred: str) -> DataFrame:
    """(segment, n, precision, recall, f1, note): weighted averages; a note for segments of under two rows or one class."""
    weighted = report_averages(class_report(df, label, pred, [segment]), [segment]).where("average = 'weighted'").drop("average")
    sizes = df.groupBy(segment).agg(F.count("*").alias("n"), F.count_distinct(label).alias("_k"))
    note = F.when(F.col("n") < 2, "too few rows").when(F.col("_k") < 2, "one class")
    return sizes.join(weighted, segment).withColumn("note", note).select(segment, "n", "precision", "recall", "f1", "note")


def fairness_groups(df: DataFrame, attribute: str, label: str, pred: str, least: int = 20) -> DataFrame:
    """(attribute, n, selection_rate, tpr) of groups of at least `least` rows."""
    said, pos = F.col(pred) == 1, F.col(label) == 1
    out = df.where(F.col(attribute).isNotNull()).groupBy(attribute).agg(F.count("*").alias("n"), F.avg(said.cast("double")).alias("selection_rate"), F.avg(F.when(pos, said.cast("double"))).alias("tpr"))
    return out.where(F.col("n") >= least)


def fairness(df: DataFrame, attribute: str, label: str, pred: str, least: int = 20) -> DataFrame:
    """One row (groups, parity_difference, impact_ratio, opportunity_difference, concern)."""
    out = fairness_groups(df, attribute, label, pred, least).agg(
        F.count("*").alias("groups"), (F.max("selection_rate") - F.min("selection_rate")).alias("parity_difference"),
        F.try_divide(F.min("selection_rate"), F.max("selection_rate")).alias("impact_ratio"), (F.max("tpr") - F.min("tpr")).alias("opportunity_difference"),
    )
    bad = (F.col("parity_difference") > 0.1) | (F.col("impact_ratio") < 0.8) | (F.col("opportunity_difference") > 0.1)
    return out.withColumn("concern", F.coalesce(bad, F.lit(False)))


def regression_metrics(df: DataFrame, y: str, pred: str, quantile: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, r2, rmse, mae, median_ae, sum_ratio, mape, pinball, hit_rate); mape is withheld if values lie near zero."""
    e, a = F.col(y) - F.col(pred), F.col(y).cast("double")
    sse, sst = F.sum(e * e), F.var_pop(a) * F.count(a)
    near_zero = F.min(F.abs(a)) < 1e-3 * F.avg(F.abs(a))
    keys, known = keys or [], df.where(a.isNotNull() & F.col(pred).isNotNull())
    medians = quantiles(known.select(*keys, F.abs(e).alias("value")), [0.5], keys).select(*(F.col(k).alias(f"_m_{k}") for k in keys), F.col("q")[0].alias("median_ae"))
    out = known.groupBy(*keys).agg(
        F.count("*").alias("n"), (1 - F.try_divide(sse, sst)).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.try_divide(F.sum(pred), F.sum(a)).alias("sum_ratio"), F.when(~near_zero, 100 * F.avg(F.abs(F.try_divide(e, a)))).alias("mape"),
        F.avg(F.greatest(quantile * e, (quantile - 1) * e)).alias("pinball"), F.avg((a <= F.col(pred)).cast("double")).alias("hit_rate"),
    )
    on = [out[k].eqNullSafe(medians[f"_m_{k}"]) for k in keys]
    names = [*keys, "n", "r2", "rmse", "mae", "median_ae", "sum_ratio", "mape", "pinball", "hit_rate"]
    return (out.join(medians, on, "left") if keys else out.crossJoin(F.broadcast(medians))).select(*names)


def residual_checks(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row (bias_ratio, spread_rank_corr, biased, heteroscedastic)."""
    from quillon.operators.screens import spearman

    rows = df.select(F.abs(F.col(y) - F.col(pred)).alias("_e"), F.col(pred).cast("double").alias("_p"), F.col(y).cast("double").alias("_y"))
    bias = rows.agg(F.try_divide(F.abs(F.avg(F.col("_p") - F.col("_y"))), F.avg(F.abs("_y"))).alias("bias_ratio"))
    rank = spearman(rows, ["_e"], "_p").select(F.col("spearman").alias("spread_rank_corr"))
    return bias.crossJoin(rank).withColumns({"biased": F.col("bias_ratio") > 0.05, "heteroscedastic": F.abs("spread_rank_corr") > 0.3})


def error_segments(df: DataFrame, y: str, pred: str, numbers: list[str], texts: list[str], top: int = 8) -> DataFrame:
    """(column_name, segment, n, mae, bias) of the worst quartiles of numbers and values of text, of max(30, 2 %) rows or more."""
    e = F.col(pred) - F.col(y)
    base = df.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))
    if numbers:
        found = column_quantiles(df, numbers, [0.25, 0.5, 0.75])
        base = base.crossJoin(F.broadcast(found.agg(*(F.max(F.when(F.col("column_name") == c, F.col("q"))).alias(f"_q_{c}") for c in numbers))))
    quartile = lambda c: sum((F.col(c) > F.col(f"_q_{c}")[i]).cast("int") for i in range(3)) + 1
    made = [F.struct(F.lit(c).alias("column_name"), F.concat(F.lit("Q"), quartile(c).cast("string")).alias("segment")) for c in numbers]
    made += [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("segment")) for c in texts]
    rows = base.select(e.alias("e"), "_n", F.explode(F.array(*made)).alias("s")).select("e", "_n", "s.*").where("segment IS NOT NULL")
    out = rows.groupBy("column_name", "segment", "_n").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"))
    return out.where(F.col("n") >= F.greatest(F.lit(30.0), 0.02 * F.col("_n"))).drop("_n").orderBy(F.desc("mae"), "column_name", "segment").limit(top)


def conformal_width(df: DataFrame, y: str, pred: str, coverage: float = 0.9) -> DataFrame:
    """One row (n, width): the absolute error at rank ceil((n + 1) coverage), for an interval pred +- width."""
    e = F.abs(F.col(y) - F.col(pred))
    counts = df.where(e.isNotNull()).groupBy(e.alias("e")).agg(F.count("*").alias("c"))
    upto = running(counts, "e", ["c"]).select("e", (F.col("c_before") + F.col("c")).alias("upto"), F.col("c_all").alias("n"))
    need = F.least(F.ceil((F.col("n") + 1) * coverage), F.col("n"))
    return upto.where(F.col("upto") >= need).groupBy("n").agg(F.min("e").alias("width"))


def _poisson(mean: Column, u: Column) -> Column:
    """The Poisson quantile of u for whole means under 8, from the distribution functions."""
    tables = []
    for m in range(8):
        term = total = math.exp(-m)
        row = [total]
        for k in range(1, 28):
            term *= m / k
            total += term
            row.append(total)
        tables.append(F.array(*map(F.lit, row)))
    return F.size(F.filter(F.element_at(F.array(*tables), mean.cast("int") + 1), lambda c: c < u)).cast("double")


def paired_difference(a: DataFrame, b: DataFrame, key: str, label: str, score: str, resamples: int = 200, seed: int = 42) -> DataFrame:
    """One row (difference, low, high, distinguishable): AUC of b less that of a on the same rows, by a paired bootstrap over 64 blocks."""
    both = a.select(key, F.col(label).alias("y"), F.col(score).alias("sa")).join(b.select(key, F.col(score).alias("sb")), key)
    block = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(64)).cast("int")
    long = both.select(block.alias("g"), "y", F.explode(F.array(F.struct(F.lit("a").alias("m"), F.col("sa").alias("s")), F.struct(F.lit("b").alias("m"), F.col("sb").alias("s")))).alias("x")).select("g", "y", "x.*")
    counts = long.groupBy("m", "s", "g").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    weights = counts.select("g").distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples))))
    u = (F.pmod(F.xxhash64("g", "r", F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003
    weights = F.broadcast(weights.withColumn("w", F.when(F.col("r") == 0, F.lit(1.0)).otherwise(_poisson(F.lit(1.0), u))))  # 64 blocks x resamples
    rows = counts.join(weights, "g").groupBy("r", "m", "s").agg(F.sum(F.col("p") * F.col("w")).alias("p"), F.sum(F.col("n") * F.col("w")).alias("n"))
    auc = running(rows, "s", ["n"], ["r", "m"]).withColumnRenamed("n_before", "b").groupBy("r", "m").agg(F.try_divide(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))
    d = auc.groupBy("r").agg((F.max(F.when(F.col("m") == "b", F.col("auc"))) - F.max(F.when(F.col("m") == "a", F.col("auc")))).alias("d"))
    ends = [F.percentile(F.when(F.col("r") > 0, F.col("d")), F.lit(q)) for q in (0.025, 0.975)]
    out = d.agg(F.max(F.when(F.col("r") == 0, F.col("d"))).alias("difference"), ends[0].alias("low"), ends[1].alias("high"))
    return out.withColumn("distinguishable", (F.col("low") > 0) | (F.col("high") < 0))


def later_backtest(before: DataFrame, later: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """One row on later labelled rows: (n, positive_rate, alert_rate, precision, recall, average_precision, ap_change against the rows of then)."""
    hit, y = F.col(score) >= threshold, F.col(label).cast("long")
    rates = later.where(F.col(label).isNotNull() & F.col(score).isNotNull()).agg(
        F.count("*").alias("n"), F.avg(y).alias("positive_rate"), F.avg(hit.cast("double")).alias("alert_rate"),
        div(F.sum(F.when(hit, y)), F.count_if(hit)).alias("precision"), div(F.sum(F.when(hit, y)), F.sum(y)).alias("recall"),
    )
    now = auc_ap(later, label, score).select("average_precision")
    then = auc_ap(before, label, score).select(F.col("average_precision").alias("_then"))
    return rates.crossJoin(now).crossJoin(then).withColumn("ap_change", F.col("average_precision") - F.col("_then")).drop("_then")


def residual_histogram(df: DataFrame, y: str, pred: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of actual less predicted, over all rows."""
    from quillon.operators.screens import histogram

    return histogram(df.select((F.col(y) - F.col(pred)).alias("residual")), "residual", bins)


def diagnostics_sample(df: DataFrame, y: str, pred: str, key: list[str], rows: int = 5000, seed: int = 42) -> DataFrame:
    """(key, actual, predicted, residual) of at most about `rows` rows, chosen by the hash of their key, for a chart."""
    n = F.broadcast(df.agg(F.count("*").alias("_n")))
    chosen = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) < 1_000_000 * F.least(F.lit(1.0), F.lit(float(rows)) / F.col("_n"))
    return df.crossJoin(n).where(chosen).select(*key, F.col(y).alias("actual"), F.col(pred).alias("predicted"), (F.col(y) - F.col(pred)).alias("residual"))


def quantile_groups(df: DataFrame, column: str, tiebreak: list[str], k: int, name: str = "group") -> DataFrame:
    """Adds the 0-based quantile group of each non-null value's first-come rank: groups of equal size whatever the ties."""
    ranked = exact_rank(df.where(F.col(column).isNotNull()), [column, *tiebreak], "_rank")
    n = F.broadcast(ranked.agg(F.count("*").alias("_n")))
    place = F.ceil(F.col("_rank") * k / F.greatest(F.col("_n") - 1, F.lit(1))) - 1
    return ranked.crossJoin(n).withColumn(name, F.greatest(F.lit(0), place).cast("int")).drop("_rank", "_n")
