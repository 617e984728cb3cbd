"""Profiles and screens of a table: shape, identifiers, outliers, leakage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.basics import numeric_columns, parse_time, stacked, text_columns
from quillon.operators.ranking import average_ranks, column_quantiles, quantiles, running
from quillon.session import materialise

# Parts of column names that always mean an identifier, and parts that only hint at one.
UNAMBIGUOUS_ID_NAMES = ["msisdn", "imsi", "imei", "iccid", "uuid", "guid", "ssn"]
ID_NAME_PATTERNS = [
    "_id", "id_", "uuid", "guid", "msisdn", "imei", "imsi", "phone", "caller", "callee", "account_no", "acct_no", "customer_no", "ssn", "email", "hash",
    "ticket", "invoice", "order_no", "claim", "reference", "serial", "policy_no",
]
# Words of column names that tell what came after the event.
AFTER_WORDS = [
    "after", "post", "outcome", "result", "resolution", "resolved", "closed", "refund", "refunded", "chargeback", "canceled", "cancelled",
    "final", "settled", "disposition", "recovered", "written_off",
]
# Words of column names that tell a time.
TIME_WORDS = ["date", "time", "day", "month", "week", "year", "ts", "timestamp", "period", "hour"]


def tokens(name: str) -> list[str]:
    return re.findall(r"[a-z]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower())


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_distinct) of all columns over one grouping of (column, value), which is pre-aggregated.

    Several distinct counts in one aggregation would repeat every row with all its columns instead.
    """
    pairs = stacked(df, columns, [], kind="string").where("value IS NOT NULL").distinct()
    return pairs.groupBy("column_name").agg(F.count("*").alias("n_distinct"))


def with_distinct(stats: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per column with their n_distinct; both sides have one row for each column."""
    return stats.join(F.broadcast(distinct_counts(df, columns)), "column_name", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


def profile(df: DataFrame) -> DataFrame:
    """(column_name, dtype, n, missing, n_distinct, mean, std, min, median, max) of every column."""
    numbers = set(numeric_columns(df))
    null = F.lit(None).cast("double")
    made = []
    for c in df.columns:
        x = F.col(c).cast("double")
        parts = [F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("missing")]
        kinds = (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
        parts += [(F.when(F.count(x) > 1, f(x)) if k == "std" else f(x)).alias(k) if c in numbers else null.alias(k) for k, f in kinds]
        made.append(F.struct(F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), *parts))
    stats = df.agg(F.array(*made).alias("_a")).select(F.explode("_a").alias("_p")).select("_p.*")
    if numbers:
        medians = column_quantiles(df, [c for c in df.columns if c in numbers], [0.5])
        stats = stats.join(F.broadcast(medians.select("column_name", F.col("q")[0].alias("median"))), "column_name", "left")  # one row for each column
    else:
        stats = stats.withColumn("median", null)
    return with_distinct(stats, df, df.columns).select("column_name", "dtype", "n", "missing", "n_distinct", "mean", "std", "min", "median", "max")


def missingness(df: DataFrame) -> DataFrame:
    """(column_name, missing_share), largest first."""
    row = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns))
    return stacked(row, df.columns, [], value="missing_share").orderBy(F.desc("missing_share"), "column_name")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """(class, n, share) of a target."""
    counts = df.groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row (classes, ratio, imbalanced): the smallest class over the largest, imbalanced below 0.2."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).count()
    return counts.agg(F.count("*").alias("classes"), (F.min("count") / F.max("count")).alias("ratio")).withColumn("imbalanced", F.col("ratio") < 0.2)


def outlier_counts(df: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None, z: float = 3.0) -> DataFrame:
    """(keys, column_name, outliers): values over z standard deviations from the mean; of the population, or per key of the sample."""
    columns, keys = columns or numeric_columns(df), keys or []
    long = stacked(df, columns, keys)
    stats = long.groupBy(*keys, "column_name").agg(F.avg("value").alias("_m"), (F.stddev_samp if keys else F.stddev_pop)("value").alias("_s"))
    joined = long.join(stats if keys else F.broadcast(stats), [*keys, "column_name"])
    far = F.coalesce(F.abs(F.try_divide(F.col("value") - F.col("_m"), F.col("_s"))) > z, F.lit(False))
    return joined.groupBy(*keys, "column_name").agg(F.count_if(far).alias("outliers"))


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, corr) of every pair of numeric columns, over the rows where both are known."""
    columns = columns or numeric_columns(df)
    both = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    made = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr")) for a, b in both]
    return df.agg(F.array(*made).alias("_a")).select(F.explode("_a").alias("_p")).select("_p.*")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal widths between the least and greatest value; the last bin holds the greatest."""
    x = F.col(column).cast("double")
    ends = F.broadcast(df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.coalesce(F.floor(F.try_divide(x - F.col("_lo"), width)), F.lit(0)), F.lit(bins - 1))
    out = df.where(x.isNotNull()).crossJoin(ends).groupBy(at.cast("int").alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n"))
    return out.select("bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def box_stats(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """(by, n, min, q1, median, q3, max, low_fence, high_fence)."""
    keys = [by] if by else []
    out = df.groupBy(*keys).agg(F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"))
    found = quantiles(df.select(*keys, F.col(column).alias("value")), [0.25, 0.5, 0.75], keys).select(*(F.col(k).alias(f"_by_{k}") for k in keys), F.col("q").alias("_q"))
    out = out.join(found, out[by].eqNullSafe(found[f"_by_{by}"]), "left") if by else out.crossJoin(F.broadcast(found))
    low, mid, high = (F.col("_q")[i] for i in range(3))
    return out.select(*keys, "n", "min", low.alias("q1"), mid.alias("median"), high.alias("q3"), "max", (low - 1.5 * (high - low)).alias("low_fence"), (high + 1.5 * (high - low)).alias("high_fence"))


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(x_bin, y_bin, n): the density behind a scatter plot, over all rows."""
    ends = F.broadcast(df.agg(*(f(F.col(c).cast("double")).alias(f"_{k}_{c}") for c in (x, y) for k, f in (("lo", F.min), ("hi", F.max)))))
    at = lambda c: F.least(F.coalesce(F.floor(F.try_divide((F.col(c) - F.col(f"_lo_{c}")) * bins, F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(ends).groupBy(at(x).alias("x_bin"), at(y).alias("y_bin")).agg(F.count("*").alias("n"))


def identifiers(df: DataFrame, target: str | None = None) -> DataFrame:
    """(column_name, n_distinct, ratio, integer_like, signal): why a column looks like an identifier, null if it doesn't.

    near_unique: text or whole numbers of which at least 98 % differ; high_cardinality: text with over 1,000 values;
    identifier_ratio: text of which half differ, 20 values at least; name: an unambiguous name; weak_name: a name that hints
    at one, which alone is no reason to drop or to fail.  Constant columns have no signal.
    """
    columns = [c for c in df.columns if c != target]
    numbers, texts = set(numeric_columns(df)), set(text_columns(df))
    made = []
    for c in columns:
        whole = F.coalesce(F.avg((F.col(c).cast("double") % 1 == 0).cast("double")) == 1, F.lit(False)) if c in numbers else F.lit(False)
        made.append(F.struct(F.lit(c).alias("column_name"), F.count("*").alias("_n"), whole.alias("integer_like"), F.lit(c in texts).alias("is_text")))
    stats = df.agg(F.array(*made).alias("_a")).select(F.explode("_a").alias("_p")).select("_p.*")
    ratio = F.try_divide(F.col("n_distinct").cast("double"), F.col("_n").cast("double"))
    out = with_distinct(stats, df, columns).select("column_name", "n_distinct", ratio.alias("ratio"), "integer_like", "is_text")
    strong = [c for c in columns if any(p in c.lower() for p in UNAMBIGUOUS_ID_NAMES)]
    weak = [c for c in columns if c.lower() == "id" or any(p in c.lower() for p in ID_NAME_PATTERNS)]
    name, text = F.col("column_name"), F.col("is_text")
    signal = (
        F.when(F.col("n_distinct") <= 1, F.lit(None))
        .when((F.col("ratio") >= 0.98) & (text | F.col("integer_like")), "near_unique")
        .when(text & (F.col("n_distinct") > 1000), "high_cardinality")
        .when(text & (F.col("ratio") >= 0.5) & (F.col("n_distinct") >= 20), "identifier_ratio")
        .when(name.isin(strong), "name")
        .when(name.isin(weak), "weak_name")
    )
    return out.withColumn("signal", signal).drop("is_text")


def propose_drops(df: DataFrame, target: str | None = None) -> DataFrame:
    """(column_name, reason): constant columns and identifiers; text with 50 or more values is `encodable` instead."""
    found = identifiers(df, target)
    texts = [c for c in text_columns(df) if c != target]
    reason = (
        F.when(F.col("n_distinct") <= 1, "constant")
        .when(F.col("signal").isin("near_unique", "identifier_ratio", "name"), F.concat(F.lit("identifier:"), "signal"))
        .when(F.col("column_name").isin(texts) & (F.col("n_distinct") >= 50), "encodable")
    )
    return found.withColumn("reason", reason).where("reason IS NOT NULL").select("column_name", "reason")


def group_candidates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, values, repeated_rows): identifier-shaped columns whose values repeat, and the rows that share one."""
    long = stacked(df, columns, [], kind="string")
    counts = long.where("value IS NOT NULL").groupBy("column_name", "value").count()
    return counts.groupBy("column_name").agg(F.count("*").alias("values"), F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).alias("repeated_rows")).where("repeated_rows > 0")


def time_candidates(df: DataFrame, least: float = 0.95) -> DataFrame:
    """(column_name, n_distinct, parsed_share, first, last) of columns that can order the rows in time."""
    made = []
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f.name)
        if kind.startswith("timestamp") or kind == "date":
            t = c.cast("timestamp")
        elif kind == "string":
            t = parse_time(c)
        elif kind in ("integer", "long") and set(tokens(f.name)) & set(TIME_WORDS):
            t = F.timestamp_seconds(c)
        else:
            continue
        share = F.coalesce(F.try_divide(F.count(t).cast("double"), F.count(c).cast("double")), F.lit(0.0))
        made.append(F.struct(F.lit(f.name).alias("column_name"), F.count_distinct(c).alias("n_distinct"), share.alias("parsed_share"), F.min(t).alias("first"), F.max(t).alias("last")))
    return df.agg(F.array(*made).alias("_a")).select(F.explode("_a").alias("_p")).select("_p.*").where(F.col("parsed_share") >= least)


def hash_fold(key: Column, folds: int, seed: str = "") -> Column:
    """A fold from the key's MD5, the same in every engine."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int")


def rank_auc(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auc) of rows (keys, value, pos 0/1): the rank statistic with ties counted half.

    Rows are first reduced to counts per distinct value, and only those are put in order, range by range.
    """
    counts = long.groupBy(*keys, "value").agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("n"))
    return running(counts, "value", ["n"], keys).withColumnRenamed("n_before", "b").groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2.0)), F.sum("p").cast("double") * F.sum("n")).alias("auc")
    )


def out_of_fold_rates(df: DataFrame, column: str, pos: Column, fold: Column) -> DataFrame:
    """Rows (fold, value, rate): the share of positives of the value in the other folds, the overall share where it is unseen."""
    base = df.select(F.coalesce(F.col(column).cast("string"), F.lit("__missing__")).alias("value"), pos.cast("int").alias("pos"), fold.alias("fold"))
    per = base.groupBy("value", "fold").agg(F.sum("pos").alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy("value")
    mean = F.broadcast(base.groupBy().agg(F.avg("pos").alias("mean")))
    other_p, other_n = F.sum("p").over(w) - F.col("p"), F.sum("n").over(w) - F.col("n")
    return per.crossJoin(mean).select("value", "fold", F.coalesce(F.try_divide(other_p.cast("double"), other_n.cast("double")), F.col("mean")).alias("rate"), "p", "n")


def single_column_auc(df: DataFrame, target: str, positive, key: str, columns: list[str] | None = None, folds: int = 5) -> DataFrame:
    """(column_name, auc): how well each column alone tells the positive class, in either direction.

    Numbers go by value (missing as the median), text by the rate of its value in the other folds.
    """
    pos = (F.col(target) == positive).cast("int")
    columns = [c for c in columns or df.columns if c not in (target, key)]
    numbers = [c for c in columns if c in set(numeric_columns(df))]
    base = df.where(F.col(target).isNotNull()).withColumn("_pos", pos)
    parts = []
    if numbers:
        medians = F.broadcast(column_quantiles(base, numbers, [0.5]).select("column_name", F.col("q")[0].alias("med")))
        long = stacked(base, numbers, ["_pos"]).join(medians, "column_name").select("column_name", F.coalesce("value", "med").alias("value"), F.col("_pos").alias("pos"))
        parts.append(long)
    for c in (c for c in columns if c not in numbers):
        rates = out_of_fold_rates(base, c, F.col("_pos"), hash_fold(F.col(key), folds))
        per = rates.select(F.lit(c).alias("column_name"), F.col("rate").alias("value"), "p", "n")
        parts.append(per.select("column_name", "value", F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.col("p").alias("k")), F.struct(F.lit(0).alias("pos"), (F.col("n") - F.col("p")).alias("k")))).alias("x")).select("column_name", "value", "x.pos", "x.k"))
    counted = [p if "k" in p.columns else p.withColumn("k", F.lit(1)) for p in parts]
    everything = counted[0]
    for p in counted[1:]:
        everything = everything.unionByName(p)
    counts = everything.groupBy("column_name", "value").agg(F.sum(F.col("pos") * F.col("k")).alias("p"), F.sum((1 - F.col("pos")) * F.col("k")).alias("n"))
    auc = F.try_divide(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2.0)), F.sum("p").cast("double") * F.sum("n"))
    return running(counts.where("value IS NOT NULL"), "value", ["n"], ["column_name"]).withColumnRenamed("n_before", "b").groupBy("column_name").agg(F.greatest(auc, 1 - auc).alias("auc"))


def spearman(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column_name, spearman): rank correlations with the target, ties at their average rank, ranks from distinct values."""
    out = None
    for c in columns:
        both = df.where(F.col(c).isNotNull() & F.col(target).isNotNull()).select(F.col(c).cast("double").alias("a"), F.col(target).cast("double").alias("b"))
        for x in ("a", "b"):
            both = average_ranks(both, x, f"r{x}")
        one = both.agg(F.corr("ra", "rb").alias("spearman")).select(F.lit(c).alias("column_name"), "spearman")
        out = one if out is None else out.unionByName(one)
    return out


def leakage(df: DataFrame, target: str, positive, key: str) -> DataFrame:
    """(column_name, reason) of columns that tell the target too well, sound like they come after it, or identify rows."""
    numbers = [c for c in numeric_columns(df) if c not in (target, key)]
    pos = (F.col(target) == positive).cast("double")
    corr = stacked(df.agg(*(F.abs(F.corr(F.col(c).cast("double"), pos)).alias(c) for c in numbers)), numbers, []).where("value > 0.98").select("column_name", F.lit("correlation").alias("reason"))
    auc = single_column_auc(df, target, positive, key).where("auc >= 0.98").select("column_name", F.lit("single_column_auc").alias("reason"))
    named = [(c, "after_the_event") for c in df.columns if c != target and any(f"_{w}_" in f"_{'_'.join(tokens(c))}_" for w in AFTER_WORDS)]
    ids = identifiers(df, target).where("signal IN ('near_unique', 'identifier_ratio', 'name')").select("column_name", F.lit("identifier").alias("reason"))
    out = corr.unionByName(auc).unionByName(ids)
    return out.unionByName(df.sparkSession.createDataFrame(named, "column_name string, reason string")) if named else out


def forecast_leakage(df: DataFrame, series: list[str], time: str, y: str, drivers: list[str]) -> DataFrame:
    """(column_name, corr_now, corr_next, leak): drivers that copy y at the same or the next step."""
    w = Window.partitionBy(*series).orderBy(time)
    base = df.withColumn("_next", F.lead(y).over(w))
    made = [F.struct(F.lit(d).alias("column_name"), F.corr(d, y).alias("corr_now"), F.corr(d, "_next").alias("corr_next")) for d in drivers]
    out = base.agg(F.array(*made).alias("_a")).select(F.explode("_a").alias("_p")).select("_p.*")
    return out.withColumn("leak", F.coalesce((F.abs("corr_now") >= 0.98) | (F.abs("corr_next") >= 0.98), F.lit(False)))


def profile_features(df: DataFrame, target: str, positive, key: str) -> DataFrame:
    """(column_name, missing_share, n_distinct, median_pos, median_neg, auc, flag): constant, mostly_missing, leakage_suspect, weak_alone or ok."""
    columns = [c for c in df.columns if c not in (target, key)]
    numbers = set(numeric_columns(df))
    pos = F.col(target) == positive
    null = F.lit(None).cast("double")
    made = [
        F.struct(
            F.lit(c).alias("column_name"), F.avg(F.col(c).isNull().cast("double")).alias("missing_share"),
        )
        for c in columns
    ]
    out = df.agg(F.array(*made).alias("_a")).select(F.explode("_a").alias("_p")).select("_p.*")
    mids = column_quantiles(df.withColumn("_pos", pos), [c for c in columns if c in numbers], [0.5], ["_pos"]).groupBy("column_name") if numbers & set(columns) else None
    if mids is not None:
        sides = [F.max(F.when(F.col("_pos") == side, F.col("q")[0])).alias(name) for name, side in (("median_pos", True), ("median_neg", False))]
        out = out.join(F.broadcast(mids.agg(*sides)), "column_name", "left")  # one row for each column
    else:
        out = out.withColumns({"median_pos": null, "median_neg": null})
    out = with_distinct(out, df, columns).join(single_column_auc(df, target, positive, key), "column_name", "left")
    flag = (
        F.when(F.col("n_distinct") <= 1, "constant").when(F.col("missing_share") > 0.5, "mostly_missing")
        .when(F.col("auc") >= 0.98, "leakage_suspect").when(F.col("auc") < 0.55, "weak_alone").otherwise("ok")
    )
    return out.select("column_name", "missing_share", "n_distinct", "median_pos", "median_neg", "auc", flag.alias("flag"))


def label_rule(df: DataFrame, target: str, positive, column: str) -> DataFrame:
    """One row (cut, above, gini, average_precision): the best single cut of a number for the class, from its value counts."""
    base = df.where(F.col(column).isNotNull() & F.col(target).isNotNull()).select(F.col(column).cast("double").alias("v"), (F.col(target) == positive).cast("long").alias("y"))
    counts = base.groupBy("v").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    placed = running(counts.withColumn("one", F.lit(1)), "v", ["p", "n", "one"])
    placed = placed.select("v", (F.col("p_before") + F.col("p")).alias("cp"), (F.col("n_before") + F.col("n")).alias("cn"), F.col("p_all").alias("tp"), F.col("n_all").alias("tn"), F.col("one_before").alias("i"))
    placed = materialise(placed, "cuts")
    cuts = placed.join(placed.select((F.col("i") - 1).alias("i"), F.col("v").alias("up")), "i")
    lp, rp = F.col("cp") / F.col("cn"), (F.col("tp") - F.col("cp")) / (F.col("tn") - F.col("cn"))
    gini = 2 * (F.col("cn") * lp * (1 - lp) + (F.col("tn") - F.col("cn")) * rp * (1 - rp)) / F.col("tn")
    hi, lo = F.greatest(lp, rp), F.least(lp, rp)
    hi_p = F.when(rp >= lp, F.col("tp") - F.col("cp")).otherwise(F.col("cp"))
    ap = hi * hi_p / F.col("tp") + (F.col("tp") / F.col("tn")) * (1 - hi_p / F.col("tp"))
    best = cuts.select(((F.col("v") + F.col("up")) / 2).alias("cut"), (rp >= lp).alias("above"), gini.alias("gini"), ap.alias("average_precision"), lo.alias("_lo"))
    return best.orderBy("gini", "cut").limit(1).drop("_lo")


def label_rule_tree(df: DataFrame, target: str, positive, columns: list[str], model_ap: float | None = None, depth: int = 2) -> DataFrame:
    """(column_name, average_precision, ratio, suspicious), best first: how far a tree of `depth` levels on one number alone gets.

    The ratio is to the average precision of the model; from 0.9 on the label looks like a rule on that column.
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from quillon.operators.metrics import auc_ap

    out = None
    for c in columns:
        rows = df.where(F.col(c).isNotNull() & F.col(target).isNotNull()).select(F.col(c).cast("double").alias("x"), (F.col(target) == positive).cast("double").alias("label"))
        rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
        model = DecisionTreeClassifier(maxDepth=depth, maxBins=1024).fit(rows)
        scored = model.transform(rows).select("label", vector_to_array("probability")[1].alias("s"))
        one = auc_ap(scored, "label", "s").select(F.lit(c).alias("column_name"), "average_precision")
        out = one if out is None else out.unionByName(one)
    ratio = F.try_divide(F.col("average_precision"), F.lit(model_ap).cast("double"))
    return out.withColumn("ratio", ratio).withColumn("suspicious", F.coalesce(ratio >= 0.9, F.lit(False))).orderBy(F.desc("average_precision"), "column_name")


def regression_signal(df: DataFrame, target: str, key: str, numbers: list[str], texts: list[str], folds: int = 5) -> DataFrame:
    """(column_name, signal): the absolute Spearman correlation of each column with the target, text by its value's mean in the other folds."""
    base = df.where(F.col(target).isNotNull())
    parts = [spearman(base, numbers, target)] if numbers else []
    for c in texts:
        rows = base.select(F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias("v"), F.col(target).cast("double").alias("y"), hash_fold(F.col(key), folds).alias("fold"))
        per = rows.groupBy("v", "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
        w = Window.partitionBy("v")
        mean = F.broadcast(rows.agg(F.avg("y").alias("mean")))
        rest = per.crossJoin(mean).select("v", "fold", F.coalesce(F.try_divide(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n")), F.col("mean")).alias(c))
        parts.append(spearman(rows.join(rest, ["v", "fold"]), [c], "y"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("column_name", F.abs("spearman").alias("signal"))


def regression_leakage(df: DataFrame, target: str, key: str, numbers: list[str], texts: list[str], least: float = 0.999) -> DataFrame:
    """(column_name, signal) of columns whose order is that of the target."""
    return regression_signal(df, target, key, numbers, texts).where(F.col("signal") >= least)


def label_copies(df: DataFrame, label: str) -> DataFrame:
    """(column_name) of columns that tell a label exactly: each of their values goes with one label, and they have at most 20."""
    others = [c for c in df.columns if c != label]
    long = stacked(df.where(F.col(label).isNotNull()), others, [label], kind="string").where("value IS NOT NULL")
    per = long.groupBy("column_name", "value").agg(F.count_distinct(label).alias("k"))
    return per.groupBy("column_name").agg(F.max("k").alias("k"), F.count("*").alias("n")).where("k = 1 AND n BETWEEN 2 AND 20").select("column_name")
