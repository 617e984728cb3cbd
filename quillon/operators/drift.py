"""Drift between a reference and a current table, per column, as a whole and over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.basics import chi2_isf, chi2_sf, ks_sf, numeric_columns, stacked, text_columns
from quillon.operators.ranking import column_quantiles, running
from quillon.operators.screens import identifiers

FLOOR = 1e-4
MODERATE, SEVERE = 0.1, 0.25


def psi_sum(ref: Column, cur: Column) -> Column:
    """The population stability index over the rows of bins with the two shares, each at least FLOOR."""
    a, b = F.greatest(ref, F.lit(FLOOR)), F.greatest(cur, F.lit(FLOOR))
    return F.sum((b - a) * F.log(b / a))


def noise_floor(bins: int, n_ref: float, n_cur: float) -> float:
    """The index that 99 % of comparisons of unchanged data stay under."""
    return chi2_isf(0.01, bins - 1) * (1 / n_ref + 1 / n_cur) if bins > 1 and n_ref and n_cur else 0.0


def severity(psi: Column, floor: Column) -> Column:
    return F.when(psi > F.greatest(F.lit(SEVERE), floor), "severe").when(psi > F.greatest(F.lit(MODERATE), floor), "moderate").otherwise("none")


def quantile_edges(ref: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(column_name, edges): the distinct inner quantiles of the reference; under two of them, no edges: a single bin."""
    found = column_quantiles(ref, columns, [i / bins for i in range(bins + 1)])
    names = ref.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    long = names.join(F.broadcast(found), "column_name", "left").select("column_name", F.coalesce(F.array_distinct("q"), F.array().cast("array<double>")).alias("_e"))  # one row for each column
    inner = F.when(F.size("_e") < 3, F.array().cast("array<double>")).otherwise(F.expr("slice(_e, 2, size(_e) - 2)"))
    return long.select("column_name", inner.alias("edges"))


def _binned(df: DataFrame, columns: list[str], edges: DataFrame, keys: list[str]) -> DataFrame:
    long = stacked(df, columns, keys).where("value IS NOT NULL AND NOT isnan(value)").join(F.broadcast(edges), "column_name")
    at = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    return long.groupBy(*keys, "column_name", at.alias("bin"), F.size("edges").alias("inner")).agg(F.count("*").alias("n"))


def _shares(counts: DataFrame, keys: list[str], part: str) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*keys, "column_name"))
    return counts.withColumn(f"share_{part}", F.col("n") / total).withColumn(f"n_{part}", total).drop("n")


def psi_numeric(ref: DataFrame, cur: DataFrame, columns: list[str] | None = None, bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    """(keys, column_name, psi, bins, n_ref, n_cur) over the reference's quantile bins, which are right-open and unbounded outside.

    Missing values are left out.  With keys, each group of the current table is compared, in the same job.
    """
    columns, keys = columns or [c for c in numeric_columns(ref) if c in cur.columns], keys or []
    edges = quantile_edges(ref, columns, bins)
    every = edges.select("column_name", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"), (F.size("edges") + 1).alias("bins"))
    r = _shares(_binned(ref, columns, edges, []), [], "ref").drop("inner")
    c = _shares(_binned(cur, columns, edges, keys), keys, "cur").drop("inner")
    grid = every if not keys else every.crossJoin(c.select(*keys).distinct())
    joined = grid.join(r, ["column_name", "bin"], "left").join(c, [*keys, "column_name", "bin"], "left").fillna(0, ["share_ref", "share_cur"])
    return joined.groupBy(*keys, "column_name", "bins").agg(psi_sum(F.col("share_ref"), F.col("share_cur")).alias("psi"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"))


def psi_categorical(ref: DataFrame, cur: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, column_name, psi, bins, n_ref, n_cur, chi2, new_share, new_categories): every value is a bin."""
    columns, keys = columns or [c for c in text_columns(ref) if c in cur.columns], keys or []
    count = lambda df, k: stacked(df, columns, k, kind="string").where("value IS NOT NULL").groupBy(*k, "column_name", "value").agg(F.count("*").alias("n"))
    r, c = _shares(count(ref, []), [], "ref"), _shares(count(cur, keys), keys, "cur")
    if keys:
        r = r.crossJoin(c.select(*keys).distinct())
    joined = r.join(c, [*keys, "column_name", "value"], "full")
    w = Window.partitionBy(*keys, "column_name")
    joined = joined.withColumns({"n_ref": F.max("n_ref").over(w), "n_cur": F.max("n_cur").over(w)}).fillna(0, ["share_ref", "share_cur", "n_ref", "n_cur"])
    a, b = F.col("share_ref") * F.col("n_ref"), F.col("share_cur") * F.col("n_cur")
    all_n = F.col("n_ref") + F.col("n_cur")
    expected = [(a + b) * F.col(n) / all_n for n in ("n_ref", "n_cur")]
    chi = F.coalesce(F.try_divide(F.pow(a - expected[0], 2), expected[0]), F.lit(0.0)) + F.coalesce(F.try_divide(F.pow(b - expected[1], 2), expected[1]), F.lit(0.0))
    new = F.col("share_ref") == 0
    return joined.groupBy(*keys, "column_name").agg(
        psi_sum(F.col("share_ref"), F.col("share_cur")).alias("psi"), F.count("*").alias("bins"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"),
        F.sum(chi).alias("chi2"), F.sum(F.when(new, F.col("share_cur")).otherwise(0.0)).alias("new_share"), F.count_if(new).alias("new_categories"),
    )


def ks_statistics(ref: DataFrame, cur: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, ks, n_ref, n_cur): the largest distance of the distribution functions, from counts per distinct value."""
    columns = columns or [c for c in numeric_columns(ref) if c in cur.columns]
    one = lambda df, a, b: stacked(df, columns, []).where("value IS NOT NULL").groupBy("column_name", "value").agg((F.count("*") * a).alias("a"), (F.count("*") * b).alias("b"))
    counts = one(ref, 1, 0).unionByName(one(cur, 0, 1)).groupBy("column_name", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    up = running(counts, "value", ["a", "b"], ["column_name"]).withColumnsRenamed({"a_all": "ta", "b_all": "tb"})
    up = up.withColumns({"ca": F.col("a_before") + F.col("a"), "cb": F.col("b_before") + F.col("b")})
    return up.groupBy("column_name").agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("ks"), F.max("ta").alias("n_ref"), F.max("tb").alias("n_cur"))


def missing_shift(ref: DataFrame, cur: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, missing_ref, missing_cur, severity): moderate from 5 points, severe from 20."""
    one = lambda df, name: stacked(df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)), columns, [], value=name)
    change = F.abs(F.col("missing_cur") - F.col("missing_ref"))
    out = one(ref, "missing_ref").join(one(cur, "missing_cur"), "column_name")
    return out.withColumn("severity", F.when(change >= 0.2, "severe").when(change >= 0.05, "moderate").otherwise("none"))


def structural_columns(df: DataFrame) -> list[str]:
    """Columns that drift by nature: times, date-shaped text and identifiers."""
    times = [f.name for f in df.schema if f.dataType.typeName().startswith("timestamp") or f.dataType.typeName() == "date"]
    texts = [c for c in df.columns if df.schema[c].dataType.typeName() == "string"]
    row = df.agg(*(F.coalesce(F.avg(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}").cast("double")), F.lit(0.0)).alias(c) for c in texts)).first() if texts else {}
    dates = [c for c in texts if row[c] >= 0.95]
    ids = [r.column_name for r in identifiers(df).where("signal IN ('near_unique', 'identifier_ratio', 'name', 'high_cardinality')").collect()]
    return [c for c in df.columns if c in {*times, *dates, *ids}]


def detect_drift(ref: DataFrame, cur: DataFrame, key_columns: list[str] | None = None, target: str | None = None) -> tuple[DataFrame, str]:
    """(rows per shared column, verdict): the verdict is the worst severity among the key columns, "blocked" if one is missing.

    Rows: (column_name, kind, psi, floor, statistic, p_value, new_share, severity, is_key, is_target).
    """
    spark = ref.sparkSession
    skip = set(structural_columns(ref))
    shared = [c for c in ref.columns if c in cur.columns and c not in skip]
    numbers = [c for c in numeric_columns(ref) if c in shared and c in numeric_columns(cur)]
    texts = [c for c in text_columns(ref) if c in shared and c in text_columns(cur)]
    changed = [c for c in shared if c not in numbers and c not in texts]
    rows = []
    if numbers:
        ks = {r.column_name: r for r in ks_statistics(ref, cur, numbers).collect()}
        for r in psi_numeric(ref, cur, numbers).collect():
            k = ks.get(r.column_name)
            d = k.ks if k else 0.0
            rows.append((r.column_name, "numeric", r.psi, noise_floor(r.bins, r.n_ref or 0, r.n_cur or 0), d, ks_sf(d, r.n_ref or 1, r.n_cur or 1), 0.0))
    if texts:
        for r in psi_categorical(ref, cur, texts).collect():
            rows.append((r.column_name, "text", r.psi, noise_floor(r.bins, r.n_ref or 0, r.n_cur or 0), r.chi2, chi2_sf(r.chi2, max(1, r.bins - 1)), r.new_share))
    rows += [(c, "type_changed", None, None, None, None, 0.0) for c in changed]
    schema = "column_name string, kind string, psi double, floor double, statistic double, p_value double, new_share double"
    out = spark.createDataFrame(rows, schema).join(missing_shift(ref, cur, shared).withColumnRenamed("severity", "_m"), "column_name", "left")
    base = F.when(F.col("kind") == "type_changed", "severe").otherwise(severity(F.col("psi"), F.col("floor")))
    base = F.when((base == "none") & (F.col("new_share") >= 0.01), "moderate").otherwise(base)
    worst = F.when((base == "severe") | (F.col("_m") == "severe"), "severe").when((base == "moderate") | (F.col("_m") == "moderate"), "moderate").otherwise("none")
    keys = key_columns or [c for c in shared if c != target]
    out = out.withColumns({"severity": worst, "is_key": F.col("column_name").isin(keys), "is_target": F.lit(False) if target is None else F.col("column_name") == target}).drop("_m")
    if any(k not in cur.columns for k in keys):
        return out, "blocked"
    found = {r.severity for r in out.where("is_key").select("severity").distinct().collect()}
    return out, next((s for s in ("severe", "moderate") if s in found), "none")


def drift_over_time(ref: DataFrame, cur: DataFrame, period: Column, columns: list[str], least: int = 100) -> DataFrame:
    """(period, column_name, psi, n_cur, severity) of the periods with `least` rows or more, all in one job."""
    base = cur.withColumn("period", period)
    big = base.groupBy("period").count().where(F.col("count") >= least).select("period")
    numbers = [c for c in columns if c in numeric_columns(ref)]
    texts = [c for c in columns if c not in numbers]
    base = base.join(big, "period")
    parts = [psi_numeric(ref, base, numbers, keys=["period"]).select("period", "column_name", "psi", "n_cur")] if numbers else []
    parts += [psi_categorical(ref, base, texts, keys=["period"]).select("period", "column_name", "psi", "n_cur")] if texts else []
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("severity", severity(F.col("psi"), F.lit(0.0)))


def first_drift(over_time: DataFrame) -> DataFrame:
    """(column_name, first_drift, latest_severity, worst_psi)."""
    return over_time.groupBy("column_name").agg(F.min(F.when(F.col("severity") != "none", F.col("period"))).alias("first_drift"), F.max_by("severity", "period").alias("latest_severity"), F.max("psi").alias("worst_psi"))


def compare_distributions(ref: DataFrame, cur: DataFrame, column: str, top: int = 10) -> DataFrame:
    """(value, share_ref, share_cur) of the most common values of both sides."""
    one = lambda df, name: df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).count().withColumn(name, F.col("count") / F.sum("count").over(Window.partitionBy())).drop("count")
    both = one(ref, "share_ref").join(one(cur, "share_cur"), "value", "full").fillna(0.0, ["share_ref", "share_cur"])
    return both.orderBy(F.desc(F.greatest("share_ref", "share_cur")), "value").limit(top)


def domain_classifier(ref: DataFrame, cur: DataFrame, columns: list[str], key: str, folds: int = 3, sample_rows: int = 20_000, seed: int = 42) -> DataFrame:
    """One row (auc, severity): how well boosted trees tell the tables apart on folds they weren't fitted on.

    The sample of each side is a parameter, as the fit is what grows; 0.6 and 0.75 are the bounds.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from quillon.operators.metrics import auc_ap
    from quillon.operators.splits import kfold, structure_sample
    from quillon.session import materialise

    n = min(ref.count(), cur.count(), sample_rows)
    side = lambda df, y: structure_sample(df.select(key, *columns).dropna(subset=columns), n).withColumn("label", F.lit(float(y)))
    both = VectorAssembler(inputCols=columns, outputCol="features").transform(side(ref, 0).unionByName(side(cur, 1)))
    both = materialise(kfold(both, key, folds).select("features", "label", "cv"), "domain")
    scored = None
    for k in range(folds):
        model = GBTClassifier(maxIter=20, maxDepth=4, seed=seed).fit(both.where(F.col("cv") != k))
        part = model.transform(both.where(F.col("cv") == k)).select("label", vector_to_array("probability")[1].alias("s"))
        scored = part if scored is None else scored.unionByName(part)
    out = auc_ap(scored, "label", "s").select(F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("auc"))
    return out.withColumn("severity", F.when(F.col("auc") >= 0.75, "severe").when(F.col("auc") >= 0.6, "moderate").otherwise("none"))
