"""Segmentation: fits, assignment, quality, stability, profiles and migration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import Imputer, MinMaxScaler, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.basics import stacked
from quillon.operators.density import dbscan  # noqa: F401  one of the segmentations
from quillon.operators.fitted import skewed_columns
from quillon.session import materialise


def distance_space(df: DataFrame, numbers: list[str], texts: list[str] | None = None, gower: bool = False) -> tuple[DataFrame, PipelineModel]:
    """Rows with `space`: logged where skewed and standardised numbers with unscaled one-hot text, or the Gower space.

    In the Gower space numbers are scaled to [0, 1] and one-hot columns weigh a half, for Manhattan distances.
    """
    texts = texts or []
    logs = [] if gower else skewed_columns(df, numbers)
    names = [f"_x_{c}" for c in numbers]
    df = df.withColumns({f"_x_{c}": (F.log1p(c) if c in logs else F.col(c).cast("double")) for c in numbers})
    stages = [Imputer(inputCols=names, outputCols=names, strategy="median"), VectorAssembler(inputCols=names, outputCol="_num")]
    stages.append(MinMaxScaler(inputCol="_num", outputCol="_scaled") if gower else StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True))
    parts = ["_scaled"]
    for c in texts:
        stages += [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep"), OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_h_{c}", dropLast=False)]
        parts.append(f"_h_{c}")
    model = Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="space")]).fit(df)
    out = model.transform(df).drop(*names, "_num", "_scaled", *(f"_{k}_{c}" for c in texts for k in "ih"))
    if gower and texts:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        half = F.transform(vector_to_array("space"), lambda x, i: F.when(i >= len(numbers), x * 0.5).otherwise(x))
        out = out.withColumn("space", array_to_vector(half))
    return out, model


class Merged:
    """A k-means fit with many centres whose centres were merged into fewer segments."""

    def __init__(self, model, segment_of: list[int]) -> None:
        self.model, self.segment_of = model, segment_of

    def transform(self, df: DataFrame) -> DataFrame:
        lookup = F.array(*map(F.lit, self.segment_of))
        return self.model.transform(df).withColumn("segment", F.element_at(lookup, F.col("segment") + 1))


def merge_centres(centres: np.ndarray, sizes: np.ndarray, k: int) -> list[int]:
    """Ward's merges of weighted centres down to k groups."""
    groups = [[i] for i in range(len(centres))]
    centres, sizes = [c for c in centres], [float(s) for s in sizes]
    while len(groups) > k:
        cost, i, j = min((sizes[i] * sizes[j] / max(sizes[i] + sizes[j], 1e-9) * float(((centres[i] - centres[j]) ** 2).sum()), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        total = sizes[i] + sizes[j]
        centres[i] = (centres[i] * sizes[i] + centres[j] * sizes[j]) / max(total, 1e-9)
        sizes[i] = total
        groups[i] += groups.pop(j)
        centres.pop(j)
        sizes.pop(j)
    owner = {m: g for g, members in enumerate(groups) for m in members}
    return [owner[m] for m in range(len(owner))]


def fit(df: DataFrame, algorithm: str, k: int, seed: int = 42, micro: int = 40):
    """kmeans and minibatch_kmeans share one distributed fit; gmm has full covariances, the likeliest of five starts.

    hierarchical merges `micro` k-means centres by Ward's criterion, so it has no row limit and new rows are assigned.
    """
    one = lambda c, k, s: c(k=k, seed=s, featuresCol="space", predictionCol="segment").fit(df)
    if algorithm in ("kmeans", "minibatch_kmeans"):
        return one(KMeans, k, seed)
    if algorithm == "gmm":
        return max((one(GaussianMixture, k, seed + i) for i in range(5)), key=lambda m: m.summary.logLikelihood)
    if algorithm != "hierarchical":
        raise ValueError(f"no algorithm {algorithm!r}")
    model = one(KMeans, max(k, micro), seed)
    return Merged(model, merge_centres(np.array(model.clusterCenters()), np.array(model.summary.clusterSizes), k))


def nearest_centre(df: DataFrame, centres: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, centre, distance): the nearest of (centre, v) by Euclidean distance, ties to the smaller centre.

    Centres are few by construction (k rows); each row is compared with them inside the JVM.
    """
    c = F.broadcast(centres.agg(F.array_sort(F.collect_list(F.struct("centre", "v"))).alias("_cs")))
    square = lambda v: F.aggregate(F.zip_with(F.col(vector), v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("_cs", lambda r: F.struct(F.sqrt(square(r["v"])).alias("d"), r["centre"].alias("c"))))
    return df.crossJoin(c).select(key, best.alias("_b")).select(key, F.col("_b.c").alias("centre"), F.col("_b.d").alias("distance"))


def k_medoids(df: DataFrame, k: int, fit_rows: int = 2000, n_init: int = 3, iterations: int = 20, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """df with `segment`: medoids of a sample (by key hash, else at random) of at most fit_rows rows under Manhattan distance; every row is assigned.

    Each start is one task over the sample; the start of least cost over all rows is kept.
    """
    from pyspark.ml.functions import vector_to_array

    rows = df.withColumn("_v", vector_to_array("space"))
    sample = materialise(rows.orderBy(F.xxhash64(*key, F.lit(seed)) if key else F.rand(seed)).limit(fit_rows).select("_v").withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(n_init - 1)))), "sample")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, rng = np.stack(pdf["_v"].to_numpy()), np.random.default_rng(seed + int(pdf["start"].iloc[0]))
        medoids = [int(rng.integers(len(x)))]
        while len(medoids) < min(k, len(x)):
            d = np.min([np.abs(x - x[m]).sum(1) for m in medoids], axis=0)
            medoids.append(int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(x))))
        for _ in range(iterations):
            owner = np.argmin([np.abs(x - x[m]).sum(1) for m in medoids], axis=0)
            new = []
            for j, m in enumerate(medoids):
                own = np.flatnonzero(owner == j)
                new.append(int(own[np.argmin([np.abs(x[own] - x[i]).sum() for i in own])]) if len(own) else m)
            if new == medoids:
                break
            medoids = new
        return pd.DataFrame({"start": pdf["start"].iloc[0], "medoids": [[list(map(float, x[m])) for m in medoids]]})

    starts = sample.groupBy("start").applyInPandas(one, "start int, medoids array<array<double>>")
    manhattan = lambda m: F.aggregate(F.zip_with("_v", m, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    near = F.array_min(F.transform("medoids", lambda m, i: F.struct(manhattan(m).alias("d"), i.alias("segment"))))
    found = materialise(starts, "medoids")
    costs = rows.crossJoin(F.broadcast(found)).withColumn("_n", near).groupBy("start").agg(F.sum("_n.d").alias("cost"))
    best = costs.orderBy("cost", "start").first()["start"]
    return rows.crossJoin(F.broadcast(found.where(F.col("start") == best).drop("start"))).withColumn("segment", near["segment"]).drop("_v", "medoids")


def cluster_quality(df: DataFrame, columns: list[str], segment: str = "segment") -> DataFrame:
    """One row (segments, rows, noise_share, within, between, calinski_harabasz) from grouped sums of squares."""
    known = df.where(F.col(segment) != -1)
    long = stacked(known, columns, [segment])
    per = long.groupBy(segment, "column_name").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    total = long.groupBy("column_name").agg(F.avg("value").alias("g"))
    sums = per.join(F.broadcast(total), "column_name").agg(F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("between"), F.count_distinct(segment).alias("segments"))
    rows = df.agg(F.count("*").alias("rows"), F.avg((F.col(segment) == -1).cast("double")).alias("noise_share"))
    ch = F.try_divide(F.col("between") / (F.col("segments") - 1), F.col("within") / (F.col("rows") * (1 - F.col("noise_share")) - F.col("segments")))
    return sums.crossJoin(rows).withColumn("calinski_harabasz", F.when(F.col("segments") > 1, ch))


def silhouette(df: DataFrame) -> float:
    """The squared-Euclidean silhouette of rows (space, segment), over all rows."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(featuresCol="space", predictionCol="segment").evaluate(df)


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ari) from the contingency table of two labellings."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    sa = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sa"), F.sum("n").alias("all"))
    sb = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sb"))
    row = cells.agg(F.sum(two("n")).alias("s")).crossJoin(sa).crossJoin(sb)
    expected = F.col("sa") * F.col("sb") / two("all")
    return row.select(F.coalesce(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0)).alias("ari"))


def stability(df: DataFrame, key: str, algorithm: str, k: int, refits: int = 10, seed: int = 42) -> DataFrame:
    """(refit, ari): agreement of the full fit with fits on 80 % of the rows."""
    full = fit(df, algorithm, k, seed).transform(df).select(key, F.col("segment").alias("a"))
    out = None
    for i in range(refits):
        part = df.where(F.pmod(F.xxhash64(key, F.lit(seed + i)), F.lit(10)) < 8)
        again = fit(part, algorithm, k, seed + i + 1).transform(part).select(key, F.col("segment").alias("b"))
        one = adjusted_rand(full.join(again, key), "a", "b").select(F.lit(i).alias("refit"), "ari")
        out = one if out is None else out.unionByName(one)
    return out


def propose_k(df: DataFrame, key: str, ks: list[int], algorithm: str = "kmeans", seed: int = 42) -> DataFrame:
    """(k, silhouette, stability, stable): the best k is that of the highest silhouette among the stable ones."""
    rows = []
    for k in ks:
        scored = fit(df, algorithm, k, seed).transform(df)
        mean = stability(df, key, algorithm, k, 3, seed).agg(F.avg("ari")).first()[0]
        rows.append((k, silhouette(scored), mean, mean >= 0.7))
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, stability double, stable boolean")


def profiles(df: DataFrame, numbers: list[str], segment: str = "segment") -> DataFrame:
    """(segment, column_name, n, share, median, mean_z): what sets a segment apart."""
    long = stacked(df, numbers, [segment])
    total = long.groupBy("column_name").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    per = long.groupBy(segment, "column_name").agg(F.count("*").alias("n"), F.median("value").alias("median"), F.avg("value").alias("_a"))
    w = Window.partitionBy("column_name")
    out = per.withColumn("share", F.col("n") / F.sum("n").over(w)).join(F.broadcast(total), "column_name")
    return out.select(segment, "column_name", "n", "share", "median", F.try_divide(F.col("_a") - F.col("_m"), F.col("_s")).alias("mean_z"))


def lifts(df: DataFrame, texts: list[str], segment: str = "segment", least: float = 1.5) -> DataFrame:
    """(segment, column_name, value, share, lift) of values over `least` times as common as overall."""
    counts = stacked(df, texts, [segment], kind="string").where("value IS NOT NULL").groupBy(segment, "column_name", "value").count()
    own, value, all_ = Window.partitionBy(segment, "column_name"), Window.partitionBy("column_name", "value"), Window.partitionBy("column_name")
    share = F.col("count") / F.sum("count").over(own)
    lift = share / (F.sum("count").over(value) / F.sum("count").over(all_))
    return counts.select(segment, "column_name", "value", share.alias("share"), lift.alias("lift")).where(F.col("lift") >= least)


def eta_squared(df: DataFrame, group: str, y: str) -> DataFrame:
    """One row (eta_squared): the between-group share of the sum of squares of y."""
    per = df.where(F.col(y).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    parts = per.agg(F.sum(F.col("n") * F.col("v")).alias("w"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("b"))
    return parts.select(F.try_divide(F.col("b"), F.col("b") + F.col("w")).alias("eta_squared"))


def transitions(df: DataFrame, entity: str, period: str, segment: str, order: Column | None = None) -> DataFrame:
    """(entity, period, from, to) of each entity's consecutive periods; the last row of a period counts."""
    w = Window.partitionBy(entity, period).orderBy(F.desc_nulls_last(order if order is not None else F.col(segment)))
    last = df.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    nxt = F.lead(segment).over(Window.partitionBy(entity).orderBy(period))
    return last.select(entity, period, F.col(segment).alias("from"), nxt.alias("to")).where(F.col("to").isNotNull())


def migration_matrix(moves: DataFrame) -> DataFrame:
    """(from, to, n, share): shares of where a segment's entities go."""
    counts = moves.groupBy("from", "to").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def stay_rates(moves: DataFrame) -> DataFrame:
    """(segment, n, stay_rate), with the overall rate under segment null."""
    stay = (F.col("from") == F.col("to")).cast("double")
    return moves.rollup(F.col("from").alias("segment")).agg(F.count("*").alias("n"), F.avg(stay).alias("stay_rate"))


def top_flows(moves: DataFrame, n: int = 5) -> DataFrame:
    return migration_matrix(moves.where(F.col("from") != F.col("to"))).orderBy(F.desc("n"), "from", "to").limit(n)


def moved_by_step(moves: DataFrame, period: str) -> DataFrame:
    return moves.groupBy(period).agg(F.count("*").alias("n"), F.avg((F.col("from") != F.col("to")).cast("double")).alias("moved_share"))


def projection(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """(key, x, y, segment): the two first principal components, for a chart."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    out = PCA(k=2, inputCol="space", outputCol="_p").fit(df).transform(df).withColumn("_p", vector_to_array("_p"))
    return out.select(key, F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"), "segment")


def segment_sizes(df: DataFrame, segment: str = "segment") -> DataFrame:
    """(segment, n, share); noise is a segment of its own."""
    sizes = df.groupBy(segment).agg(F.count("*").alias("n"))
    return sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("_all")))).select(segment, "n", (F.col("n") / F.col("_all")).alias("share"))


def davies_bouldin(df: DataFrame, columns: list[str], segment: str = "segment") -> DataFrame:
    """One row (davies_bouldin): the mean over segments of the largest ratio of two segments' spreads to the distance of their centres.

    A spread is the mean distance of a segment's rows to its centre; noise (-1) and rows with missing values are left out.
    Null with under two segments.  Segments are few: their centres go to every task, as one task would else get all rows of a
    segment; pairs of them are joined, never pairs of rows.
    """
    known = df.where(F.col(segment) != -1).select(segment, *(F.col(c).cast("double").alias(c) for c in columns)).dropna(subset=columns)
    centres = known.groupBy(segment).agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)))
    square = lambda a, b: sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))
    names = [f"_m{i}" for i in range(len(columns))]
    apart = F.sqrt(square([F.col(c) for c in columns], [F.col(n) for n in names]))
    spread = known.join(F.broadcast(centres), segment).groupBy(segment, *names).agg(F.avg(apart).alias("s"))
    other = spread.select(F.col(segment).alias("_other"), F.col("s").alias("_t"), *(F.col(n).alias(f"{n}b") for n in names))
    between = F.sqrt(square([F.col(n) for n in names], [F.col(f"{n}b") for n in names]))
    pairs = spread.join(other, F.col(segment) != F.col("_other"))
    worst = pairs.groupBy(segment).agg(F.max(F.try_divide(F.col("s") + F.col("_t"), between)).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def stability_verdict(refits: DataFrame, least: float = 0.7) -> DataFrame:
    """One row (refits, mean_ari, stable) of stability()'s rows."""
    return refits.agg(F.count("*").alias("refits"), F.avg("ari").alias("mean_ari")).withColumn("stable", F.col("mean_ari") >= least)


def k_warnings(proposed: DataFrame, weak: float = 0.1) -> DataFrame:
    """One row (k, silhouette, warning) of propose_k()'s rows: the stable k of the highest silhouette (else of all), and what to doubt.

    "no structure" if no k is stable or the silhouette stays under `weak`, "at the edge" if the best k is the last tried.
    """
    best = proposed.agg(F.max(F.struct("stable", "silhouette", (-F.col("k")).alias("_k"))).alias("b"), F.max("k").alias("last"))
    k = -F.col("b._k")
    warning = F.when(~F.col("b.stable") | (F.col("b.silhouette") < weak), "no structure").when(k == F.col("last"), "at the edge")
    return best.select(k.alias("k"), F.col("b.silhouette").alias("silhouette"), warning.alias("warning"))


def rule_tree(df: DataFrame, columns: list[str], segment: str = "segment", depth: int = 3) -> tuple[str, float]:
    """(rules, accuracy) of a tree of `depth` levels that tells the segments apart by the columns: segments in words."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="_f").transform(df.select(F.col(segment).cast("string").alias("_s"), *columns).dropna())
    rows = StringIndexer(inputCol="_s", outputCol="_y").fit(rows).transform(rows)
    model = DecisionTreeClassifier(featuresCol="_f", labelCol="_y", maxDepth=depth).fit(rows)
    accuracy = model.transform(rows).agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0]
    return model.toDebugString, accuracy


def distance_columns(df: DataFrame, profile: list[str], keys: list[str]) -> list[str]:
    """The columns that distances use: all but the keys and those marked for profiles only, which must exist."""
    if missing := [c for c in profile if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return [c for c in df.columns if c not in {*profile, *keys}]
