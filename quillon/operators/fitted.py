"""Cleaning and encoding: values fitted on the training fold, applied to all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.basics import bias_corrected_skew, calendar, numeric_columns, parse_time, stacked, text_columns
from quillon.operators.ranking import column_medians

EPS = 1e-6


def custom_feature(df: DataFrame, name: str, expression: str, target: str | None = None) -> DataFrame:
    """A column from a Spark SQL expression over the row's columns (`==` may be written for `=`)."""
    if target and target in expression.replace("`", " ").split():
        raise ValueError(f"{name}: the target cannot be an input")
    return df.withColumn(name, F.expr(expression.replace("==", "=")))


def propose_features(df: DataFrame, target: str, columns: list[str] | None = None, top_k: int = 5) -> DataFrame:
    """Ratio and product candidates (kind, a, b) among the top_k columns by absolute correlation with the target."""
    columns = [c for c in columns or numeric_columns(df) if c != target]
    row = df.agg(*(F.abs(F.corr(c, target)).alias(c) for c in columns)).first()
    best = sorted((c for c in columns if row[c] is not None), key=lambda c: (-row[c], c))[:top_k]
    pairs = [(k, a, b) for i, a in enumerate(best) for b in best[i + 1 :] for k in ("ratio", "product")]
    return df.sparkSession.createDataFrame(pairs, "kind string, a string, b string")


def pair_feature(kind: str, a: str, b: str) -> Column:
    return F.col(a) / (F.col(b) + EPS) if kind == "ratio" else F.col(a) * F.col(b)


def apply_features(df: DataFrame, chosen: list[tuple[str, str, str]]) -> DataFrame:
    short = {"ratio": "over", "product": "times"}
    return df.withColumns({f"{a}_{short[k]}_{b}": pair_feature(k, a, b) for k, a, b in chosen})


def drop_columns(df: DataFrame, columns: list[str], protected: list[str]) -> DataFrame:
    """Without the columns, but never without those that hold a role in the split."""
    return df.drop(*(c for c in columns if c not in protected))


def frequency_table(train: DataFrame, column: str) -> DataFrame:
    """(value, share) of the non-null values."""
    counts = train.where(F.col(column).isNotNull()).groupBy(column).count()
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("_all")))).select(column, (F.col("count") / F.col("_all")).alias(f"{column}_freq"))


def frequency_encode(df: DataFrame, train: DataFrame, column: str, group_column: str | None = None) -> DataFrame:
    """Adds <column>_freq: the value's share in the training rows, 0 for unseen values."""
    if column == group_column:
        raise ValueError("the group column cannot be frequency encoded")
    return df.join(frequency_table(train, column), column, "left").withColumn(f"{column}_freq", F.coalesce(f"{column}_freq", F.lit(0.0)))


def peer_features(df: DataFrame, train: DataFrame, specs: list[dict], target: str | None = None, group_column: str | None = None, least: int = 20) -> DataFrame:
    """Adds features {name, column, by, kind} that compare a row with its peers in the training rows.

    kind "ratio" is x / (|median| + 1e-6), "zscore" is (x - mean) / (std + 1e-6).  Peer groups with fewer than `least`
    non-null rows, and unseen ones, use the statistics of all rows.
    """
    for s in specs:
        if target in (s["column"], s["by"]) or s["by"] == group_column:
            raise ValueError(f"{s['name']}: neither the target nor the entity can be used")
    for by in dict.fromkeys(s["by"] for s in specs):
        own = [s for s in specs if s["by"] == by]
        columns = list(dict.fromkeys(s["column"] for s in own))
        stats = [f(F.col(c)).alias(f"_{k}_{c}") for c in columns for k, f in (("n", F.count), ("med", F.median), ("mean", F.avg), ("std", F.stddev_samp))]
        overall = [f(F.col(c)) for c in columns for f in (F.count, F.avg, F.stddev_samp)]
        names = [f"_all{4 * i + j}" for i in range(len(columns)) for j in (0, 2, 3)]
        medians = column_medians(train, columns).select(*(F.col(c).alias(f"_all{4 * i + 1}") for i, c in enumerate(columns)))
        everyone = train.agg(*(a.alias(n) for a, n in zip(overall, names, strict=True))).crossJoin(medians)
        peers = train.where(F.col(by).isNotNull()).groupBy(by).agg(*stats)
        df = df.join(peers, by, "left").crossJoin(F.broadcast(everyone))
        place = {(c, k): f"_all{4 * i + j}" for i, c in enumerate(columns) for j, k in enumerate(("n", "med", "mean", "std"))}
        for s in own:
            c = s["column"]
            pick = lambda k, c=c: F.when(F.coalesce(F.col(f"_n_{c}"), F.lit(0)) >= least, F.col(f"_{k}_{c}")).otherwise(F.col(place[c, k]))
            made = F.col(c) / (F.abs(pick("med")) + EPS) if s["kind"] == "ratio" else (F.col(c) - pick("mean")) / (pick("std") + EPS)
            df = df.withColumn(s["name"], made)
        df = df.drop(*(f"_{k}_{c}" for c in columns for k in ("n", "med", "mean", "std")), *place.values())
    return df


def propose_imputation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, missing_share, strategy): drop over half missing, median for numbers, mode for text."""
    columns = columns or df.columns
    numbers = set(numeric_columns(df))
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    long = stacked(shares, columns, [], value="missing_share")
    rule = F.when(F.col("missing_share") > 0.5, "drop").when(F.col("column_name").isin(list(numbers)), "median").otherwise("mode")
    return long.where("missing_share > 0").withColumn("strategy", rule)


def fit_imputation(train: DataFrame, strategies: dict[str, str | float]) -> DataFrame:
    """One row with the value for each column: "median", "mean", "mode" (smallest on ties) of the training rows, or a literal."""
    medians = [c for c, s in strategies.items() if s == "median"]
    how = {"mean": F.avg, "mode": lambda c: F.mode(c, deterministic=True)}
    made = [(how[s](c) if s in how else F.first(F.lit(s))).alias(c) for c, s in strategies.items() if s not in ("drop", "median")]
    others = train.agg(*(made or [F.lit(0).alias("_none")]))
    fitted = others.crossJoin(column_medians(train, medians)) if medians else others
    return fitted.select(*(c for c, s in strategies.items() if s != "drop"))


def apply_imputation(df: DataFrame, fitted: DataFrame, dropped: list[str] | None = None) -> DataFrame:
    renamed = fitted.select(*(F.col(c).alias(f"_fill_{c}") for c in fitted.columns))
    out = df.crossJoin(F.broadcast(renamed)).withColumns({c: F.coalesce(c, f"_fill_{c}") for c in fitted.columns})
    return out.drop(*renamed.columns, *(dropped or []))


def fill_forward(df: DataFrame, keys: list[str], time: str, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def interpolate(df: DataFrame, keys: list[str], time: str, column: str) -> DataFrame:
    """Linear in row position between known values of a series; after the last it is held, before the first left null."""
    w = Window.partitionBy(*keys).orderBy(time)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_i"), F.col(column).cast("double").alias("y")))
    out = df.withColumn("_i", F.row_number().over(w)).withColumn("_a", F.last(known, True).over(back)).withColumn("_b", F.first(known, True).over(ahead))
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col("_i") - F.col("_a._i")) / (F.col("_b._i") - F.col("_a._i"))
    value = F.when(F.col(column).isNotNull(), F.col(column).cast("double")).when(F.col("_b").isNull(), F.col("_a.y")).otherwise(line)
    return out.withColumn(column, value).drop("_i", "_a", "_b")


def datetime_features(df: DataFrame, column: str, parts: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Parts of a time column (text is parsed), which replace it unless it is kept."""
    t = parse_time(F.col(column)) if df.schema[column].dataType.typeName() == "string" else F.col(column).cast("timestamp")
    made = calendar(t)
    out = df.withColumns({f"{column}_{p}": made[p] for p in parts or ("year", "month", "day", "dow", "hour")})
    return out if keep else out.drop(column)


def datetime_candidates(df: DataFrame, least: float = 0.95) -> DataFrame:
    """(column_name, parsed_share) of the text columns of whose values at least `least` parse as times."""
    columns = [c for c in text_columns(df) if df.schema[c].dataType.typeName() == "string"]
    row = df.agg(*(F.coalesce(F.try_divide(F.count(parse_time(F.col(c))).cast("double"), F.count(c).cast("double")), F.lit(0.0)).alias(c) for c in columns))
    return stacked(row, columns, [], value="parsed_share").where(F.col("parsed_share") >= least)


def skewed_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Non-negative columns with a skew above 1, which distance spaces take the logarithm of."""
    columns = columns or numeric_columns(df)
    row = df.agg(*(bias_corrected_skew(c).alias(f"s{i}") for i, c in enumerate(columns)), *(F.min(c).alias(f"m{i}") for i, c in enumerate(columns))).first()
    return [c for i, c in enumerate(columns) if (row[f"s{i}"] or 0) > 1 and (row[f"m{i}"] if row[f"m{i}"] is not None else -1) >= 0]


def smote_advice(train: DataFrame, target: str, split: str = "random") -> DataFrame:
    """One row (ratio, minority, advised): only for ratios under 2 % with 10 or more of the minority, and never over time."""
    counts = train.where(F.col(target).isNotNull()).groupBy(target).count()
    one = counts.agg((F.min("count") / F.max("count")).alias("ratio"), F.min("count").alias("minority"))
    return one.withColumn("advised", (F.col("ratio") < 0.02) & (F.col("minority") >= 10) & F.lit(split == "random"))


def smote(train: DataFrame, target: str, columns: list[str], minority, ratio: float = 0.5, seed: int = 42, k: int = 5, **cells) -> DataFrame:
    """Training rows and synthetic minority rows x + u (neighbour - x), up to `ratio` times the majority.

    The neighbour is one of the k nearest of the complete minority rows, found exactly (nearest.neighbour_pairs); equal rows are neighbours at
    no distance.  Every minority row makes its share, the rows left over those of the least hashes, so no limit brings them
    into one task; neighbour and u come from a hash of the row's values, so the result doesn't depend on the partitioning.  Without
    two complete minority rows, or with enough of them, only the training rows come back.
    """
    from quillon.operators.nearest import neighbour_pairs
    from quillon.operators.ranking import running
    from quillon.session import materialise

    names = [f"_x{i}" for i in range(len(columns))]
    of = F.col(target) == minority
    few = train.where(of).select(*(F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True))).dropna()
    points = few.groupBy(*names).agg(F.count("*").alias("w"))
    points = materialise(points.select(F.monotonically_increasing_id().alias("p"), "w", *names), "points")
    counts = train.agg(F.count_if(of).alias("few"), F.count_if(~of).alias("many")).first()
    total, need = points.agg(F.sum("w")).first()[0] or 0, int(ratio * counts["many"]) - counts["few"]
    if need <= 0 or total < 2:
        return train.select(*columns, target)
    pairs = neighbour_pairs(points, names, min(k, total - 1), **cells).select("p", "q", "d", F.col("w").alias("n"))
    beside = pairs.join(points.select(F.col("p").alias("q"), F.struct(*names).alias("x")), "q")
    lists = beside.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("d", "x", "n"))).alias("near"))  # k and those as far as the k-th
    repeated = F.flatten(F.transform("near", lambda y: F.array_repeat(y["x"], F.least(y["n"], F.lit(k)).cast("int"))))
    each, left = divmod(need, total)
    placed = running(points.withColumn("_o", F.struct(F.xxhash64(*names, F.lit(seed)), *names)), "_o", ["w"])
    rows = placed.join(lists.select("p", F.slice(repeated, 1, k).alias("near")), "p").withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)))
    rows = rows.withColumn("_n", each + (F.col("w_before") + F.col("_r") < left).cast("int")).where("_n > 0").withColumn("_j", F.explode(F.sequence(F.lit(1), "_n")))
    draw = lambda salt, n: F.pmod(F.xxhash64(*names, "_r", "_j", F.lit(seed), F.lit(salt)), n)
    rows = rows.withColumn("_y", F.element_at("near", (draw(1, F.size("near")) + 1).cast("int"))).withColumn("_u", draw(2, F.lit(1_000_000)) / 1_000_000.0)
    made = rows.select(*((F.col(n) + F.col("_u") * (F.col("_y")[n] - F.col(n))).alias(c) for c, n in zip(columns, names, strict=True)), F.lit(minority).alias(target))
    return train.select(*columns, target).unionByName(made)

