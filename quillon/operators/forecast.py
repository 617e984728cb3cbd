"""Panels of time series: grids, seasons, lag features, seasonal naive and Holt-Winters forecasts, backtests, bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import smoothing

# Candidate seasons, lags and window widths per step.
SEASONS = {"h": [24, 168], "D": [7, 30, 365], "W": [4, 13, 52], "MS": [3, 6, 12]}
LAGS = {"h": [1, 2, 3, 24, 48, 168], "D": [1, 2, 3, 7, 14, 28], "W": [1, 2, 4, 8, 13], "MS": [1, 2, 3, 6, 12]}
STEPS = {"h": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS", "MS": "INTERVAL 1 MONTH"}


def aggregate_series(df: DataFrame, keys: list[str], time: str, target: str, how: str = "sum", drivers: list[str] | None = None, order: str | None = None) -> DataFrame:
    """One row per series and time; numeric drivers by mean, others by their last value."""
    funcs = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "last": lambda c: F.max_by(c, order or time)}
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    made = [(F.avg(d) if kinds[d] in ("double", "float", "long", "integer", "decimal") else F.max_by(d, order or time)).alias(d) for d in drivers or []]
    return df.groupBy(*keys, time).agg(funcs[how](target).alias(target), *made)


def infer_step(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """One row (step_seconds, share): the commonest difference of consecutive times."""
    w = Window.partitionBy(*keys).orderBy(time)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    steps = df.select(((t - F.lag(t).over(w)) / 1e6).alias("step_seconds")).where("step_seconds IS NOT NULL").groupBy("step_seconds").count()
    return steps.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy())).orderBy(F.desc("count"), "step_seconds").limit(1).drop("count")


def regular_step(df: DataFrame, keys: list[str], time: str, least: float = 0.8) -> tuple[str | int, float]:
    """(step, share): h, D, W, MS or a number of seconds, and its share of the differences of consecutive times, `least` or more.

    Months are steps of 28 to 31 days.  Raises without such a step.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    steps = df.select(((t - F.lag(t).over(w)) / 1e6).alias("s")).where("s > 0").groupBy("s").count()
    months = F.coalesce(F.sum(F.when(F.col("s").between(28 * 86_400, 31 * 86_400), F.col("count"))), F.lit(0))
    row = steps.agg(F.max(F.struct("count", (-F.col("s")).alias("s"))).alias("top"), F.sum("count").alias("n"), months.alias("months")).first()
    if row.n and row.months >= least * row.n:
        return "MS", row.months / row.n
    if not row.n or row.top["count"] < least * row.n or -row.top["s"] != int(-row.top["s"]):
        raise ValueError(f"no step covers {least:.0%} of the differences between times")
    seconds = int(-row.top["s"])
    return {3600: "h", 86_400: "D", 604_800: "W"}.get(seconds, seconds), row.top["count"] / row.n


def snap(df: DataFrame, keys: list[str], time: str, step: str | int) -> DataFrame:
    """df with times moved back to the grid of their series, which starts at its first time (months: at the first of each), and _off where moved."""
    kind = df.schema[time].dataType
    if step == "MS":
        at = F.date_trunc("month", time).cast(kind)
        return df.withColumn("_off", at != F.col(time)).withColumn(time, at)
    size = 1_000_000 * (step if isinstance(step, int) else {"h": 3600, "D": 86_400, "W": 604_800}[step])
    first = df.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.min(time).alias("_first"))
    both = df.join(first, [df[k].eqNullSafe(first[f"_k_{k}"]) for k in keys]) if keys else df.crossJoin(F.broadcast(first))
    start = F.unix_micros(F.col("_first").cast("timestamp"))
    at = F.timestamp_micros(start + F.floor((F.unix_micros(F.col(time).cast("timestamp")) - start) / size) * size).cast(kind)
    return both.withColumn("_off", at != F.col(time)).withColumn(time, at).select(*df.columns, "_off")


def fill_grid(df: DataFrame, keys: list[str], time: str, step: str | int = "D") -> DataFrame:
    """Every series on a regular grid from its own first to the panel's last time, by a step (a number: seconds); inserted rows are null."""
    last = F.broadcast(df.agg(F.max(time).alias("_end")))
    spans = df.groupBy(*keys).agg(F.min(time).alias("_from")).crossJoin(last)
    interval = STEPS[step] if isinstance(step, str) else f"INTERVAL {step} SECONDS"
    grid = spans.select(*keys, F.explode(F.expr(f"sequence(_from, _end, {interval})")).alias(time))
    held = df.select(*(F.col(c).alias(f"_k_{c}" if c in (*keys, time) else c) for c in df.columns))
    same = [grid[k].eqNullSafe(held[f"_k_{k}"]) for k in keys] + [grid[time] == held[f"_k_{time}"]]
    return grid.join(held, same, "left").drop(*(f"_k_{c}" for c in (*keys, time)))


def panel_status(df: DataFrame, keys: list[str], time: str, y: str, horizon: int, season: int = 1, max_lag: int = 0) -> DataFrame:
    """(keys, n, last, status): stale if the series ends before the hold-out, too_short below max(2 season, max_lag + 5, 10) + horizon rows."""
    known = df.where(F.col(y).isNotNull())
    days = F.broadcast(df.select(time).distinct().orderBy(F.desc(time)).limit(horizon).agg(F.min(time).alias("_hold")))
    least = max(2 * season, max_lag + 5, 10) + horizon
    out = known.groupBy(*keys).agg(F.count("*").alias("n"), F.max(time).alias("last")).crossJoin(days)
    return out.withColumn("status", F.when(F.col("last") < F.col("_hold"), "stale").when(F.col("n") < least, "too_short").otherwise("usable")).drop("_hold")


def autocorrelations(df: DataFrame, keys: list[str], time: str, y: str, lags: list[int]) -> DataFrame:
    """(keys, lag, acf): correlation of y with itself `lag` steps back."""
    w = Window.partitionBy(*keys).orderBy(time)
    shifted = df.withColumns({f"_l{k}": F.lag(y, k).over(w) for k in lags})
    made = [F.struct(F.lit(k).alias("lag"), F.corr(y, f"_l{k}").alias("acf")) for k in lags]
    return shifted.groupBy(*keys).agg(F.array(*made).alias("_a")).select(*keys, F.explode("_a").alias("_p")).select(*keys, "_p.*")


def choose_season(df: DataFrame, time: str, y: str, step: str) -> int:
    """The candidate season of highest autocorrelation with three full cycles, or 1."""
    n = df.count()
    usable = [m for m in SEASONS[step] if n >= 3 * m]
    if not usable:
        return 1
    best = autocorrelations(df, [], time, y, usable).orderBy(F.desc_nulls_last("acf"), "lag").first()
    return best.lag if best.acf and best.acf > 0.3 else 1


def lag_features(df: DataFrame, keys: list[str], time: str, y: str, lags: list[int], windows: list[int]) -> DataFrame:
    """lag_N, and roll_W_mean over the W rows before, null unless all are known."""
    w = Window.partitionBy(*keys).orderBy(time)
    made = {f"lag_{k}": F.lag(y, k).over(w) for k in lags}
    for k in windows:
        frame = w.rowsBetween(-k, -1)
        made[f"roll_{k}_mean"] = F.when(F.count(y).over(frame) == k, F.avg(y).over(frame))
    return df.withColumns(made)


def seasonal_naive(history: DataFrame, keys: list[str], time: str, y: str, season: int, horizon: int) -> DataFrame:
    """(keys, step, forecast): the last season repeated."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time)))
    last = history.withColumn("_r", rank).where(F.col("_r") <= season)
    first = season - F.col("_r") + 1
    last = last.withColumn("_first", first).where(F.col("_first") <= horizon)
    steps = last.withColumn("step", F.explode(F.sequence("_first", F.lit(horizon), F.lit(season))))
    return steps.select(*keys, F.col("step").cast("int").alias("step"), F.col(y).alias("forecast"))


def origins(n_splits: int, horizon: int) -> list[int]:
    """Rows from the end at which each non-overlapping backtest starts."""
    return [horizon * (k + 1) for k in range(n_splits)]


def backtest_naive(df: DataFrame, keys: list[str], time: str, y: str, season: int, horizon: int, n_splits: int = 3) -> DataFrame:
    """(keys, origin, step, actual, forecast) of the seasonal naive at each origin, all origins in one job.

    Step s at an origin takes the value ceil(s / season) seasons back, so that only history before the origin is used.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(time))
    back = df.withColumn("_b", F.row_number().over(w))  # 1 is the last row
    marked = back.withColumn("origin", F.explode(F.array(*map(F.lit, range(1, n_splits + 1)))))
    step = F.col("origin") * horizon - F.col("_b") + 1
    actual = marked.withColumn("step", step).where((F.col("step") >= 1) & (F.col("step") <= horizon))
    source = F.col("_b") + F.ceil(F.col("step") / season) * season
    past = back.select(*keys, F.col("_b").alias("_src"), F.col(y).alias("forecast"))
    return actual.withColumn("_src", source).join(past, [*keys, "_src"]).select(*keys, "origin", F.col("step").cast("int").alias("step"), F.col(y).alias("actual"), "forecast")


def forecast_metrics(errors: DataFrame, keys: list[str], actual: str = "actual", forecast: str = "forecast", scale: str | None = None) -> DataFrame:
    """(keys, n, rmse, mae, wape, bias_pct[, mase]); scale is the series' mean absolute seasonal change."""
    a, e = F.col(actual), F.col(forecast) - F.col(actual)
    extra = [(F.avg(F.abs(e)) / F.max(scale)).alias("mase")] if scale else []
    return errors.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.try_divide(100 * F.sum(F.abs(e)), F.sum(F.abs(a))).alias("wape"), F.try_divide(100 * F.sum(e), F.sum(F.abs(a))).alias("bias_pct"), *extra,
    )


def mase_scale(df: DataFrame, keys: list[str], time: str, y: str, season: int) -> DataFrame:
    """(keys, scale): the mean absolute change over a season."""
    w = Window.partitionBy(*keys).orderBy(time)
    return df.withColumn("_d", F.abs(F.col(y) - F.lag(y, season).over(w))).groupBy(*keys).agg(F.avg("_d").alias("scale"))


def pooled_rmse(parts: DataFrame) -> DataFrame:
    """One row (rmse) of rows (n, rmse)."""
    return parts.agg(F.sqrt(F.sum(F.col("n") * F.col("rmse") * F.col("rmse")) / F.sum("n")).alias("rmse"))


def interval_bands(errors: DataFrame, horizon: int, low: float = 0.1, high: float = 0.9, reach: int = 2) -> DataFrame:
    """(step, low, high): residual quantiles of the steps within `reach`, made to widen with the step.

    errors has (step, residual), residual being actual less forecast.
    """
    near = errors.withColumn("step", F.explode(F.sequence(F.greatest(F.lit(1), F.col("step") - reach), F.least(F.lit(horizon), F.col("step") + reach))))
    q = near.groupBy("step").agg(F.percentile("residual", F.lit(low)).alias("q_low"), F.percentile("residual", F.lit(high)).alias("q_high"), F.count("*").alias("n")).where("n >= 10")
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return q.select("step", F.min("q_low").over(w).alias("low"), F.max("q_high").over(w).alias("high"))


def panel_score(errors: DataFrame, keys: list[str], naive: DataFrame) -> DataFrame:
    """One row (series, wape, beat_naive_share): pooled error, and how many series do better than their own naive."""
    own = forecast_metrics(errors, keys).select(*keys, F.col("mae").alias("m"), "n", "wape")
    base = forecast_metrics(naive, keys).select(*keys, F.col("mae").alias("b"))
    pooled = errors.agg(F.try_divide(100 * F.sum(F.abs(F.col("forecast") - F.col("actual"))), F.sum(F.abs("actual"))).alias("wape"))
    return own.join(base, keys).agg(F.count("*").alias("series"), F.avg((F.col("m") < F.col("b")).cast("double")).alias("beat_naive_share")).crossJoin(pooled)


def smooth(y: np.ndarray, m: int, damped: bool) -> tuple[float, np.ndarray]:
    """Additive Holt-Winters on a small grid of weights: (AIC, function state to forecast from)."""
    best = (np.inf, None)
    season0 = y[:m] - y[:m].mean() if m > 1 else np.zeros(1)
    for a in (0.1, 0.3, 0.6):
        for b in (0.01, 0.1):
            for g in (0.05, 0.2) if m > 1 else (0.0,):
                phi, level, trend, s, sse = (0.9 if damped else 1.0), y[: max(m, 1)].mean(), 0.0, season0.copy(), 0.0
                for t, v in enumerate(y):
                    k = t % len(s)
                    e = v - (level + phi * trend + s[k])
                    sse += e * e
                    level, trend = level + phi * trend + a * e, phi * trend + a * b * e
                    s[k] += g * e
                aic = len(y) * np.log(max(sse, 1e-12) / len(y)) + 2 * (3 + damped + m)
                if aic < best[0]:
                    best = (aic, (level, trend, phi, s, len(y)))
    return best


def holt_winters(history: DataFrame, keys: list[str], time: str, y: str, season: int, horizon: int) -> DataFrame:
    """(keys, step, forecast): per series, damped or undamped by AIC; series under two seasons repeat their last season.

    Never below 0 where the history isn't.  A series is one group, as its states follow each other.
    """
    kinds = ", ".join(f"{k} {history.schema[k].dataType.simpleString()}" for k in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(time)[y].astype(float).ffill().bfill().to_numpy()
        steps = np.arange(1, horizon + 1)
        if len(v) < max(2 * season, 10):
            last = v[-season:]
            f = last[(steps - 1) % len(last)]
        else:
            level, trend, phi, s, n = min((smooth(v, season, d) for d in (False, True)), key=lambda x: x[0])[1]
            f = level + trend * np.cumsum(phi**steps) + s[(n + steps - 1) % len(s)]
        if v.min() >= 0:
            f = np.maximum(f, 0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * horizon for k in keys}, "step": steps.astype("int32"), "forecast": f})

    return history.select(*keys, time, y).groupBy(*keys).applyInPandas(fit, f"{kinds}, step int, forecast double")


def _by_series(history: DataFrame, keys: list[str], time: str, y: str, make, schema: str, together: int = 32) -> DataFrame:
    """make(first rows, series of numbers) over groups of about `together` whole series, chosen by the hash of their keys."""
    groups = max(1, history.select(*keys).distinct().count() // together)
    rows = history.select(*keys, time, y, F.pmod(F.xxhash64(F.lit(0), *keys), F.lit(groups)).alias("_group"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [p.sort_values(time) for _, p in pdf.groupby(keys, dropna=False, sort=True)] if keys else [pdf.sort_values(time)]
        return make([{k: p[k].iloc[0] for k in keys} for p in parts], [p[y].astype(float).ffill().bfill().to_numpy() for p in parts])

    return rows.groupBy("_group").applyInPandas(run, schema)


def _fitted(series: list[np.ndarray], season: int) -> list[dict | None]:
    """A smoothing model for each series of two seasons and ten rows or more that has a value, else None."""
    usable = [i for i, v in enumerate(series) if len(v) >= max(2 * season, 10) and not np.isnan(v).any()]
    made: list[dict | None] = [None] * len(series)
    for i, model in zip(usable, smoothing.fit([series[i] for i in usable], season) if usable else [], strict=True):
        made[i] = model
    return made


def likelihood_smoothing(history: DataFrame, keys: list[str], time: str, y: str, season: int, horizon: int) -> DataFrame:
    """(keys, step, forecast) of Holt-Winters, weights and first states of each series by likelihood, damped or undamped by AIC.

    Series under two seasons repeat their last season; `holt_winters` takes the weights from a small grid instead.
    Never below 0 where the history isn't; null for a series without a value; gaps take the value before.  Some 32 series
    are fitted together; a series is never split, as its states follow each other.
    """
    kinds = "".join(f"`{k}` {history.schema[k].dataType.simpleString()}, " for k in keys)
    steps = np.arange(1, horizon + 1)

    def make(names: list[dict], series: list[np.ndarray]) -> pd.DataFrame:
        out = []
        for name, v, model in zip(names, series, _fitted(series, season), strict=True):
            last = v[-season:]
            f = last[(steps - 1) % len(last)] if model is None else smoothing.ahead(model, horizon)
            f = np.maximum(f, 0) if v.min() >= 0 else f
            out.append(pd.DataFrame({**{k: [x] * horizon for k, x in name.items()}, "step": steps.astype("int32"), "forecast": f}))
        return pd.concat(out)

    return _by_series(history, keys, time, y, make, f"{kinds}step int, forecast double")


def smoothing_weights(history: DataFrame, keys: list[str], time: str, y: str, season: int) -> DataFrame:
    """(keys, n, alpha, beta, gamma, phi, damped, aic, level, trend, seasons array) of each series that likelihood_smoothing() fits."""
    kinds = "".join(f"`{k}` {history.schema[k].dataType.simpleString()}, " for k in keys)
    kinds += "n long, alpha double, beta double, gamma double, phi double, damped boolean, aic double, level double, trend double, seasons array<double>"

    def make(names: list[dict], series: list[np.ndarray]) -> pd.DataFrame:
        rows = [name | model | {"seasons": list(model["seasons"])} for name, model in zip(names, _fitted(series, season), strict=True) if model]
        return pd.DataFrame(rows, columns=[*keys, "n", "alpha", "beta", "gamma", "phi", "damped", "aic", "level", "trend", "seasons"])

    return _by_series(history, keys, time, y, make, kinds)


def calendar_and_lags(df: DataFrame, keys: list[str], time: str, y: str, lags: list[int], windows: list[int]) -> DataFrame:
    """The global model's features: lags and means in the series' own scale, and the calendar."""
    scale = df.groupBy(*keys).agg(F.greatest(F.avg(F.abs(F.col(y))), F.lit(1e-9)).alias("scale"))
    t = F.col(time).cast("timestamp")
    scaled = df.join(scale, keys).withColumn("ys", F.col(y) / F.col("scale"))
    out = lag_features(scaled, keys, time, "ys", lags, windows)
    return out.withColumns({"dow": F.weekday(t), "month": F.month(t), "log_scale": F.log1p("scale")})


def global_forecast(history: DataFrame, keys: list[str], time: str, y: str, horizon: int, step: str = "D", lags: list[int] | None = None, windows: list[int] | None = None, seed: int = 42) -> DataFrame:
    """(keys, step, forecast) of one boosted model for all series, applied step by step to all of them at once.

    Each step's forecasts join the history, of which only what lags and means reach is carried on.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from quillon.session import materialise

    lags, windows = lags or LAGS[step], windows or [7]
    reach = max(*lags, *windows)
    scale = materialise(history.groupBy(*keys).agg(F.greatest(F.avg(F.abs(F.col(y))), F.lit(1e-9)).alias("scale"), F.min(y).alias("_min")), "scale")
    names = [*(f"lag_{k}" for k in lags), *(f"roll_{k}_mean" for k in windows), "dow", "month", "log_scale"]

    def made(df: DataFrame) -> DataFrame:
        t = F.col(time).cast("timestamp")
        return lag_features(df, keys, time, "ys", lags, windows).withColumns({"dow": F.weekday(t), "month": F.month(t), "log_scale": F.log1p("scale")})

    base = history.join(scale, keys).withColumn("ys", F.col(y) / F.col("scale")).select(*keys, time, "ys", "scale", "_min")
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTRegressor(labelCol="ys", maxIter=20, maxDepth=5, seed=seed).fit(assembler.transform(made(base).dropna(subset=[*names, "ys"])).select("features", "ys"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time)))
    tail = materialise(base.withColumn("_r", rank).where(F.col("_r") <= reach).drop("_r"), "tail")
    out = None
    for k in range(1, horizon + 1):
        ahead = tail.groupBy(*keys).agg(F.max(time).alias(time), F.max("scale").alias("scale"), F.max("_min").alias("_min"))
        ahead = ahead.withColumn(time, F.expr(f"{time} + {STEPS[step]}").cast(history.schema[time].dataType)).withColumn("ys", F.lit(None).cast("double"))
        rows = made(tail.unionByName(ahead)).where("ys IS NULL").fillna(0.0, names)
        p = model.transform(assembler.transform(rows)).withColumn("ys", F.when(F.col("_min") >= 0, F.greatest("prediction", F.lit(0.0))).otherwise(F.col("prediction")))
        p = materialise(p.select(*keys, time, "ys", "scale", "_min"), "ahead")
        tail = tail.unionByName(p)
        if k % 5 == 0:
            tail = materialise(tail, "tail")
        part = p.select(*keys, F.lit(k).alias("step"), (F.col("ys") * F.col("scale")).alias("forecast"))
        out = part if out is None else out.unionByName(part)
    return out


def overlay(history: DataFrame, forecast: DataFrame, time: str, y: str) -> DataFrame:
    """(time, history, forecast): totals over series, for a chart."""
    a = history.groupBy(time).agg(F.sum(y).alias("history"))
    return a.join(forecast.groupBy(time).agg(F.sum("forecast").alias("forecast")), time, "full")


def share_inside(y: Column, low: Column, high: Column) -> Column:
    return F.avg(((y >= low) & (y <= high)).cast("double"))


def one_series(df: DataFrame, column: str, value: object) -> DataFrame:
    """The rows of one series of a long table, compared as text."""
    return df.where(F.col(column).cast("string") == str(value)).drop(column)


def scaled_errors(errors: DataFrame, scales: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step, error): signed errors, forecast less actual, in units of each series' own scale (keys, scale); null where that is 0."""
    out = errors.join(scales, keys)
    return out.select(*keys, "step", F.try_divide(F.col("forecast") - F.col("actual"), F.col("scale")).alias("error"))


def panel_report(errors: DataFrame, naive: DataFrame, keys: list[str], scales: DataFrame) -> DataFrame:
    """One row (series, n, wape, rmse, median_mase, beat_naive_share) over a panel; exact, and no series weighs more for its size in median_mase."""
    from quillon.operators.ranking import quantiles

    own = forecast_metrics(errors.join(scales, keys), keys, scale="scale")
    base = forecast_metrics(naive, keys).select(*keys, F.col("mae").alias("_b"))
    e = F.col("forecast") - F.col("actual")
    pooled = errors.agg(F.count("*").alias("n"), F.try_divide(100 * F.sum(F.abs(e)), F.sum(F.abs("actual"))).alias("wape"), F.sqrt(F.avg(e * e)).alias("rmse"))
    better = own.join(base, keys).agg(F.count("*").alias("series"), F.avg((F.col("mae") < F.col("_b")).cast("double")).alias("beat_naive_share"))
    middle = quantiles(own.select(F.col("mase").alias("value")), [0.5], []).select(F.col("q")[0].alias("median_mase"))
    return better.crossJoin(pooled).crossJoin(middle).select("series", "n", "wape", "rmse", "median_mase", "beat_naive_share")


def worst_series(errors: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """The `top` series of the largest WAPE: (keys, n, wape, bias_pct)."""
    return forecast_metrics(errors, keys).select(*keys, "n", "wape", "bias_pct").orderBy(F.desc_nulls_last("wape"), *keys).limit(top)


def mape(errors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mape): the mean absolute percentage error, withheld (null) if an actual value lies near zero."""
    a = F.abs("actual")
    e = F.abs(F.col("forecast") - F.col("actual"))
    return errors.groupBy(*keys).agg(F.when(F.min(a) >= 1e-3 * F.avg(a), 100 * F.avg(F.try_divide(e, a))).alias("mape"))


def coverage(errors: DataFrame, bands: DataFrame) -> DataFrame:
    """One row (coverage): the share of residuals (step, residual) inside the bands (step, low, high)."""
    return errors.join(F.broadcast(bands), "step").agg(share_inside(F.col("residual"), F.col("low"), F.col("high")).alias("coverage"))  # one row for each step


def prepare_forecast(df: DataFrame, time: str, y: str, horizon: int, keys: list[str] | None = None, how: str = "sum") -> tuple[DataFrame, dict]:
    """(rows (keys, time, y, fold), report): times snapped to the grid of the step that they keep, rows of one time aggregated,
    gaps in the grid opened as nulls, the last `horizon` steps of each series held out as test.

    The step (regular_step: hours, days, weeks from a series' own first day, calendar months, or seconds) must cover 80 % of the
    differences.  The report holds it, its share, the times off the grid, rows, gaps and series.  Rows without a time are left out.
    """
    keys = keys or []
    known = df.where(F.col(time).isNotNull()).select(*keys, time, y)
    step, share = regular_step(known.select(*keys, time).distinct(), keys, time)
    if isinstance(step, int) or step == "h":
        known = known.withColumn(time, F.col(time).cast("timestamp"))
    placed = snap(known, keys, time, step)
    made = placed.groupBy(*keys, time).agg(F.expr(f"{how}(`{y}`)").alias(y))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time)))
    out = fill_grid(made, keys, time, step).withColumn("fold", F.when(last <= horizon, "test").otherwise("train"))
    n = out.agg(F.count("*").alias("rows"), F.count_if(F.col(y).isNull()).alias("gaps"), *([F.count_distinct(*keys).alias("series")] if keys else [F.lit(1).alias("series")])).first()
    off = placed.agg(F.count_if("_off")).first()[0]
    return out, {"step": step, "share": share, "off_grid": off, "rows": n["rows"], "gaps": n["gaps"], "series": n["series"]}


def serve(history: DataFrame, keys: list[str], time: str, y: str, season: int, horizon: int, bands: DataFrame, method: str = "naive") -> DataFrame:
    """(keys, step, forecast, low, high): forecasts beyond the history with the shipped bands; steps beyond the bands take the widest.

    method is "naive", "holt_winters" or "likelihood".
    """
    made = {"naive": seasonal_naive, "holt_winters": holt_winters, "likelihood": likelihood_smoothing}[method](history, keys, time, y, season, horizon)
    known = bands.agg(F.max("step").alias("_last"))
    at = made.crossJoin(F.broadcast(known)).withColumn("_at", F.least("step", "_last"))
    out = at.join(F.broadcast(bands.withColumnRenamed("step", "_at")), "_at", "left")  # one row for each step
    return out.select(*keys, "step", "forecast", (F.col("forecast") + F.col("low")).alias("low"), (F.col("forecast") + F.col("high")).alias("high"))
