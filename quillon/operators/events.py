"""Behaviour features: event rows to one row per entity, per entity and period, or per decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.basics import DAY, holds, micros, span
from quillon.operators.aggregates import REGISTERED, expression
from quillon.operators.blocks import Carry, Span, cut, largest_entity, over_blocks
from quillon.session import materialise

SIMPLE = ("count", "share", "sum", "mean", "median", "std", "min", "max", "nunique", "cv", "below", "span_days", "recency_days")
BY_VALUE = ("entropy", "top_share")
AGGREGATES = (*SIMPLE, *BY_VALUE, "periodicity")
AT_DECISION = ("count", "share", "sum", "mean", "std", "min", "max", "recency_days")


def _check(specs: list[dict], allowed: tuple[str, ...], columns: list[str]) -> None:
    names = [s.get("name") for s in specs]
    if len(set(names)) != len(names) or not all(names):
        raise ValueError("every feature needs a name of its own")
    for s in specs:
        if s.get("agg") not in allowed:
            raise ValueError(f"{s['name']}: the aggregate must be one of {', '.join(allowed)}")
        free = not REGISTERED[s["agg"]].column if s["agg"] in REGISTERED else s["agg"] in ("count", "share", "span_days", "recency_days")
        if not free and s.get("column") not in columns:
            raise ValueError(f"{s['name']}: no column {s.get('column')!r}")
        if s["agg"] == "below" and s.get("value") is None:
            raise ValueError(f"{s['name']}: `below` needs a value")


def prepared(df: DataFrame, entity: str, time: str, before=None) -> DataFrame:
    """Rows with a known entity and time (and before the cutoff), with _t in micros and the pseudo-columns _hour, _dow, _day."""
    out = df.withColumn("_t", micros(df, time)).where(F.col("_t").isNotNull() & F.col(entity).isNotNull())
    stamp = F.timestamp_micros("_t")
    if before is not None:
        cut = F.lit(before) if isinstance(before, int) else F.unix_micros(F.to_timestamp(F.lit(str(before))))
        out = out.where(F.col("_t") < cut)
    return out.withColumns({"_hour": F.hour(stamp), "_dow": F.weekday(stamp), "_day": F.to_date(stamp)})


def constant_columns(df: DataFrame, entity: str, columns: list[str]) -> list[str]:
    """The columns that have one value (null is a value) within every entity."""
    per = df.groupBy(entity).agg(*(((F.approx_count_distinct(c) > 1) | (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))).alias(c) for c in columns))
    row = per.agg(*(F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False)).alias(c) for c in columns)).first()
    return [c for c in columns if not row[c]]


def aggregate_events(
    df: DataFrame, entity: str, time: str, features: list[dict], period: str | None = None, before=None, carry: list[str] | None = None, order: list[str] | None = None
) -> DataFrame:
    """One row per entity (or entity and period start) with the features' values and n_events.

    A feature is {name, agg, column, where, value}; `where` and `column` may use _hour, _dow, _day, and column "_gap", the
    seconds since the entity's previous row among those of `where` (and in the period).  Counts, shares and sums without
    rows are 0, all else is null.  Entities without matching rows stay.  `carry` lists columns to keep that are constant
    per entity (see constant_columns).  Aggregates that are registered by name (aggregates.py) stand beside the library's
    own, in the same shuffle.  All conditional aggregates share one shuffle by entity; only entropy, top_share
    and periodicity add a grouping of their own, pre-aggregated by value.
    """
    base = prepared(df, entity, time, before)
    _check(features, (*AGGREGATES, *REGISTERED), [*base.columns, "_gap"])
    keys = [entity]
    if period:
        size = span(period)
        base = base.withColumn("period_start", F.timestamp_micros(F.floor(F.col("_t") / size) * size))
        keys = [entity, "period_start"]
    wheres = list(dict.fromkeys(s.get("where") for s in features))
    flag = {w: f"_w{i}" for i, w in enumerate(wheres)}
    base = base.withColumns({flag[w]: holds(w) for w in wheres})
    for w in {s.get("where") for s in features if s.get("column") == "_gap"}:
        ordered = Window.partitionBy(*keys, flag[w]).orderBy("_t", *(order or []))
        base = base.withColumn(f"_gap{flag[w]}", (F.col("_t") - F.lag("_t").over(ordered)) / 1e6)

    def value(s: dict) -> Column:
        c = s.get("column")
        return F.when(F.col(flag[s.get("where")]), F.col(f"_gap{flag[s.get('where')]}" if c == "_gap" else c))

    if any(s["agg"] == "recency_days" for s in features):
        if period:
            base = base.withColumn("_ref", F.unix_micros("period_start") + span(period))
        elif before is not None:
            base = base.withColumn("_ref", F.lit(before) if isinstance(before, int) else F.unix_micros(F.to_timestamp(F.lit(str(before)))))
        else:
            base = base.crossJoin(F.broadcast(base.agg(F.max("_t").alias("_ref"))))
    made: list[Column] = []
    for s in features:
        hit, agg = F.col(flag[s.get("where")]), s["agg"]
        at = F.when(hit, F.col("_t"))
        if agg in BY_VALUE or agg == "periodicity":
            continue
        x = value(s) if s.get("column") else None
        if agg in REGISTERED:
            made.append(expression(agg, x, hit, at).alias(s["name"]))
            continue
        made.append(
            {
                "count": lambda: F.count_if(hit),
                "share": lambda: F.count_if(hit) / F.count("*"),
                "sum": lambda: F.coalesce(F.sum(x), F.lit(0)),
                "mean": lambda: F.avg(x),
                "median": lambda: F.median(x),
                "std": lambda: F.when(F.count(x) > 1, F.stddev_samp(x)),
                "min": lambda: F.min(x),
                "max": lambda: F.max(x),
                "nunique": lambda: F.count_distinct(x),
                "cv": lambda: F.when(F.count(x) > 1, F.stddev_samp(x) / (F.abs(F.avg(x)) + 1e-9)),
                "below": lambda: F.avg(F.when(x.isNotNull(), (x < s["value"]).cast("double"))),
                "span_days": lambda: (F.max(at) - F.min(at)) / DAY,
                "recency_days": lambda: (F.max("_ref") - F.max(at)) / DAY,
            }[agg]().alias(s["name"])
        )
    out = base.groupBy(*keys).agg(F.count("*").alias("n_events"), *made, *(F.first(c, ignorenulls=True).alias(c) for c in carry or []))
    for s in features:
        if s["agg"] in BY_VALUE:
            counts = base.select(*keys, value(s).alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").count()
            p = F.col("count") / F.sum("count").over(Window.partitionBy(*keys))
            shares = counts.withColumn("_p", p)
            extra = shares.groupBy(*keys).agg((F.sum(-F.col("_p") * F.log2("_p")) if s["agg"] == "entropy" else F.max("_p")).alias(s["name"]))
            out = out.join(extra, keys, "left")
        elif s["agg"] == "periodicity":
            values = base.select(*keys, value(s).alias("_v")).where("_v IS NOT NULL")
            middle = values.groupBy(*keys).agg(F.median("_v").alias("_m"))
            near = (F.abs(F.col("_v") - F.col("_m")) <= 0.05 * F.abs("_m")).cast("double")
            out = out.join(values.join(middle, keys).groupBy(*keys).agg(F.avg(near).alias(s["name"])), keys, "left")
    return out.select(*keys, "n_events", *(s["name"] for s in features), *(carry or []))


def features_at_decisions(
    df: DataFrame, entity: str, time: str, specs: list[dict], at: str, window: str, order: list[str] | None = None, split_rows: int = 1_000_000
) -> DataFrame:
    """The rows where `at` holds, with features over the entity's rows in [t - window, t), simultaneous rows left out.

    A spec is {name, agg, column, where, window}; recency_days looks back without limit, by rows.  Counts, shares and sums
    of nothing are 0.  Where an entity has more than `split_rows` rows, all are cut into blocks of about so many (see
    blocks.py), with the same result.
    """
    base = prepared(df, entity, time)
    _check(specs, AT_DECISION, base.columns)
    by_entity = Window.partitionBy(entity).orderBy("_t")
    by_row = Window.partitionBy(entity).orderBy("_t", *(order or []))
    made = {}
    for s in specs:
        frame = by_entity.rangeBetween(-span(s.get("window", window)), -1)
        hit = holds(s.get("where"))
        x = F.when(hit, F.col(s["column"])) if s.get("column") else None
        made[s["name"]] = {
            "count": lambda: F.count(F.when(hit, 1)).over(frame),
            "share": lambda: F.coalesce(F.try_divide(F.count(F.when(hit, 1)).over(frame).cast("double"), F.count("*").over(frame).cast("double")), F.lit(0.0)),
            "sum": lambda: F.coalesce(F.sum(x).over(frame), F.lit(0)),
            "mean": lambda: F.avg(x).over(frame),
            "std": lambda: F.when(F.count(x).over(frame) > 1, F.stddev_samp(x).over(frame)),
            "min": lambda: F.min(x).over(frame),
            "max": lambda: F.max(x).over(frame),
            "recency_days": lambda: (F.col("_t") - F.last(F.when(hit, F.col("_t")), ignorenulls=True).over(by_row.rowsBetween(Window.unboundedPreceding, -1))) / DAY,
        }[s["agg"]]()
    plain = base.withColumns(made).where(holds(at)).drop("_t", "_hour", "_dow", "_day")
    if largest_entity(base, entity) <= split_rows:
        return plain
    spans, carries = [], []
    for s in specs:
        hit = holds(s.get("where"))
        if s["agg"] == "recency_days":
            carries.append(_latest(s["name"], F.when(hit, F.col("_t")), DAY))
            continue
        x = F.lit(1) if s["agg"] in ("count", "share") else F.col(s["column"])
        spans.append(Span(s["name"], s["agg"], F.when(hit, x), span(s.get("window", window)), _or_zero if s["agg"] == "sum" else lambda c: c))
    blocks = cut(base.withColumn("_o", F.col("_t")), entity, ["_o", *(order or [])], split_rows)
    return _as(over_blocks(blocks, entity, order or [], {}, 0, spans, carries).where(holds(at)), plain)


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _latest(name: str, at: Column, unit: int) -> Carry:
    """The time since the last of an entity's earlier rows for which `at`, its time, isn't null."""
    return Carry(name, F.max(at), lambda carried, _, w: (F.col("_t") - F.greatest(F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), carried)) / unit)


def _streak(name: str, good: Column) -> Carry:
    """The rows since the entity's last row that wasn't good, as of the row before."""

    def make(carried: Column, before: Column, w: Window) -> Column:
        place = before + F.col("_i")
        broken = F.max(F.when(~good, place)).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return place - 1 - F.coalesce(F.greatest(broken, carried), F.lit(0))

    return Carry(name, F.max(F.when(~good, F.col("_i"))), make, place=True)


def _as(out: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, in its types."""
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema))


WINDOW_OPS = ("lag", "diff", "pct_change", "roll_mean", "roll_std", "roll_min", "roll_max", "roll_sum", "roll_count", "vs_roll_mean", "gap_prev", "since", "prior_count", "streak")
FIRST = -(1 << 62)  # where a row without a time stands


def _row_feature(op: str, c: str | None, n: int, frame, rows, unit: int) -> Column:
    """A feature over a bounded number of rows before or, by its frame, a bounded time."""
    x = F.col(c) if c else None
    if op == "lag":
        return F.lag(x, n).over(rows)
    if op == "diff":
        return x - F.lag(x, n).over(rows)
    if op == "pct_change":
        return (x - F.lag(x, n).over(rows)) / (F.abs(F.lag(x, n).over(rows)) + 1e-6)
    if op == "gap_prev":
        return (F.col("_t") - F.lag("_t").over(rows)) / unit
    if op == "roll_count":
        return F.count("*").over(frame)
    if op == "vs_roll_mean":
        return x / (F.avg(x).over(frame) + 1e-6)
    if op == "roll_std":
        return F.when(F.count(x).over(frame) > 1, F.stddev_samp(x).over(frame))
    return {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[op[5:]](x).over(frame)


def entity_features(
    df: DataFrame, entity: str, time: str, specs: list[dict], target: str | None = None, order: list[str] | None = None, split_rows: int = 1_000_000
) -> DataFrame:
    """Adds features of each row from the entity's earlier rows only.

    Specs {name, op, column, n | window} apply in order, so one may use what an earlier one made.  All windows share one
    partitioning and order.  `n` counts rows, `window` is a span over [t - w, t).  Integer times stay in their own unit.
    Rows without a time come first, and windows of time hold none for them.  Null is an entity.  Where an entity has more
    than `split_rows` rows, all are cut into blocks of about so many (see blocks.py), with the same result.
    """
    integer = df.schema[time].dataType.typeName() in ("integer", "long", "short", "byte")
    unit = 1 if integer else DAY
    base = df.withColumn("_t", F.col(time).cast("long") if integer else micros(df, time)).withColumn("_o", F.coalesce("_t", F.lit(FIRST)))
    out = base
    rows = Window.partitionBy(entity).orderBy("_o", *(order or []))
    earlier = rows.rowsBetween(Window.unboundedPreceding, -1)
    for s in specs:
        op, name, c, n = s.get("op"), s.get("name"), s.get("column"), int(s.get("n", 1))
        if op not in WINDOW_OPS or not name:
            raise ValueError(f"{name}: the operation must be one of {', '.join(WINDOW_OPS)}")
        if target is not None and c == target:
            raise ValueError(f"{name}: the target cannot be an input")
        if op not in ("gap_prev", "roll_count") and c not in out.columns:
            raise ValueError(f"{name}: no column {c!r}")
        if op == "roll_count" and not s.get("window"):
            raise ValueError(f"{name}: roll_count needs a time window")
        x = F.col(c) if c else None
        if op == "since":
            made = (F.col("_t") - F.last(F.when(x > 0, F.col("_t")), ignorenulls=True).over(earlier)) / unit
        elif op == "prior_count":
            made = F.row_number().over(Window.partitionBy(entity, c).orderBy("_o", *(order or []))) - 1
        elif op == "streak":  # rows since the last break, as of the previous row
            good = F.coalesce(x > 0, F.lit(False))
            out = out.withColumn("_i", F.row_number().over(rows))
            broken = F.coalesce(F.max(F.when(~good, F.col("_i"))).over(earlier), F.lit(0))
            made = F.col("_i") - 1 - broken
        else:
            frame = Window.partitionBy(entity).orderBy("_o").rangeBetween(-span(s["window"]), -1) if s.get("window") else rows.rowsBetween(-n, -1)
            made = _row_feature(op, c, n, frame, rows, unit)
            if op == "roll_sum" and s.get("window"):
                made = _or_zero(made)
        out = out.withColumn(name, made).drop("_i")
    plain = out.drop("_t", "_o")
    if largest_entity(base, entity) <= split_rows:
        return plain
    return _as(_blocked_features(base, entity, specs, order or [], unit, split_rows), plain)


def _layers(specs: list[dict], columns: list[str]) -> list[list[dict]]:
    """The specs in runs of which none reads or replaces what the same run makes or the rows have."""
    out: list[list[dict]] = [[]]
    for s in specs:
        if out[-1] and (s.get("column") in {e["name"] for e in out[-1]} or s["name"] in columns or out[-1][-1]["name"] in columns or s["name"] in {e["name"] for e in out[-1]}):
            out.append([])
        out[-1].append(s)
    return out


def _blocked_features(base: DataFrame, entity: str, specs: list[dict], order: list[str], unit: int, split_rows: int) -> DataFrame:
    blocks = cut(base, entity, ["_o", *order], split_rows)
    layers = _layers(specs, base.columns)
    for k, layer in enumerate(layers):
        behind, back, spans, carries, counts = {}, 0, [], [], {}
        for s in layer:
            op, name, c, n = s["op"], s["name"], s.get("column"), int(s.get("n", 1))
            x = F.col(c) if c else None
            if op == "since":
                carries.append(_latest(name, F.when(x > 0, F.col("_t")), unit))
            elif op == "streak":
                carries.append(_streak(name, F.coalesce(x > 0, F.lit(False))))
            elif op == "prior_count":
                counts[name] = c
            elif op == "gap_prev" or not s.get("window") or op in ("lag", "diff", "pct_change"):
                behind[name] = lambda w, op=op, c=c, n=n: _row_feature(op, c, n, w.rowsBetween(-n, -1), w, unit)
                back = max(back, 1 if op == "gap_prev" else n)
            else:
                kind = "mean" if op == "vs_roll_mean" else op[5:]
                wrap = {"vs_roll_mean": lambda m, c=c: F.col(c) / (m + 1e-6), "roll_sum": _or_zero}.get(op, lambda m: m)
                spans.append(Span(name, kind, F.lit(1) if op == "roll_count" else x, span(s["window"]), wrap))
        blocks = over_blocks(blocks, entity, order, behind, back, spans, carries, counts)
        if k < len(layers) - 1:
            blocks = materialise(blocks, "blocks")
    return blocks
