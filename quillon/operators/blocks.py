"""Windows over an entity's earlier rows where one entity may have more rows than a task can hold.

Rows are cut into blocks, which are ranges of (entity, time, order).  A block of an entity gets as a halo only those earlier
rows of the entity that some of its windows reach in part; blocks that lie wholly inside every window of a block come as
one row of partial aggregates, and what a row looks back for without limit is handed on from block to block.  As the edges
of the windows of successive blocks don't overlap, all halos together hold about two copies of a row for each window width,
however wide it is.  Block summaries (one row for each entity and block) of entities with several blocks are joined by entity.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FractionalType, IntegralType, LongType, StructField, StructType

from quillon.session import materialise

MOST_BLOCKS = 20_000
#: Rows of a range that is cut into blocks.
RANGE = 250_000


@dataclass
class Span:
    """An aggregate of x (null where a row doesn't count) over the rows of [t - width, t): count, share, sum, mean, std, min or max."""

    name: str
    kind: str
    x: Column
    width: int
    wrap: Callable[[Column], Column] = field(default=lambda c: c)


@dataclass
class Carry:
    """What an entity's earlier rows hold without limit: `part` is a block's aggregate, the greatest of it over the earlier
    blocks is handed on, and make(carried, rows before the block, window of the block's rows) gives the feature.  A `place`
    is a row's place _i in its block, and is handed on as its place among all rows of the entity."""

    name: str
    part: Column
    make: Callable[[Column, Column, Window], Column]
    place: bool = False


def largest_entity(df: DataFrame, entity: str) -> int:
    """The most rows that an entity has."""
    return df.groupBy(entity).count().agg(F.max("count")).first()[0] or 0


def cut(df: DataFrame, entity: str, order: list[str], rows: int) -> DataFrame:
    """df with _block, written: ranges of (entity, order) of at most `rows` rows, so that rows of a later block are later in order.

    Sorted ranges of about 250,000 rows are cut into blocks, so blocks don't cost a task each.  There are about 20,000 blocks
    at most; above, they get larger.
    """
    n = df.count()
    rows = max(rows, math.ceil(n / MOST_BLOCKS))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / max(rows, RANGE)))
    ranged = df.repartitionByRange(parts, entity, *order).sortWithinPartitions(entity, *order)
    place = F.monotonically_increasing_id()  # the range above bit 33, the row's place in it below
    inside = F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / rows)
    return materialise(ranged.withColumn("_block", F.shiftright(place, 33) * F.lit(1 << 31) + inside), "blocks")


def _partials(j: int, span: Span) -> dict[str, Column]:
    x = F.col(f"_x{j}")
    made = {"n": F.count(x)}
    if span.kind in ("sum", "mean"):
        made["s"] = F.sum(x)
    elif span.kind in ("min", "max"):
        made["s"] = F.min(x) if span.kind == "min" else F.max(x)
    elif span.kind == "share":
        made["s"] = F.count("*")
    elif span.kind == "std":
        made |= {"s": F.avg(x), "m2": F.var_pop(x) * F.count(x)}
    return {f"_{k}{j}": c for k, c in made.items()}


def _whole(j: int, span: Span, covered: Column) -> list[Column]:
    """The partial aggregates of several blocks as one; the squares about the entity's mean, so that no digits cancel."""
    n, s = (F.when(covered, F.col(f"_{k}{j}")) for k in "ns")
    made = [F.coalesce(F.sum(n), F.lit(0)).alias(f"_wn{j}")]
    if span.kind in ("sum", "mean", "share"):
        made.append(F.sum(s).alias(f"_ws{j}"))
    elif span.kind in ("min", "max"):
        made.append((F.min(s) if span.kind == "min" else F.max(s)).alias(f"_ws{j}"))
    elif span.kind == "std":
        d = s - F.col(f"_mu{j}")
        off = F.try_divide(F.sum(n * d), F.sum(n))
        made += [(F.max(f"_mu{j}") + off).alias(f"_ws{j}"), (F.sum(F.when(covered, F.col(f"_m2{j}"))) + F.sum(n * d * d) - F.sum(n) * off * off).alias(f"_wm2{j}")]
    return made


def _together(j: int, span: Span) -> Column:
    """The span's value from the rows of its frame that count (_fn, _fs, _fm) and the blocks that lie wholly in it."""
    zero = F.lit(0)
    nf, nw = F.col(f"_fn{j}"), F.coalesce(F.col(f"_wn{j}"), zero)
    if span.kind == "count":
        return nf + nw
    fs, ws = F.col(f"_fs{j}"), F.col(f"_ws{j}")
    if span.kind == "share":
        return F.coalesce(F.try_divide((nf + nw).cast("double"), (fs + F.coalesce(ws, zero)).cast("double")), F.lit(0.0))
    if span.kind in ("min", "max"):
        return F.least(fs, ws) if span.kind == "min" else F.greatest(fs, ws)
    if span.kind in ("sum", "mean"):
        total = F.coalesce(fs, zero) + F.coalesce(ws, zero)
        return F.when(nf + nw > 0, total if span.kind == "sum" else total / (nf + nw))
    d = F.coalesce(fs - ws, zero)
    m2 = F.coalesce(F.col(f"_fm{j}"), zero) + F.coalesce(F.col(f"_wm2{j}"), zero) + d * d * nf * nw / (nf + nw)
    return F.when(nf + nw > 1, F.sqrt(m2 / (nf + nw - 1)))


def _framed(j: int, span: Span, frame: Window, counts: Column) -> dict[str, Column]:
    """What _together reads, of the frame's rows that count, by Spark's window: each row goes through its frame."""
    x = F.when(counts, F.col(f"_x{j}"))
    made = {f"_fn{j}": F.count(x).over(frame)}
    if span.kind == "std":
        return made | {f"_fs{j}": F.avg(x).over(frame), f"_fm{j}": F.var_pop(x).over(frame) * F.count(x).over(frame)}
    if span.kind == "share":
        return made | {f"_fs{j}": F.count(F.when(counts, 1)).over(frame)}
    return made if span.kind == "count" else made | {f"_fs{j}": {"sum": F.sum, "mean": F.sum, "min": F.min, "max": F.max}[span.kind](x).over(frame)}


def _moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, mean, squares about it) of two sets as one."""
    n, d = a[0] + b[0], b[1] - a[1]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    both = (a[0] > 0) & (b[0] > 0)
    mean = np.where(both, a[1] + d * share, np.where(a[0] > 0, a[1], b[1]))
    return np.array([n, mean, a[2] + b[2] + np.where(both, d * d * a[0] * share, 0.0)])


def _over_ranges(x: np.ndarray, none, join: Callable, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """join() over each range [lo, hi) of x's last axis by a tree of pairs, so a range takes some log n steps."""
    out = np.broadcast_to(none, (*x.shape[:-1], len(lo))).astype(x.dtype)
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        odd = (lo < hi) & (lo & 1 == 1)
        out[..., odd] = join(out[..., odd], x[..., lo[odd]])
        lo += odd
        odd = (lo < hi) & (hi & 1 == 1)
        hi -= odd
        out[..., odd] = join(out[..., odd], x[..., hi[odd]])
        lo, hi = lo >> 1, hi >> 1
        if x.shape[-1] % 2:
            x = np.concatenate([x, np.broadcast_to(none, (*x.shape[:-1], 1)).astype(x.dtype)], axis=-1)
        x = join(x[..., 0::2], x[..., 1::2])
    return out


def _frames(spans: dict[int, tuple[str, int, bool]], widths: list[int]) -> Callable[[pa.Table], pa.Table]:
    """Adds _fn, _fs and _fm of the spans (kind, width, are its numbers whole?) to the own rows of a block, with its halo."""

    def numbers(t: pa.Table, name: str, fill) -> np.ndarray:
        return t[name].combine_chunks().fill_null(fill).to_numpy(zero_copy_only=False)

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("_o")
        o, own = numbers(t, "_o", 0), ~numbers(t, "_halo", False)
        hi, made = np.searchsorted(o, o[own], "left"), {}
        counted = lambda keep, lo: (s := np.concatenate([[0], np.cumsum(keep)]))[hi] - s[np.minimum(lo, hi)]
        for j, (kind, width, whole) in spans.items():
            lo = np.searchsorted(o, o[own] - width, "left")
            counts = numbers(t, f"_raw{widths.index(width)}", False)
            valid = counts & t[f"_x{j}"].is_valid().to_numpy()
            n = counted(valid, lo).astype(np.int64)
            made[f"_fn{j}"] = pa.array(n)
            if kind == "share":
                made[f"_fs{j}"] = pa.array(counted(counts, lo).astype(np.int64))
            if kind in ("count", "share"):
                continue
            x, empty = numbers(t, f"_x{j}", 0), n == 0
            if kind == "std":
                parts = np.array([valid.astype(float), np.where(valid, x, 0.0), np.zeros(len(x))])
                _, mean, squares = _over_ranges(parts, 0.0, _moments, lo, hi)
                made |= {f"_fs{j}": pa.array(mean, mask=empty), f"_fm{j}": pa.array(squares, mask=empty)}
                continue
            least, most = (np.iinfo(np.int64).min, np.iinfo(np.int64).max) if whole else (-np.inf, np.nan)  # NaN is above all
            none, join = {"min": (most, np.minimum if whole else np.fmin), "max": (least, np.maximum)}.get(kind, (0, np.add))
            made[f"_fs{j}"] = pa.array(_over_ranges(np.where(valid, x, none).astype(x.dtype), none, join, lo, hi), mask=empty)
        t = t.filter(pa.array(own))
        for name, values in made.items():
            t = t.append_column(name, values)
        return t

    return add


def over_blocks(
    blocks: DataFrame, entity: str, order: list[str], behind: dict[str, Callable[[Window], Column]], back: int, spans: list[Span], carries: list[Carry], counts: dict[str, str] | None = None
) -> DataFrame:
    """Adds to the rows of cut() (with the long _o, their time) each feature over the entity's earlier rows.

    `behind` holds features over at most `back` rows before, made from a window in row order; `spans` those over a time
    before; `carries` those without limit; `counts` gives, by name, the column of which earlier rows with the same value are
    counted.  Null is an entity and a value like any other.
    """
    keep, row_order = blocks.columns, ["_o", *order]
    mine = Window.partitionBy(entity, "_block").orderBy(*row_order)
    kinds = [f.dataType for f in blocks.select(*(s.x.alias(f"_x{j}") for j, s in enumerate(spans))).schema] if spans else []
    quick = {j: (s.kind, s.width, isinstance(k, IntegralType) and s.kind != "std") for j, (s, k) in enumerate(zip(spans, kinds, strict=True)) if s.kind in ("count", "share") or isinstance(k, (IntegralType, FractionalType)) and k.typeName() != "decimal"}
    xs = {f"_x{j}": s.x if j not in quick or s.kind in ("count", "share") else s.x.cast("long" if quick[j][2] else "double") for j, s in enumerate(spans)}
    rows = blocks.withColumns(xs | {"_i": F.row_number().over(mine)})
    parts = {k: c for j, s in enumerate(spans) for k, c in _partials(j, s).items()} | {f"_c{j}": c.part for j, c in enumerate(carries)}
    found = rows.groupBy(entity, "_block").agg(F.count("*").alias("_rows"), F.min("_o").alias("_first"), F.max("_o").alias("_last"), *(c.alias(k) for k, c in parts.items()))
    found = materialise(found, "summaries")
    every = Window.partitionBy(entity)
    earlier = every.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    mu = {f"_mu{j}": F.try_divide(F.sum(F.col(f"_n{j}") * F.col(f"_s{j}")).over(every), F.sum(f"_n{j}").over(every)) for j, s in enumerate(spans) if s.kind == "std"}
    found = found.withColumns({"_blocks": F.count("*").over(every), "_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0))} | mu).where("_blocks > 1")

    widths = sorted({s.width for s in spans})
    source = found.withColumnsRenamed({entity: "_e", "_block": "_source"})
    target = found.select(F.col(entity).alias("_te"), F.col("_block").alias("_target"), F.col("_first").alias("_tfirst"), F.col("_last").alias("_tlast"), F.col("_before").alias("_tbefore"))
    pairs = source.join(target, F.col("_e").eqNullSafe(F.col("_te")) & (F.col("_source") < F.col("_target")))
    pairs = pairs.withColumn("_between", F.col("_tbefore") - F.col("_before") - F.col("_rows"))
    for i, w in enumerate(widths):
        inside = (F.col("_first") >= F.col("_tlast") - w) & (F.col("_last") < F.col("_tfirst"))
        pairs = pairs.withColumns({f"_in{i}": inside, f"_raw{i}": ~inside & (F.col("_last") >= F.col("_tfirst") - w)})
    raw = [f"_raw{i}" for i in range(len(widths))]
    links = pairs.select("_e", "_source", "_target", "_between", "_tfirst", F.col("_rows").alias("_of"), *raw)
    # a source row is wanted if it is among the last rows before the target or in reach of a window
    wanted = F.col("_of") - F.col("_i") + 1 + F.col("_between") <= back
    for i, w in enumerate(widths):
        wanted |= F.col(f"_raw{i}") & (F.col("_o") >= F.col("_tfirst") - w)
    near = F.col("_between") < back
    for c in raw:
        near |= F.col(c)
    halo = rows.join(links.where(near), rows[entity].eqNullSafe(F.col("_e")) & (rows["_block"] == F.col("_source"))).where(wanted)
    halo = halo.withColumns({"_block": F.col("_target"), "_halo": F.lit(True)}).select(*rows.columns, "_halo", *raw)
    own = rows.withColumns({"_halo": F.lit(False)} | {c: F.lit(True) for c in raw})
    both = own.unionByName(halo)

    if spans:
        whole = pairs.groupBy("_e", "_target").agg(*(c for j, s in enumerate(spans) for c in _whole(j, s, F.col(f"_in{widths.index(s.width)}"))))
        both = both.join(whole, both[entity].eqNullSafe(whole["_e"]) & (both["_block"] == whole["_target"]), "left").drop("_e", "_target")
    made = {name: make(mine) for name, make in behind.items()}
    by_time = Window.partitionBy(entity, "_block").orderBy("_o")
    for j, s in enumerate(spans):
        if j not in quick:
            made |= _framed(j, s, by_time.rangeBetween(-s.width, -1), F.col(f"_raw{widths.index(s.width)}"))
    # a feature may replace the column that another one reads, so all are made beside the rows first
    out = both.withColumns({f"_m_{name}" if name in behind else name: c for name, c in made.items()})
    if quick:
        fields = [StructField(f"_f{part}{j}", LongType() if part == "n" or kind == "share" or whole else DoubleType()) for j, (kind, _, whole) in quick.items() for part in {"count": "n", "std": "nsm"}.get(kind, "ns")]
        out = out.groupBy(entity, "_block").applyInArrow(_frames(quick, widths), StructType([*out.schema.fields, *fields]))
    out = out.where("NOT _halo")
    last = {name: F.col(f"_m_{name}") for name in behind} | {s.name: s.wrap(_together(j, s)) for j, s in enumerate(spans)}
    out, made = out.withColumns(last), last
    if carries:
        handed = found.select(F.col(entity).alias("_e"), F.col("_block").alias("_source"), "_before", *(F.max(F.col(f"_c{j}") + F.col("_before") if c.place else F.col(f"_c{j}")).over(earlier).alias(f"_c{j}") for j, c in enumerate(carries)))
        out = out.join(handed, out[entity].eqNullSafe(handed["_e"]) & (out["_block"] == handed["_source"]), "left")
        out = out.withColumns({c.name: c.make(F.col(f"_c{j}"), F.coalesce("_before", F.lit(0)), mine) for j, c in enumerate(carries)})
    names = [*made, *(c.name for c in carries)]
    out = out.select(*(c for c in keep if c not in names), *names)
    for name, c in (counts or {}).items():
        seen = blocks.groupBy(F.col(entity).alias("_e"), F.col("_block").alias("_source"), F.col(c).alias("_v")).agg(F.count("*").alias("_k"))
        before = seen.withColumn("_k", F.sum("_k").over(Window.partitionBy("_e", "_v").orderBy("_source").rowsBetween(Window.unboundedPreceding, -1))).where("_k IS NOT NULL")
        same = out[entity].eqNullSafe(before["_e"]) & (out["_block"] == before["_source"]) & out[c].eqNullSafe(before["_v"])
        here = F.row_number().over(Window.partitionBy(entity, "_block", c).orderBy(*row_order)) - 1
        out = out.withColumn(name, here).join(before, same, "left").withColumn(name, F.col(name) + F.coalesce("_k", F.lit(0))).drop("_e", "_source", "_v", "_k")
    return out
