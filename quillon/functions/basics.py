"""Column helpers: time as micros, safe predicates, missing values, calendar parts, special functions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = {"s": 1_000_000, "min": 60_000_000, "m": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000, "d": 86_400_000_000, "W": 604_800_000_000}
DAY = MICROS["D"]


def span(text: str) -> int:
    """Microseconds of a span such as "24h", "7D" or "h"."""
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", text)
    if not m or m[2] not in MICROS:
        raise ValueError(f"not a time span: {text!r}")
    return int(m[1] or 1) * MICROS[m[2]]


def micros(df: DataFrame, column: str) -> Column:
    """A time column as microseconds since the epoch; numbers count as epoch seconds, text is parsed, bad text is null."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(c.cast("timestamp"))
    if kind == "string":
        return F.unix_micros(parse_time(c))
    return (c.cast("double") * 1_000_000).cast("long")


#: Tried in order by parse_time.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "MM-dd-yyyy", "yyyyMMdd")


def parse_time(c: Column) -> Column:
    """Text of mixed formats as a timestamp, null where none fits."""
    return F.coalesce(F.try_to_timestamp(c), *(F.try_to_timestamp(c, F.lit(f)) for f in FORMATS))


def holds(predicate: str | None) -> Column:
    """A SQL predicate that is false where it is null."""
    return F.lit(True) if not predicate else F.coalesce(F.expr(predicate).cast("boolean"), F.lit(False))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all floating columns, since there is one kind of missing value."""
    fix = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(fix) if fix else df


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("byte", "short", "integer", "long", "float", "double", "decimal")
    return [f.name for f in df.schema if f.dataType.typeName() in kinds]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in ("string", "boolean")]


def calendar(t: Column) -> dict[str, Column]:
    """Hour, weekday (Monday 0), weekend flag, day, ISO week, month and quarter of a timestamp."""
    return {
        "hour": F.hour(t), "dow": F.weekday(t), "is_weekend": (F.weekday(t) >= 5).cast("int"), "day": F.dayofmonth(t),
        "week": F.weekofyear(t), "month": F.month(t), "quarter": F.quarter(t), "year": F.year(t),
    }


def bias_corrected_skew(c: Column | str) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2) * F.skewness(c))


def stacked(df: DataFrame, columns: list[str], keep: list[str], kind: str = "double", name: str = "column_name", value: str = "value") -> DataFrame:
    """The columns as rows (keep..., name, value), in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in columns)))
    return df.select(*keep, pairs.alias("_p")).select(*keep, f"_p.{name}", f"_p.{value}")


def normal_isf(p: float) -> float:
    """The z that a standard normal exceeds with probability p."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(mid / math.sqrt(2)) > p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def chi2_sf(x: float, k: int) -> float:
    """The probability that chi-square with k degrees of freedom exceeds x."""
    if x <= 0:
        return 1.0
    a, z = k / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * scale


def chi2_isf(p: float, k: int) -> float:
    lo, hi = 0.0, 1e4 + 10 * k
    for _ in range(200):
        mid = (lo + hi) / 2
        if chi2_sf(mid, k) > p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def ks_sf(d: float, n: float, m: float) -> float:
    """Asymptotic p-value of a two-sample Kolmogorov-Smirnov statistic."""
    x = d * math.sqrt(n * m / (n + m))
    if x < 1e-3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
