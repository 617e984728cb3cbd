"""Registration, rounding and the inputs that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import table


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Registers a function under its name, with its SQL."""

        def take(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return take


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the SQL rounds them."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in kinds.items()))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score between 0 and 1 from their length: y is toxic, s the score, pred an alert at 0.5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    s = F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 4)
    both = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("s", s)
    return both.select("doc_id", "lang", "source", "quality", F.col("toxic").alias("y"), "s", (F.col("s") >= 0.5).cast("int").alias("pred"))


SCORED = """scored AS (
  SELECT doc_id, lang, source, quality, toxic AS y, round(n_chars / (n_chars + 2000.0), 4) AS s,
         (round(n_chars / (n_chars + 2000.0), 4) >= 0.5)::INT AS pred
  FROM documents JOIN labels USING (doc_id)
)"""


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the customer's previous total as prediction."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("pred", F.lag("o_totalprice").over(w))


ORDERS = """ot AS (
  SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pred FROM orders
)"""


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, day, y): orders per priority and day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


DAILY = """daily AS (
  SELECT o_orderpriority AS series, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2
)"""
