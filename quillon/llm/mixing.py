"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD
from quillon.session import materialise, table

#: Sources take these weights in turn, in code point order, null last.
WEIGHTS = (5, 2, 1)
#: A document's place is a 36-bit hash of its id, read as three digits of 12 bits.
DIGIT = 12


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Rows (id, source, size, source_size, target, taken, copies), one per row of docs.

    Size is the number of words.  The sources share 150 % of all sizes by weight; no target exceeds twice its source's
    size, and what is above is shared again.  The water level that results is found from one ordered pass over the
    sources.  A source whose target is q full copies and a rest takes every document q times, and once more those whose
    hash lies below a threshold: sizes are summed by source and hash bucket, the bucket in which the running sum passes
    the rest is refined (twice, by the next 12 bits), and the documents are then filtered by comparing hashes.  Thresholds
    for smaller budgets are nested in those for larger ones, and nothing is sorted.

    Words of very long texts count like all others; other columns, whatever their names, are ignored.  Sources come to one
    task once, one row each, when the water level is found.

    A null text has size 0, a null source is a source of its own.  Documents with the same id are taken or left together.
    An all-empty table has targets 0.  No rows give no rows.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    sized = materialise(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("k"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 9), 16, 10).cast("long").alias("h"),
        ).withColumn("b1", F.shiftright("h", 2 * DIGIT).cast("int")),
        "sized",
    )
    totals = materialise(sized.groupBy("k", "source").agg(F.sum("size").alias("source_size")), "totals")
    weighted = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    few = totals.count() <= 10_000  # one row for each source

    whole = Window.orderBy(F.col("source_size") / F.col("w"), "k")
    earlier, all_rows = whole.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        weighted.withColumn("double_rest", 3 * F.sum("source_size").over(all_rows) - 4 * F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
        .withColumn("w_rest", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(earlier), F.lit(0)))
        .withColumn("share", F.col("w") * F.col("double_rest").cast("double") / (2 * F.col("w_rest")))
        .withColumn("full", 2 * F.col("source_size") <= F.col("share"))
        .withColumn("i", F.row_number().over(whole))
        .withColumn("at", F.min(F.when(~F.col("full"), F.struct("i", "double_rest", "w_rest"))).over(all_rows))
        .withColumn(
            "target",
            F.when(F.col("full"), (2 * F.col("source_size")).cast("double")).otherwise(
                F.col("w") * F.col("at.double_rest").cast("double") / (2 * F.col("at.w_rest"))
            ),
        )
        .withColumn("q", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)))
        .select("k", "source_size", "target", "q", (F.col("target") - F.col("q") * F.col("source_size")).alias("rest"))
    )
    level = materialise(level, "targets")

    def passed(buckets: DataFrame, by: str, value: str) -> DataFrame:
        """Running sums of each source's buckets, starting at `base`."""
        w = Window.partitionBy("k").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return buckets.withColumn("upto", F.col("base") + F.sum(value).over(w)).withColumn("before", F.col("upto") - F.col(value))

    edge = (F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest"))
    first = passed(sized.groupBy("k", "b1").agg(F.sum("size").alias("sz")).join(level, "k").withColumn("base", F.lit(0)), "b1", "sz")
    first = materialise(first, "buckets")

    def refine(above: DataFrame, keys: list[str], digit: int) -> DataFrame:
        """The buckets of the next digit inside the boundary bucket of each source."""
        inner = above.where(edge).select(*keys, "rest", F.col("before").alias("base"))
        rows = sized.join(F.broadcast(inner) if few else inner, keys)
        name = f"b{len(keys)}"
        buckets = (
            rows.withColumn(name, F.shiftright("h", DIGIT * (2 - digit)) % (1 << DIGIT))
            .groupBy(*keys, name, "rest", "base")
            .agg(F.sum("size").alias("sz"))
        )
        return passed(buckets, name, "sz")

    sized = sized.withColumn("b2", (F.shiftright("h", DIGIT) % (1 << DIGIT)).cast("int"))
    second = materialise(refine(first, ["k", "b1"], 1), "buckets")
    third = refine(second, ["k", "b1", "b2"], 2)
    nearer = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("before"))
    low = F.lit(1 << DIGIT).cast("long")
    cuts = (
        first.select("k", F.when(F.col("upto") <= F.col("rest"), (F.col("b1") + 1) * low * low).alias("cut"))
        .unionByName(second.select("k", F.when(F.col("upto") <= F.col("rest"), F.col("b1") * low * low + (F.col("b2") + 1) * low).alias("cut")))
        .unionByName(
            third.select("k", F.when((F.col("upto") <= F.col("rest")) | nearer, F.col("b1") * low * low + F.col("b2") * low + F.col("b3") + 1).alias("cut"))
        )
        .groupBy("k")
        .agg(F.coalesce(F.max("cut"), F.lit(0)).cast("long").alias("cut"))
    )
    # every source and bucket gets its threshold, so that the documents of a large source are joined over 4,096 keys
    rules = first.select("k", "b1", "source_size", "target", "q", "rest").join(cuts, "k", "left")
    copies = (F.col("q") + F.when((F.col("rest") > 0) & (F.col("h") < F.col("cut")), 1).otherwise(0)).cast("int")
    return (
        sized.join(rules, ["k", "b1"])
        .withColumn("copies", copies)
        .select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 9))::BIGINT AS h
  FROM documents
), s AS (
  SELECT k, source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY k, source
), a AS (
  SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER e, 0) AS double_rest,
         sum(w) OVER () - coalesce(sum(w) OVER e, 0) AS w_rest, row_number() OVER (ORDER BY source_size / w, k) AS i
  FROM s WINDOW e AS (ORDER BY source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, 2 * source_size <= w * double_rest::DOUBLE / (2 * w_rest) AS "full" FROM a
), l AS (
  SELECT double_rest AS dr, w_rest AS wr FROM f WHERE NOT "full" ORDER BY i LIMIT 1
), t AS (
  SELECT k, source_size, CASE WHEN "full" THEN (2 * source_size)::DOUBLE ELSE w * (SELECT dr FROM l)::DOUBLE / (2 * (SELECT wr FROM l)) END AS target FROM f
), q AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS q FROM t
), r AS (
  SELECT d.*, source_size, target, q, target - q * source_size AS rest,
         sum(size) OVER (PARTITION BY d.k ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.k, h) AS here
  FROM d JOIN q ON d.k = q.k
)
SELECT doc_id, size, source_size, target,
       (size * (q + CASE WHEN rest > 0 AND (upto <= rest OR (upto - here < rest AND upto - rest < rest - (upto - here))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
