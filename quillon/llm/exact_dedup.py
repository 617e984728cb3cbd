"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, salted_left_join
from quillon.session import materialise, table

#: A chunk ends after the first such pair at 256 characters or later, or at 4,096 characters.  Texts in other scripts, without
#: such pairs, are cut at every 4,096 characters: equal texts still have equal recipes, but shifted ones share no chunks.
CUT = r"(?s).{256,4094}?[hmvw][aeiou]|.{1,4096}"


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text, in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64, salts: int = 16
) -> DataFrame:
    """Rows (id, keep_id, group_size, kept, text_sha256, n_chars), one per row of docs; n_chars counts the original text's code points.

    Texts are equal if they are the same after all white space is deleted.  Every text becomes a recipe, the ordered list
    of its chunks' identifiers.  A chunk's identifier is its hash once all chunks with that hash have been seen to be the
    same (their least and greatest are equal, which partial aggregation finds without gathering copies); where they
    differ, an ordinal among the differing chunks is added.  Recipes are then compared as lists, so that long texts move
    once, chunk by chunk, and never as a group.

    Null texts count as empty, and all empty texts are one group.  Ties go to the smallest id; a null id loses to any
    other.  Rows that repeat an id together with its text are one document: all carry the same verdict, and each counts in
    group_size.  Very long texts are cut whole and move once.  Other columns of docs are ignored.  No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("_id"), F.char_length(text).alias("_n"), F.regexp_replace(text, SPACE + "+", "").alias("_norm")
    )
    pieces = base.select("_norm").select(F.explode(chunks(F.col("_norm"))).alias("chunk")).withColumn("h", chunk_hash(F.col("chunk")))
    unlike = pieces.groupBy("h").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a != b").select("h")
    unlike = materialise(unlike, "unlike")

    listed = base.select(
        "_id", "_n", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"), F.transform(chunks(F.col("_norm")), lambda c: chunk_hash(c)).alias("_hashes"), *(["_norm"] if unlike.take(1) else [])
    )
    if "_norm" in listed.columns:
        listed = _with_ordinals(listed, pieces, unlike, chunk_hash)
    else:
        listed = listed.withColumn("_ordinals", F.array().cast("array<int>"))
    recipes = materialise(listed.select("_id", "_n", "text_sha256", "_hashes", "_ordinals"), "recipes")

    groups = (
        recipes.groupBy("_hashes", "_ordinals")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("_n", F.bitwise_not("_id").alias("i"))).alias("best"))
        .where("group_size > 1")
        .select("_hashes", "_ordinals", "group_size", F.col("best._n").alias("_keep_n"), F.bitwise_not(F.col("best.i")).alias("keep_id"))
    )
    joined = salted_left_join(recipes, groups, ["_hashes", "_ordinals"], F.col("_id"), salts)
    alone = F.col("group_size").isNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == F.col("_keep_n")))).alias("kept"),
        "text_sha256",
        F.col("_n").alias("n_chars"),
    )


def _with_ordinals(listed: DataFrame, pieces: DataFrame, unlike: DataFrame, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """Adds, to the recipes that hold a chunk whose hash several chunks share, the chunk's ordinal among those."""
    from pyspark.sql import Window

    shared = pieces.join(unlike, "h", "left_semi").distinct()
    numbered = shared.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    found = (
        listed.select("_id", "_n", "text_sha256", F.posexplode(chunks(F.col("_norm"))).alias("pos", "chunk"))
        .join(numbered.select("chunk", "k"), "chunk")
        .select("text_sha256", "pos", "k")
        .distinct()
        .groupBy("text_sha256")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "k"))).alias("at"))
    )
    none = F.array().cast("array<int>")
    return listed.join(found, "text_sha256", "left").withColumn(
        "_ordinals",
        F.when(F.col("at").isNull(), none).otherwise(
            F.transform(F.col("_hashes"), lambda h, i: F.coalesce(F.element_at(F.col("at"), i), F.lit(0)))
        ),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chars")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
